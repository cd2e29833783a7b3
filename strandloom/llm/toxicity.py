"""Toxicity by a factorization machine over hashed terms.

A text's features are the distinct 64-bit hashes of its words (lower case, without punctuation around them). The model
is ``bias + sum w_i + sum_{i<j} <v_i, v_j>``: the second sum learns pairs, such as an insult together with the mention
of a group, that additive weights miss. It is trained on the driver from a bounded sample of labelled rows
(``max_labelled``, those with the smallest hash of their id) and keeps the ``max_terms`` terms that tell most about the
label in it, so its size does not depend on the corpus; it is sent to the executors once. Every text is scored whole.

Defined results: null and empty texts score as a text without terms; without labelled rows of both classes the score is
the share of toxic rows among those there are (0 if none); rows that repeat an id are scored one by one; labels that are
null are left out, and an id with several labels counts as toxic if one of them is 1; other columns are ignored.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, staged

MAX_LABELLED = 20_000
MAX_TERMS = 4096
#: Terms below this chi-square (p = 0.001) are taken for noise.
MIN_CHI_SQUARE = 10.8
FACTORS = 6
EPOCHS = 20
#: Weight of a toxic row in the loss: they are few.
TOXIC_WEIGHT = 4.0
BATCH = 256
#: A small sample is gone over more often, so that there are so many steps at least.
MIN_STEPS = 300
CACHE_WORDS = 150_000
_EDGES = string.punctuation + "¡¿«»„“”‘’…–—"


def term(word: str) -> int | None:
    """The signed 64-bit hash of a word's term; None where nothing is left of it."""
    bare = word.strip(_EDGES).lower()
    return xxhash.xxh64_intdigest(bare.encode("utf-8", "replace")) - (1 << 63) if bare else None


class _Cached(dict):
    """word -> value of its term, for the words seen so far."""

    def __init__(self, value):
        super().__init__()
        self.value = value

    def __missing__(self, word: str):
        if len(self) >= CACHE_WORDS:
            self.clear()
        out = self.value(word)
        if len(word) <= 64:
            self[word] = out
        return out


def labelled_terms(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, terms (distinct hashes), toxic of the sample: at most ``max_labelled`` documents, staged."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    # Bounded: max_labelled pairs of numbers.
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cached = _Cached(term)
        for batch in batches:
            found = [sorted({cached[w] for w in (t.as_py() or "").split()} - {None}) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64())), batch.column(2)], names=["doc_id", "terms", "toxic"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")
    return staged(rows.mapInArrow(lean(terms), "doc_id long, terms array<long>, toxic int"), "toxicity-sample")


def select_terms(sample: DataFrame, total: int, toxic: int, max_terms: int, min_docs: int = 3) -> np.ndarray:
    """The terms with the largest chi-square of presence against label, counted in Spark: at most ``max_terms`` come here."""
    counted = sample.select(F.explode("terms").alias("term"), "toxic").groupBy("term").agg(F.count("*").alias("n"), F.sum("toxic").alias("pos"))
    expected = F.col("n") * toxic / total
    spread = expected * (1 - toxic / total) * (1 - F.col("n") / total) + 1e-9
    chi = (F.col("pos") - expected) * (F.col("pos") - expected) / spread
    best = counted.filter((F.col("n") >= min_docs) & (F.col("n") < total)).withColumn("chi", chi).filter(F.col("chi") > MIN_CHI_SQUARE)
    return np.array(sorted(r.term for r in best.orderBy(F.desc("chi"), "term").limit(max_terms).select("term").collect()), np.int64)


def sample_rows(sample: DataFrame, terms: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The places of each sample document's terms in ``terms``, and the labels: a few hundred numbers a document at most."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x in batch.column(1):
                own = np.asarray(x.values, np.int64)
                at = np.minimum(np.searchsorted(terms, own), max(len(terms) - 1, 0))
                found.append((at[terms[at] == own] if len(terms) else at[:0]).astype(np.int16))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int16())), batch.column(2)], names=["doc_id", "places", "toxic"])

    got = sample.mapInArrow(places, "doc_id long, places array<short>, toxic int").toArrow()
    rows = [np.asarray(x.values, np.int64) for x in got.column("places")]
    ids, y = got.column("doc_id").to_numpy(), got.column("toxic").to_numpy().astype(float)
    # In a fixed order, however the sample was dealt out.
    order = sorted(range(len(rows)), key=lambda i: (ids[i], rows[i].tolist()))
    return [rows[i] for i in order], y[order]


class Model:
    """Term hashes (sorted), their weights and factors, and the bias."""

    def __init__(self, terms: np.ndarray, w: np.ndarray, v: np.ndarray, bias: float):
        self.terms, self.w, self.v, self.bias = terms, w, v, bias

    def logit(self, index: np.ndarray) -> float:
        v = self.v[index]
        return float(self.bias + self.w[index].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v * v).sum()))

    def score(self, index: np.ndarray) -> float:
        return 1.0 / (1.0 + math.exp(-min(60.0, max(-60.0, self.logit(index)))))


def train(terms: np.ndarray, rows: list[np.ndarray], y: np.ndarray, factors: int = FACTORS, epochs: int = EPOCHS, rate: float = 0.15, decay: float = 2e-4, seed: int = 7) -> Model:
    """AdaGrad on the logistic loss, in a fixed order of mini-batches; ``rows`` are places in ``terms``."""
    toxic, m = float(y.sum()), len(terms)
    rng = np.random.default_rng(seed)
    w, v, bias = np.zeros(m), rng.normal(0, 0.02, (m, factors)), math.log(toxic / (len(y) - toxic))
    gw, gv, gb = np.full(m, 1e-6), np.full((m, factors), 1e-6), 1e-6
    epochs = max(epochs, -(-MIN_STEPS // -(-len(rows) // BATCH)))
    for _ in range(epochs if m else 0):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            sizes = np.array([len(rows[i]) for i in some])
            doc = np.repeat(np.arange(len(some)), sizes)
            idx = np.concatenate([rows[i] for i in some])
            vi = v[idx]
            s = np.stack([np.bincount(doc, vi[:, f], len(some)) for f in range(factors)], 1)
            z = bias + np.bincount(doc, w[idx], len(some)) + 0.5 * ((s**2).sum(1) - np.bincount(doc, (vi * vi).sum(1), len(some)))
            err = (1.0 / (1.0 + np.exp(-np.clip(z, -40, 40))) - y[some]) * np.where(y[some] > 0, TOXIC_WEIGHT, 1.0)
            e = err[doc]
            dw = np.bincount(idx, e, m) / len(some) + decay * w
            pair = e[:, None] * (s[doc] - vi)
            dv = np.stack([np.bincount(idx, pair[:, f], m) for f in range(factors)], 1) / len(some) + decay * v
            gw += dw * dw
            gv += dv * dv
            gb += err.mean() ** 2
            w -= rate * dw / np.sqrt(gw)
            v -= 0.2 * rate * dv / np.sqrt(gv)
            bias -= rate * err.mean() / math.sqrt(gb)
    return Model(terms, w, v, bias)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_terms: int = MAX_TERMS) -> Model:
    sample = labelled_terms(docs, labels, max_labelled)
    known = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    if known.toxic in (0, known.n):
        return Model(np.zeros(0, np.int64), np.zeros(0), np.zeros((0, FACTORS)), 60.0 if known.n and known.toxic else -60.0)
    terms = select_terms(sample, known.n, known.toxic, max_terms)
    return train(terms, *sample_rows(sample, terms))


def score(docs: DataFrame, model: Model, out_column: str = "score") -> DataFrame:
    """``docs`` with the score in ``out_column``; all other columns are kept."""
    name = "text"
    sent = docs.sparkSession.sparkContext.broadcast((model.terms, model.w, model.v, model.bias))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*sent.value)
        place = dict(zip(model.terms.tolist(), range(len(model.terms)), strict=True))
        cached = _Cached(lambda w: place.get(term(w), -1))
        for batch in batches:
            out = []
            for text in batch.column(name):
                found = set(map(cached.__getitem__, (text.as_py() or "").split()))
                found.discard(-1)
                out.append(model.score(np.fromiter(sorted(found), np.int64, len(found))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, out_column])

    from pyspark.sql.types import DoubleType, StructField, StructType

    plain = docs.withColumn(name, F.col(name).cast("string")).drop(out_column)
    return plain.mapInArrow(lean(scored), StructType([*plain.schema.fields, StructField(out_column, DoubleType())]))


def is_held_out(doc_id) -> F.Column:
    """Rows whose labels are never learned: crc32 of the id as text is divisible by 5."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def classify(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; learns only from rows that are not held out."""
    model = fit(docs, labels.filter(~is_held_out("doc_id")), max_labelled)
    found = score(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(is_held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
