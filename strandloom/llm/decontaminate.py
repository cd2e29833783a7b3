"""Benchmark decontamination by template canonicalisation.

Texts and benchmark items become sequences of canonical tokens: numbers, names (capitalised words within a sentence)
and units after a number are replaced by typed placeholders, other words are lower-cased without punctuation. Windows of
canonical tokens with enough literal words are hashed and hash-joined with the windows of the items. A re-parameterised
question has the same windows with other slot values; along each alignment (place in the document minus place in the
item) the slots must be consistent: an item value goes to one document value of its type. Where it goes to several, only
the windows that show so are dropped; values that meet by chance are let pass unless most do. Where at least half of the
numbers and names are the item's own the alignment is a copy, and what was altered in it counts for nothing. Windows
with too few literal words are hashed with their slot values instead, and find word-for-word copies only. A document
leaks an item if the windows found cover enough of the item, or those with enough literal words enough of such windows.

Before the join a document's windows pass a bitmap of the benchmark's window hashes. Its size is fixed, whatever the
benchmark; only windows that it lets through become rows, so the join's input is the hits and few others. Items with
equal texts are one item until their names are given at the end. A leak needs some number of an item's windows, so it
holds one of the others and one more at least: only the rarest so many windows of each item lead to it, and wordings that
many items share multiply nothing. All windows of the pairs that were found so are then joined and judged.

Defined results: null and empty texts and items hold no windows; items with fewer tokens than a window are one window of
their own length, found by template or word for word; those with fewer than ``MIN_TOKENS`` are found where they are the
whole of a document; items with a null id are left out; items with equal texts are all named; rows that repeat a doc_id
are judged together; an empty benchmark finds nothing; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, staged

WINDOW = 8
MIN_TOKENS = 3
LITERALS = 0.6
COVERAGE = 0.5
RUN = 16
BITMAP_BITS = 24
CACHE_WORDS = 150_000
#: Sets the hashes of windows with their slot values apart.
EXACT = 1 << 32
#: Units of measure, as fixed values.
UNITS = frozenset(
    "mm cm dm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t ton tons oz lb lbs pound pounds ml cl dl l liter liters litre litres "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years percent usd eur gbp dollar dollars euro euros cent cents "
    "kmh mph hz khz mhz ghz w kw v a c f k j kj cal kcal kb mb gb tb heure heures jour jours stunde stunden tag tage hora horas dia dias".split()
)
_WORD = re.compile(r"[^\W_]")
_NOISE = re.compile(r"[\W_]+")
_C = np.uint64(0x9E3779B97F4A7C15)
SLOT_NAMES = ("number", "name", "unit")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Canonical:
    """Canonical tokens of texts; each distinct white-space chunk is looked at once."""

    # Flags of a chunk: has a word, holds a digit, looks like a name, is a unit word, ends a sentence.
    HAS, NUMBER, NAME, UNIT, END = 1, 2, 4, 8, 16

    def __init__(self):
        self.slots = np.array([xxhash.xxh64_intdigest(f"<{s}>") for s in SLOT_NAMES], np.uint64)
        self._clear()

    def _clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.hash = np.zeros(1 << 12, np.uint64)
        self.flag = np.zeros(1 << 12, np.uint8)
        self.bare: list[str] = []

    def _new(self, chunk: str) -> int:
        i = len(self.bare)
        if i == len(self.hash):
            self.hash, self.flag = np.concatenate([self.hash, np.zeros_like(self.hash)]), np.concatenate([self.flag, np.zeros_like(self.flag)])
        bare = _NOISE.sub("", chunk)
        flag = self.HAS if bare else 0
        if any(c.isdigit() for c in bare):
            flag |= self.NUMBER
        elif len(bare) > 1 and bare[0].isupper() and bare[1:].islower():
            flag |= self.NAME
        bare = bare.lower()
        if bare in UNITS or chunk in "%€$£":
            flag |= self.UNIT | self.HAS
            bare = bare or chunk
        if chunk.rstrip("\"')]»”")[-1:] in (".", "!", "?", ":", "…") or chunk[:1] in ("-", "*", "#"):
            flag |= self.END
        self.hash[i], self.flag[i] = xxhash.xxh64_intdigest(bare.encode("utf-8", "replace")), flag
        self.bare.append(bare)
        self.ids[chunk] = i
        return i

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, slot types (-1 for literal words) and chunk ids of the canonical tokens."""
        if len(self.bare) > CACHE_WORDS:
            self._clear()
        ids = self.ids
        chunks = (text or "").split()
        found = np.array([ids[c] if c in ids else self._new(c) for c in chunks], np.int64)
        if not len(found):
            return np.zeros(0, np.uint64), np.zeros(0, np.int8), found
        flag = self.flag[found]
        start = np.concatenate([[True], (flag[:-1] & self.END) > 0])
        has = (flag & self.HAS) > 0
        # A chunk without a word keeps a sentence's end open for the next one.
        found, flag, start = found[has], flag[has], start[has]
        if not len(found):
            return np.zeros(0, np.uint64), np.zeros(0, np.int8), found
        slot = np.full(len(found), -1, np.int8)
        slot[((flag & self.NAME) > 0) & ~start] = 1
        slot[(flag & self.NUMBER) > 0] = 0
        after = np.concatenate([[False], slot[:-1] == 0])
        slot[((flag & self.UNIT) > 0) & after] = 2
        h = self.hash[found]
        h[slot >= 0] = self.slots[slot[slot >= 0]]
        return h, slot, found


def windows(h: np.ndarray, slot: np.ndarray, n: int, literals: float = LITERALS) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the windows of ``n`` tokens that hold enough literal words."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    x = np.full(m, n, np.uint64)
    for j in range(n):
        x = x * _C + h[j : j + m]
    words = np.concatenate([[0], np.cumsum(slot < 0)])
    at = np.flatnonzero(words[n:] - words[:-n] >= literals * n)
    return at, _mix(x[at])


def exact_windows(h: np.ndarray, slot: np.ndarray, n: int, literals: float = LITERALS) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the other windows, by the words' own hashes ``h``."""
    if len(h) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    words = np.concatenate([[0], np.cumsum(slot < 0)])
    at = np.flatnonzero(words[n:] - words[:-n] < literals * n)
    x = np.full(len(at), n + EXACT, np.uint64)
    for j in range(n):
        x = x * _C + h[at + j]
    return at, _mix(x)


def _rows(canonical: Canonical, text: str | None, n: int, window: int, keep=None) -> Iterator[tuple[int, int, list[str], list[int]]]:
    """start, hash, slot values and slot types of a text's windows of ``n`` tokens."""
    h, slot, ids = canonical(text)
    # Whole short items count word for word however many literal words they have, and the shortest as a whole text only.
    short = n < window
    if short and n < MIN_TOKENS and len(h) != n:
        return
    found = [exact_windows(canonical.hash[ids], slot, n, 2.0 if short else LITERALS)]
    if n >= MIN_TOKENS:
        found.append(windows(h, slot, n))
    at, x = (np.concatenate(v) for v in zip(*found, strict=True))
    if keep is not None:
        hit = keep(x)
        at, x = at[hit], x[hit]
    for a, v in zip(at.tolist(), x.view(np.int64).tolist(), strict=True):
        places = np.flatnonzero(slot[a : a + n] >= 0)
        yield a, v, [canonical.bare[ids[a + p]] for p in places], slot[a + places].tolist()


SCHEMA = "id long, size int, start long, hash long, slot_values array<string>, slot_types array<int>"


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canonical = Canonical()
        for batch in batches:
            out = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = min(window, len(canonical(text)[0]))
                out += [(i, n, *r) for r in _rows(canonical, text, n, window)] if n else []
            yield _batch(out)

    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()))
    columns = list(zip(*rows, strict=True)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])


def bitmap(hashes: DataFrame, bits: int = BITMAP_BITS) -> np.ndarray:
    """A bitmap of fixed size: bit ``hash >> (64 - bits)`` is set for every hash; built part by part."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(1 << (bits - 3), np.uint8)
        for batch in batches:
            top = batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - bits)
            np.bitwise_or.at(own, (top >> np.uint64(3)).astype(np.int64), (1 << (top & np.uint64(7))).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([own.tobytes()], pa.binary())], names=["part"])

    whole = np.zeros(1 << (bits - 3), np.uint8)
    for r in hashes.coalesce(16).mapInArrow(part, "part binary").toLocalIterator():
        whole |= np.frombuffer(r.part, np.uint8)
    return whole


def rare_windows(items: DataFrame, coverage: float) -> DataFrame:
    """id, hash, size of the windows of which every leak of an item holds one: the item's rarest but for those it may do without.

    items: (id, size, start, hash, template).
    """
    df = items.select("id", "hash", "size").distinct().groupBy("hash", "size").agg(F.count("*").alias("df"))
    rows = items.join(df, ["hash", "size"])
    per, order = Window.partitionBy("id"), [F.col("df"), F.col("hash"), F.col("start")]
    template = F.when(F.col("template"), 1)
    starts = lambda c: F.size(F.collect_set(c).over(per))
    ranked = rows.select(
        "id", "hash", "size", "template", F.row_number().over(per.orderBy(*order)).alias("rank"), F.sum(template).over(per.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)).alias("template_rank"),
        F.count("*").over(per).alias("rows"), F.count(template).over(per).alias("template_rows"), starts(F.col("start")).alias("starts"), starts(F.when(F.col("template"), F.col("start"))).alias("template_starts"),
    )
    need = F.least(F.ceil(F.lit(coverage) * F.col("starts")), F.lit(RUN))
    any_of = F.col("rank") <= F.col("rows") - need + 1
    template_of = F.col("template") & (F.col("template_rank") <= F.col("template_rows") - F.ceil(F.lit(coverage) * F.col("template_starts")) + 1)
    return ranked.filter(any_of | template_of).select("id", "hash", "size").distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, coverage, same_slots for every leaked item of every document."""
    spark = docs.sparkSession
    named = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).withColumn("key", F.sha2("text", 256))
    first = named.groupBy("key").agg(F.min("item_id").alias("id"))
    names = staged(named.select("item_id", "key").distinct().join(first, "key").select("item_id", "id"), "benchmark-names")
    once = named.join(first, "key").filter("item_id = id").dropDuplicates(["key"]).select("item_id", "text")
    items = staged(benchmark_windows(once, window), "benchmark-windows")
    # Window lengths are between 1 and window.
    lengths = sorted(r.size for r in items.select("size").distinct().collect())
    sent = spark.sparkContext.broadcast(bitmap(items.select("hash")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canonical, bits = Canonical(), sent.value

        def keep(x: np.ndarray) -> np.ndarray:
            top = x >> np.uint64(64 - BITMAP_BITS)
            return (bits[(top >> np.uint64(3)).astype(np.int64)] >> (top & np.uint64(7)).astype(np.uint8)) & 1 > 0

        for batch in batches:
            out = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for n in lengths:
                    out += [(i, n, *r) for r in _rows(canonical, text.as_py(), n, window, keep)]
            if out:
                yield _batch(out)

    texts = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hits = staged(texts.mapInArrow(lean(run), SCHEMA).withColumnsRenamed({"id": "doc_id", "start": "doc_start", "slot_values": "doc_values", "slot_types": "doc_types"}), "window-hits")
    templates = F.col("size") - F.size("slot_values") >= F.lit(LITERALS) * F.col("size")
    rare = rare_windows(items.withColumn("template", templates), coverage)
    wanted = hits.select("doc_id", "hash", "size").join(rare, ["hash", "size"]).select("doc_id", F.col("id").alias("item_id")).distinct()
    met = wanted.join(items.withColumnRenamed("id", "item_id"), "item_id").join(hits, ["doc_id", "hash", "size"])
    pair = F.transform(F.sequence(F.lit(0), F.size("slot_values") - 1), lambda i: F.struct(F.get("slot_types", i).alias("t"), F.get("slot_values", i).alias("iv"), F.get("doc_values", i).alias("dv")))
    pairs = F.when((F.size("slot_values") > 0) & (F.size("slot_values") == F.size("doc_values")), pair).otherwise(F.array().cast("array<struct<t:int,iv:string,dv:string>>"))
    lined = met.groupBy("doc_id", "item_id", (F.col("doc_start") - F.col("start")).alias("line")).agg(F.collect_set(F.struct("start", templates.alias("template"), pairs.alias("pairs"))).alias("hits"))
    lined = lined.withColumn("pairs", F.array_distinct(F.flatten(F.transform("hits", lambda h: h["pairs"]))))
    side = lambda v: F.size(F.array_distinct(F.transform("pairs", lambda p: F.struct(p["t"], p[v]))))
    own = F.filter("pairs", lambda p: p["t"] < 2)
    copied = 2 * F.size(F.filter(own, lambda p: p["iv"] == p["dv"])) >= F.size(own)
    merged = 2 * side("dv") < F.size("pairs")
    lined = lined.withColumn("whole", copied | (side("iv") == F.size("pairs")) & ~merged).withColumn("merged", merged)
    clash = lambda p: F.exists("pairs", lambda q: (q["t"] == p["t"]) & ((q["iv"] == p["iv"]) & (q["dv"] != p["dv"]) | F.col("merged") & (q["dv"] == p["dv"]) & (q["iv"] != p["iv"])))
    clashing = F.when(F.col("whole"), F.array().cast("array<struct<t:int,iv:string,dv:string>>")).otherwise(F.filter("pairs", lambda p: (p["iv"] != p["dv"]) & clash(p)))
    # A window of the item's own values needs no map.
    sound = lined.withColumn("clashing", clashing).withColumn("hits", F.filter("hits", lambda h: ~F.arrays_overlap(h["pairs"], F.col("clashing")))).filter(F.size("hits") > 0)
    sizes = items.groupBy(F.col("id").alias("item_id")).agg(F.countDistinct("start").alias("windows"), F.countDistinct(F.when(templates, F.col("start"))).alias("template_windows"))
    covered = (
        sound.withColumn("starts", F.array_distinct(F.transform("hits", lambda h: h["start"]))).withColumn("template_starts", F.array_distinct(F.transform(F.filter("hits", lambda h: h["template"]), lambda h: h["start"])))
        .groupBy("doc_id", "item_id").agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("starts")))).alias("found"), F.size(F.array_distinct(F.flatten(F.collect_list("template_starts")))).alias("template_found"),
            F.max(F.size("starts")).alias("longest"), F.max(F.forall("pairs", lambda p: p["iv"] == p["dv"])).alias("same_slots"))
        .join(sizes, "item_id")
    )
    share = F.greatest(F.col("found") / F.col("windows"), F.try_divide(F.col("template_found").cast("double"), F.col("template_windows").cast("double")))
    return covered.withColumn("coverage", share).filter((F.col("coverage") >= coverage) | (F.col("longest") >= RUN)).join(names.select(F.col("id"), F.col("item_id").alias("name")), F.col("item_id") == F.col("id")).select("doc_id", F.col("name").alias("item_id"), "coverage", "same_slots")


def flag(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, contaminated, item_ids (sorted), coverage (the largest; 0 if none) and reparameterised, a row per row of ``docs``."""
    found = leaks(docs, benchmark, window, coverage).groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("coverage").alias("coverage"), F.min("same_slots").alias("same"))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(staged(found, "leaks"), "doc_id", "left")
    return out.select("doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.coalesce(~F.col("same"), F.lit(False)).alias("reparameterised"))
