"""Exact top-k inner-product search with a pivot-distance index.

Components are integer codes floor(scale * x). Every vector is keyed by its nearest pivot and its distance to it and the
index is stored sorted by that key, so a pivot's annuli are contiguous. For a vector x in an annulus [a, b] of pivot p
the triangle inequality gives ``|q - x| >= max(0, |q - p| - b, a - |q - p|)``, hence the score is at most
``(|q|^2 + max|x|^2 - bound^2) / 2``. A block of queries is answered in two sweeps: the first visits each query's home
annuli (the best bounds) and yields its k-th score so far; the second expands to all other annuli, skips those whose
bound is below it (whole row groups through the sort key, then slices of rows), and raises it while it goes.

Pivots come from a bounded sample (``sample`` vectors with the smallest hash of their id); every vector is indexed and the
search is exact whatever the pivots are. Queries are taken in blocks of ``query_block``, so what is sent to executors is
bounded; annuli statistics have at most ``pivots * rings`` rows.

Defined results: vectors that are null or hold a null or non-finite component, and rows with a null id, take no part;
shorter vectors count as padded with zeros; rows that repeat an id are candidates each, but no candidate has its
query's own id; a repeated query id is answered once; ties go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parallelism, shared_folder, staged

SCALE = 1024
PIVOTS = 32
RINGS = 16
SAMPLE = 4096
QUERY_BLOCK = 4096
SLICE = 1024
EXACT = 2.0**53
HITS = "query_id long, vec_id long, score long"


def codes(vectors: DataFrame, id_column: str, column: str, scale: int = SCALE) -> DataFrame:
    """vec_id and integer codes of the vectors that take part."""
    x = F.col(column)
    sound = F.col(id_column).isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    return vectors.filter(sound).select(F.col(id_column).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v.cast("double") * scale)).alias("code"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column as a matrix of int64, padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat, sizes = column.flatten().to_numpy(), column.value_lengths().to_numpy()
    if len(sizes) and (sizes == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(sizes), dims), np.int64)
    at = 0
    for i, n in enumerate(sizes):
        out[i, :n] = flat[at : at + n]
        at += n
    return out


def choose_pivots(sample: np.ndarray, k: int, rounds: int = 4) -> np.ndarray:
    """Farthest-first seeds, then a few Lloyd rounds; deterministic."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    x = sample.astype(float)
    chosen, near = [0], ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(k, len(x)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(1))
    pivots = x[chosen].copy()
    for _ in range(rounds):
        own = distances(x, pivots).argmin(1)
        for j in range(len(pivots)):
            if (own == j).any():
                pivots[j] = x[own == j].mean(0)
    return pivots


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d = (x.astype(float) ** 2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2.0 * (x.astype(float) @ pivots.T)
    return np.sqrt(np.maximum(d, 0.0))


def bounds(to_pivot: np.ndarray, q2: np.ndarray, lo: float, hi: float, n2: float) -> np.ndarray:
    """Upper bounds of the scores of an annulus, with room for rounding."""
    gap = np.maximum(0.0, np.maximum(to_pivot - hi, lo - to_pivot) - 1e-6 * (1.0 + to_pivot))
    top = q2 + n2
    return (top - gap * gap) / 2.0 + 1e-9 * top + 1e-3


def products(queries: np.ndarray, x: np.ndarray, exact_floats: bool) -> np.ndarray:
    return queries.astype(float) @ x.astype(float).T if exact_floats else queries @ x.T


class Best:
    """The best hits of a block of queries: (score descending, id ascending), k each."""

    def __init__(self, ids: np.ndarray, k: int, floor: np.ndarray):
        self.ids, self.k, self.floor = ids, k, floor.astype(float).copy()
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, rows: np.ndarray, vec_ids: np.ndarray, scores: np.ndarray) -> None:
        self.parts.append((rows, vec_ids, scores))
        self.held += len(rows)
        if self.held > 400_000:
            self.trim()

    def trim(self) -> None:
        if not self.parts:
            return
        q, v, s = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((v, -s, q))
        q, v, s = q[order], v[order], s[order]
        first = np.searchsorted(q, q, "left")
        place = np.arange(len(q)) - first
        last = place == self.k - 1
        self.floor[q[last]] = np.maximum(self.floor[q[last]], s[last])
        keep = place < self.k
        self.parts, self.held = [(q[keep], v[keep], s[keep])], int(keep.sum())

    def batch(self) -> pa.RecordBatch:
        self.trim()
        q, v, s = self.parts[0] if self.parts else (np.zeros(0, np.int64),) * 3
        return pa.RecordBatch.from_arrays([pa.array(self.ids[q]), pa.array(v), pa.array(s.astype(np.int64))], names=["query_id", "vec_id", "score"])


class PivotIndex:
    """The index of ``base`` (vec_id, code): a staged table sorted by (pivot, distance) and its annuli."""

    def __init__(self, base: DataFrame, pivots: int = PIVOTS, rings: int = RINGS, sample: int = SAMPLE):
        spark = base.sparkSession
        stats = base.agg(F.max(F.size("code")).alias("dims"), F.max(F.expr("aggregate(code, 0D, (a, v) -> greatest(a, abs(cast(v as double))))")).alias("most")).first()
        self.dims, self.exact_floats = max(1, stats.dims or 1), (stats.dims or 0) * (stats.most or 0.0) ** 2 < EXACT
        some = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("code").toArrow().column(0)
        dims = self.dims
        self.pivots = centres = choose_pivots(matrix(some, dims), pivots)

        def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = matrix(batch.column(1), dims)
                d = distances(x, centres)
                own = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array(d[np.arange(len(own)), own]), pa.array((x.astype(float) ** 2).sum(1))], names=["vec_id", "code", "pivot", "distance", "norm2"])

        keyed = base.mapInArrow(key, "vec_id long, code array<long>, pivot int, distance double, norm2 double")
        # The id breaks ties of the range partitions, so that a very common vector is spread.
        dealt = keyed.repartitionByRange(parallelism(spark), "pivot", "distance", "vec_id").sortWithinPartitions("pivot", "distance", "vec_id")
        self.table = staged(dealt, "pivot-index")
        spread = self.table.groupBy("pivot").agg(F.min("distance").alias("lo"), F.max("distance").alias("hi"))
        # One row per pivot; rings cut each pivot's range of distances evenly.
        self.spread = {r.pivot: (r.lo, r.hi) for r in spread.collect()}
        self.rings = rings
        cuts = spark.createDataFrame([(p, lo, max(hi - lo, 1e-9) / rings) for p, (lo, hi) in self.spread.items()], "pivot int, lo double, width double")
        ring = F.least(F.lit(rings - 1), F.floor((F.col("distance") - F.col("lo")) / F.col("width")).cast("int"))
        annuli = self.table.join(F.broadcast(cuts), "pivot").groupBy("pivot", ring.alias("ring")).agg(F.min("distance").alias("lo"), F.max("distance").alias("hi"), F.max("norm2").alias("n2"), F.count("*").alias("n"))
        self.annuli = sorted((r.pivot, r.lo, r.hi, r.n2, r.n) for r in annuli.collect())

    def _wanted(self, visits: dict[int, list[tuple[float, float]]]) -> F.Column:
        """A filter on the sort key, for row groups to be skipped by their statistics."""
        keep = F.lit(False)
        for p, spans in visits.items():
            lo, hi = min(s[0] for s in spans), max(s[1] for s in spans)
            keep = keep | ((F.col("pivot") == p) & F.col("distance").between(lo, hi))
        return keep

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
        """Top-k of one block of queries: query_id, vec_id, score, with a few more rows than k for each query."""
        to_pivot, q2 = distances(queries, self.pivots), (queries.astype(float) ** 2).sum(1)
        ub = np.stack([bounds(to_pivot[:, p], q2, lo, hi, n2) for p, lo, hi, n2, _ in self.annuli], 1)
        # Home annuli: by falling bound until they hold more than k vectors.
        order = np.argsort(-ub, 1, kind="stable")
        sizes = np.array([a[4] for a in self.annuli])
        before = np.cumsum(sizes[order], 1) - sizes[order]
        home = np.zeros(ub.shape, bool)
        np.put_along_axis(home, order, before <= k, 1)
        first = self._sweep(ids, queries, to_pivot, q2, home, np.full(len(ids), -np.inf), k)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        # At most a row per query of the block.
        tenth = {r.query_id: r.score for r in first.withColumn("rank", rank).filter(F.col("rank") == k).select("query_id", "score").collect()}
        floor = np.array([tenth.get(int(i), -np.inf) for i in ids], float)
        return self._sweep(ids, queries, to_pivot, q2, ub >= floor[:, None], floor, k)

    def _sweep(self, ids: np.ndarray, queries: np.ndarray, to_pivot: np.ndarray, q2: np.ndarray, visit: np.ndarray, floor: np.ndarray, k: int) -> DataFrame:
        wanted: dict[int, list[tuple[float, float]]] = {}
        for (p, lo, hi, _, _), any_query in zip(self.annuli, visit.any(0), strict=True):
            if any_query:
                wanted.setdefault(p, []).append((lo, hi))
        by_pivot = {p: (np.array([s[0] for s in spans]), np.array([s[1] for s in spans])) for p, spans in wanted.items()}
        annulus_of: dict[int, list[int]] = {}
        for i, a in enumerate(self.annuli):
            annulus_of.setdefault(a[0], []).append(i)
        lows = {p: np.array([self.annuli[i][1] for i in own]) for p, own in annulus_of.items()}
        dims, exact = self.dims, self.exact_floats
        context = self.table.sparkSession.sparkContext.broadcast((ids, queries, to_pivot, q2, visit, floor))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, queries, to_pivot, q2, visit, floor = context.value
            best = Best(ids, k, floor)
            for batch in batches:
                vec_ids, pivot, dist, norm2 = (batch.column(c).to_numpy() for c in ("vec_id", "pivot", "distance", "norm2"))
                x = matrix(batch.column("code"), dims)
                # A task may read several files, one after another: a slice ends where the sort order breaks.
                breaks = np.flatnonzero((pivot[1:] != pivot[:-1]) | (dist[1:] < dist[:-1])) + 1
                ends = np.append(breaks, len(pivot))
                at = 0
                while at < len(pivot):
                    p = int(pivot[at])
                    end = min(at + SLICE, int(ends[np.searchsorted(ends, at, "right")]))
                    if p in by_pivot:
                        lo, hi = dist[at], dist[end - 1]
                        rings = annulus_of[p]
                        a, b = (max(0, int(np.searchsorted(lows[p], d, "right")) - 1) for d in (lo, hi))
                        seen = visit[:, rings[a] : rings[b] + 1].any(1)
                        rows = np.flatnonzero(seen & (bounds(to_pivot[:, p], q2, lo, hi, norm2[at:end].max()) >= best.floor))
                        if len(rows):
                            score = products(queries[rows], x[at:end], exact)
                            score[ids[rows][:, None] == vec_ids[at:end][None, :]] = np.iinfo(np.int64).min // 2
                            i, j = np.nonzero(score >= np.maximum(best.floor[rows], np.iinfo(np.int64).min // 4)[:, None])
                            if len(i):
                                best.add(rows[i], vec_ids[at:end][j], score[i, j].astype(np.int64))
                    at = end
            yield best.batch()

        return self.table.filter(self._wanted(wanted)).mapInArrow(scan, HITS)


def top_k(vectors: DataFrame, k: int = 10, id_column: str = "vec_id", column: str = "embedding", query_filter: F.Column | None = None, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score for every vector that ``query_filter`` (on vec_id) selects, against all vectors."""
    spark = vectors.sparkSession
    base = codes(vectors, id_column, column, scale)
    index = PivotIndex(base)
    asked = base.filter(query_filter if query_filter is not None else F.lit(True)).dropDuplicates(["vec_id"])
    out = shared_folder(spark, "top-k")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    shape = "query_id long, rank int, vec_id long, score long"

    def answer(rows: list) -> None:
        ids = np.array([r.vec_id for r in rows], np.int64)
        block = np.zeros((len(rows), index.dims), np.int64)
        for i, r in enumerate(rows):
            block[i, : len(r.code)] = r.code
        hits = index.search(ids, block, k).withColumn("rank", rank).filter(F.col("rank") <= k)
        hits.select("query_id", F.col("rank").cast("int"), "vec_id", "score").write.mode("append").parquet(out)

    held: list = []
    done = False
    # Streams one partition at a time; a block of queries is all that the driver holds.
    for r in staged(asked, "top-k-queries").toLocalIterator():
        held.append(r)
        if len(held) == QUERY_BLOCK:
            answer(held)
            held, done = [], True
    if held:
        answer(held)
        done = True
    return spark.read.schema(shape).parquet(out) if done else spark.createDataFrame([], shape)
