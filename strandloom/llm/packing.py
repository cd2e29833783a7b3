"""Bulk-synchronous best-fit packing of token sequences.

Documents longer than a sequence are cut into whole sequences and a rest; every piece keeps together. Pieces of equal
length are interchangeable and so are gaps of equal size, so the sorted pieces and gaps are kept as runs (length, first
rank, count) and (room, first sequence, count), dealt out by ranges of their size. One round sweeps every range in a task
of its own, in size order: each gap is matched with the longest unmatched piece that it can hold, which makes it that
piece's nearest free successor; where several want the same, ranks decide: the k-th piece of a run takes the k-th gap of a
run. The range sweeps on over its updated gaps until none of its pieces fits one, and gaps that became smaller than the
range go to another. Rounds follow one another until no range finds a match; then one round goes over all ranges
together, for pieces whose next gap lies in a higher range; and if that finds none either, as many sequences as the
tokens that are left need at least are opened with the longest pieces.

Between rounds the runs are a table in the shared folder, so a lost executor costs a round. Lengths lie between 1 and
``max_tokens``, so the number of runs and of rounds is bounded by that parameter and not by the corpus. What grows with
the corpus is distributed by rows: encoding, counting lengths, the rank of each piece (salted, so that one very common
length is spread) and the placing.

Defined results: null and empty texts have the end id alone; an empty table gives no rows; rows with the same
``doc_id`` are packed as documents of their own; other columns are ignored.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, parallelism, staged
from .tokens import default_vocabulary, encoder

MAX_TOKENS = 4096
ITEM, GAP, PLACED = 0, 1, 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(docs: DataFrame, vocabulary: str, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """A row per piece of each document's ids: doc_id, piece, start, length, ids_crc32."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.frombuffer(enc.document(text.as_py()), enc.dtype)
                for i, start in enumerate(range(0, len(ids), max_tokens)):
                    part = ids[start : start + max_tokens]
                    rows.append((doc_id, i, start, len(part), zlib.crc32(part.astype("<u4").tobytes())))
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        enc.forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(pieces), PIECES)


def sweep(items: list[list[int]], gaps: list[tuple[int, int, int]]) -> tuple[list[tuple], list[list[int]], list[tuple[int, int, int]]]:
    """One round. items: [length, first rank, count]; gaps: (room, first sequence, count).

    Returns matches (length, first rank, count, room, first sequence), the items left, and the gaps that got none.
    """
    order = sorted([(length, 0, rank, n) for length, rank, n in items] + [(room, 1, seq, n) for room, seq, n in gaps])
    stack: list[list[int]] = []
    matches, unused = [], []
    for size, is_gap, first, n in order:
        if not is_gap:
            stack.append([size, first, n])
            continue
        while n and stack:
            top = stack[-1]
            k = min(n, top[2])
            # The last of the run go first, so that what is left of it still begins at its first rank.
            matches.append((top[0], top[1] + top[2] - k, k, size, first))
            top[2] -= k
            first, n = first + k, n - k
            if not top[2]:
                stack.pop()
        if n:
            unused.append((size, first, n))
    return matches, stack, unused


def settle(state: pa.Table) -> pa.Table:
    """A range's rounds: sweeps over its runs until none of its pieces fits one of its gaps.

    state: (kind, size, first, n, seq, room, lowest); returns the runs that are left (kind 0 pieces, 1 gaps) and those
    placed (2: length, first rank, count, first sequence, room that they found).
    """
    rows = list(zip(*(state.column(c).to_pylist() for c in ("kind", "size", "first", "n")), strict=True))
    lowest = state.column("lowest")[0].as_py()
    items = sorted([size, first, n] for kind, size, first, n in rows if kind == ITEM)
    gaps = [(size, first, n) for kind, size, first, n in rows if kind == GAP]
    out, gone = [], []
    while True:
        matches, items, gaps = sweep(items, gaps)
        for length, rank, n, room, seq in matches:
            out.append((PLACED, length, rank, n, seq, room))
            if room > length:
                (gaps if room - length >= lowest else gone).append((room - length, seq, n))
        if not matches:
            break
    out += [(ITEM, length, rank, n, 0, 0) for length, rank, n in items] + [(GAP, room, seq, n, 0, 0) for room, seq, n in gaps + gone]
    columns = list(zip(*out, strict=True)) or [()] * 6
    return pa.table([pa.array(list(c), pa.int64()) for c in columns], names=["kind", "size", "first", "n", "seq", "room"])


def opened(state: DataFrame, need: int, sequences: int, max_tokens: int) -> DataFrame:
    """``need`` sequences opened with the longest pieces. A window over all runs: they are bounded by max_tokens."""
    before = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("size"), F.desc("first")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    items = state.filter(F.col("kind") == ITEM).withColumn("before", before).withColumn("k", F.greatest(F.lit(0), F.least("n", F.lit(need) - F.col("before"))))
    row = lambda kind, size, first, n, seq, room: F.struct(F.lit(kind).cast("long").alias("kind"), size.alias("size"), first.alias("first"), n.alias("n"), seq.alias("seq"), room.alias("room"))
    none, seq, k, size = F.lit(0).cast("long"), F.col("before") + sequences, F.col("k"), F.col("size")
    whole = F.lit(max_tokens).cast("long")
    made = F.array(row(ITEM, size, F.col("first"), F.col("n") - k, none, none), row(GAP, whole - size, seq, k, none, none), row(PLACED, size, F.col("first") + F.col("n") - k, k, seq, whole))
    new = items.select(F.explode(made).alias("x")).select("x.*").filter((F.col("n") > 0) & (F.col("size") > 0))
    return state.filter(F.col("kind") == GAP).select(new.columns).union(new)


def places(lengths: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """(length, rank, n, seq, offset): places by runs, for pieces counted by (length, n)."""
    zero = F.lit(0).cast("long")
    state = staged(lengths.select(zero.alias("kind"), F.col("length").cast("long").alias("size"), zero.alias("first"), F.col("n").cast("long").alias("n"), zero.alias("seq"), zero.alias("room")), "packing-runs")
    # Ranges halve, as most gaps and documents are small.
    cuts = [c for c in (max_tokens >> 3, max_tokens >> 2, max_tokens >> 1) if c > 1]
    part = sum((F.col("size") >= c).cast("int") for c in cuts) if cuts else F.lit(0)
    lowest = F.element_at(F.array(*[F.lit(c).cast("long") for c in (1, *cuts)]), F.col("part") + 1)
    # Each range on its own, all together, more sequences: the first of these again after every match.
    apart, together, more = range(3)
    done, sequences, step = [state.limit(0)], 0, together
    item = F.col("kind") == ITEM
    while True:
        # All that a round needs to know, in one job.
        left = state.agg(F.sum(F.when(item, F.col("n"))).alias("n"), F.sum(F.when(item, F.col("n") * F.col("size"))).alias("tokens"), F.count(F.when(F.col("kind") == PLACED, 1)).alias("placed")).first()
        if not left.n:
            break
        step = apart if left.placed else step + 1
        if step == more:
            need = min(left.n, -(-left.tokens // max_tokens))
            state = staged(opened(state.filter(F.col("kind") != PLACED), need, sequences, max_tokens), "packing-runs")
            sequences += need
        else:
            dealt = state.filter(F.col("kind") != PLACED).withColumn("part", F.lit(0) if step == together else part).withColumn("lowest", lowest)
            state = staged(dealt.groupBy("part").applyInArrow(settle, "kind long, size long, first long, n long, seq long, room long"), "packing-runs")
        done.append(state)
    placed = functools.reduce(DataFrame.union, done).filter(F.col("kind") == PLACED)
    return placed.select(F.col("size").alias("length"), F.col("first").alias("rank"), "n", "seq", (F.lit(max_tokens) - F.col("room")).cast("long").alias("offset"))


def pack(docs: DataFrame, vocabulary: str | None = None, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row per piece, sequences gapless from offset 0."""
    spark = docs.sparkSession
    pieces = staged(cut(docs, vocabulary or default_vocabulary(), max_tokens), "packing-pieces")
    found = places(pieces.groupBy("length").agg(F.count("*").alias("n")), max_tokens)
    # At most max_tokens rows with a few runs each, whatever the corpus.
    runs = found.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("rank", "seq", "offset"))).alias("runs"))

    salt = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parallelism(spark)))
    salted = pieces.withColumn("salt", salt)
    inner = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    bases = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(before, F.lit(0)).alias("base"))
    ranked = salted.withColumn("inner", inner).join(bases, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("inner") - 1)
    run = F.element_at(F.filter("runs", lambda x: x["rank"] <= F.col("rank")), -1)
    return (
        ranked.join(F.broadcast(runs), "length")
        .withColumn("run", run)
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("run.seq") + F.col("rank") - F.col("run.rank")).alias("sequence_id"), F.col("run.offset").alias("offset"))
    )
