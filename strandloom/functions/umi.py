"""Barcodes: decoding, packed keys, distance, blocking masks and reach.

Clean tags are read by one pattern in the JVM, also where T is missing at their ends. Other tags are aligned to the 28-base pattern, once per distinct tag of a
task: the dynamic programme runs over its cells in a loop and over the tags of an Arrow batch as vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the tag format: V stands for A, C or G; blocks of four V between anchors of T.
PATTERN = "TTTVVVVTTVVVVTTVVVVTTVVVVTTT"
#: What is missing of the outer T is free. Each missing base costs at least that, so no alignment of these is better, and
#: none is as good: the first base of a block tells how many T are missing before it.
CLEAN = "^T{0,3}[ACG]{4}TT[ACG]{4}TT[ACG]{4}TT[ACG]{4}T{0,3}$"
BLOCKS = ((3, 7), (9, 13), (15, 19), (21, 25))
EDIT, MAX_LENGTH, MAX_BLOCK = 32, 48, 6
#: Numbers of barcodes within d edits, of 3^16.
BALL = (1, 33, 513, 4993)
SPACE = 3**16
#: Tags of a task that are remembered.
MAX_SEEN = 200_000
#: Rows whose tags are aligned at once: the loop over the cells costs the same for few tags as for some thousands.
AT_ONCE = 80_000


def _block_of_base() -> list[int]:
    return [next((k for k, (s, e) in enumerate(BLOCKS) if s <= j < e), -1) for j in range(len(PATTERN))]


def _gaps() -> list[tuple[str, int]]:
    """For each gap of the pattern: inside a block, at a block's boundary or between anchors; and the block."""
    of = [-1, *_block_of_base(), -1]
    out = []
    for j in range(len(PATTERN) + 1):
        a, b = of[j], of[j + 1]
        out.append(("block", a) if a == b >= 0 else ("boundary", max(a, b)) if max(a, b) >= 0 else ("anchor", -1))
    return out


def align(tags: list[str], max_edits: int = 5) -> list[tuple | None]:
    """(b0, b1, b2, b3, edits) of each upper-case tag, or None where it cannot be decoded."""
    out: list[tuple | None] = [None] * len(tags)
    by_length: dict[int, list[int]] = {}
    for i, t in enumerate(tags):
        n = len(t)
        if n and n <= min(MAX_LENGTH, len(PATTERN) + max_edits) and n + 6 + max_edits >= len(PATTERN):
            by_length.setdefault(n, []).append(i)
    of, gaps, p = _block_of_base(), _gaps(), len(PATTERN)
    for n, rows in by_length.items():
        x = np.array([[ord(c) for c in tags[i].encode("ascii", "replace").decode()] for i in rows], np.int32)
        is_t = x == ord("T")
        in_v = (x == ord("A")) | (x == ord("C")) | (x == ord("G"))
        cost = np.full((n + 1, p + 1, len(rows)), 1 << 29, np.int32)
        how = np.zeros((n + 1, p + 1, len(rows)), np.uint8)
        cost[0, 0] = 0
        for i in range(n + 1):
            for j in range(p + 1):
                if not i and not j:
                    continue
                best, step = np.full(len(rows), 1 << 29, np.int32), np.zeros(len(rows), np.uint8)
                if i and j:
                    match = in_v[:, i - 1] if of[j - 1] >= 0 else is_t[:, i - 1]
                    best = cost[i - 1, j - 1] + np.where(match, 0, EDIT + (1 if of[j - 1] >= 0 else 3))
                if i:
                    where = gaps[j][0]
                    extra = np.where(is_t[:, i - 1], 2 if where == "block" else 0, 2 if where == "anchor" else 1)
                    c = cost[i - 1, j] + EDIT + extra
                    step = np.where(c < best, 1, step).astype(np.uint8)
                    best = np.minimum(best, c)
                if j:
                    free = (i == 0 and j - 1 < 3) or (i == n and j - 1 >= p - 3)
                    c = cost[i, j - 1] + (1 if free else EDIT + (1 if of[j - 1] >= 0 else 0))
                    step = np.where(c < best, 2, step).astype(np.uint8)
                    best = np.minimum(best, c)
                cost[i, j], how[i, j] = best, step
        for k, row in enumerate(rows):
            i, j, edits, blocks, tag = n, p, 0, ["", "", "", ""], tags[row]
            while i or j:
                step = how[i, j, k]
                if step == 0:
                    i, j = i - 1, j - 1
                    base, b = tag[i], of[j]
                    edits += base not in "ACG" if b >= 0 else base != "T"
                    if b >= 0:
                        blocks[b] = base + blocks[b]
                elif step == 1:
                    i, edits = i - 1, edits + 1
                    where, b = gaps[j]
                    if where == "block" or where == "boundary" and tag[i] != "T":
                        blocks[b] = tag[i] + blocks[b]
                else:
                    j -= 1
                    edits += not ((i == 0 and j < 3) or (i == n and j >= p - 3))
            if edits <= max_edits and all(0 < len(b) <= MAX_BLOCK and set(b) <= set("ACGT") for b in blocks):
                out[row] = (*blocks, int(edits))
    return out


def decode(records: DataFrame, column: str = "rx", max_edits: int = 5) -> DataFrame:
    """``records`` with b0..b3 and edits from the tag in ``column``; nulls where it is missing or undecodable.

    One pass over the input: only the tags that are not clean go through Python, a column of an Arrow batch at a time.
    """
    @F.pandas_udf("b0 string, b1 string, b2 string, b3 string, edits int")
    def aligned(tags: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        seen: dict[str, tuple | None] = {}
        nothing = (None,) * 5

        def read(batches: list[pd.Series]) -> pd.DataFrame:
            at, distinct = pd.factorize(pd.concat(batches, ignore_index=True))
            new = [t for t in distinct if t not in seen]
            if len(seen) > MAX_SEEN:
                seen.clear()
                new = list(distinct)
            seen.update(zip(new, align(new, max_edits), strict=True))
            # What is missing or clean is at -1, the last.
            found = pd.DataFrame([*[seen.get(t) or nothing for t in distinct], nothing], columns=["b0", "b1", "b2", "b3", "edits"]).astype({"edits": "Int32"})
            return found.take(at).reset_index(drop=True)

        held: list[pd.Series] = []
        for batch in tags:
            held.append(batch)
            if sum(map(len, held)) >= AT_ONCE:
                yield read(held)
                held = []
        if held:
            yield read(held)

    # Asked once for each tag, not by every column.
    tagged = records.withColumn("_tag", F.upper(F.col(column))).withColumn("_clean", F.col("_tag").rlike(CLEAN))
    tagged = tagged.withColumn("_inner", F.when(F.col("_clean"), F.ltrim("_tag", F.lit("T"))))
    hard = tagged.withColumn("_hard", aligned(F.when(~F.col("_clean"), F.col("_tag"))))
    block = lambda k: F.when(F.col("_clean"), F.substring("_inner", 1 + 6 * k, 4)).otherwise(F.col("_hard")[f"b{k}"])
    return hard.select(*[F.col(c) for c in records.columns], *[block(k).alias(f"b{k}") for k in range(4)], F.when(F.col("_clean"), F.lit(0)).otherwise(F.col("_hard")["edits"]).alias("edits"))


def is_damaged(blocks: list[Column]) -> Column:
    out = F.lit(False)
    for b in blocks:
        out = out | b.contains("T") | (F.length(b) != 4)
    return out


def packed_key(blocks: list[Column], damaged: Column) -> Column:
    """The 61-bit key: per block its length, then its bases (the first lowest); block 3 highest; then the damage bit."""
    # A fold over the blocks instead of four terms: written out, they make the generated method of a stage so long that the JVM
    # only interprets it. The bases are digits to base 4, the first one last.
    value = lambda b: F.length(b).cast("long") * 4096 + F.conv(F.translate(F.reverse(b), "ACGT", "0123"), 4, 10).cast("long")
    folded = F.aggregate(F.array(*reversed(blocks)), F.lit(0).cast("long"), lambda total, b: total * (1 << 15) + value(b))
    return F.when(damaged, F.lit(1 << 60)).otherwise(F.lit(0).cast("long")) + folded


def distance(a: list[Column], b: list[Column]) -> Column:
    out = F.lit(0)
    for x, y in zip(a, b, strict=True):
        out = out + F.levenshtein(x, y)
    return out


def reach(most: int, density: Column, budget: float) -> Column:
    """The largest distance at which a chance hit among ``density`` barcodes stays within the budget."""
    fits = lambda d: density.cast("double") * BALL[d] / float(SPACE) <= budget
    out = F.lit(min(most, 1))
    for d in range(2, min(most, 3) + 1):
        out = F.when(fits(d), F.lit(d)).otherwise(out)
    return out


def masks(kept: int) -> list[tuple[int, ...]]:
    """All ways to keep ``kept`` of the four blocks."""
    return list(combinations(range(4), kept))
