"""Loci: gaps-and-islands of alignments per (tid, strand).

A read starts a new locus if its start is at or beyond the largest end before it plus ``pos_tol``. Reads with the same
start are one interval first, so a pile-up is one row. The running maximum over these is taken in two levels so that no
task sorts a whole chromosome: within bins of the start, seeded with the maximum of all earlier bins, which is a window
over one row per bin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BIN = 1 << 20


def loci(reads: DataFrame, pos_tol: int = 20, bin_size: int = BIN) -> DataFrame:
    """``reads`` with locus_id: the ordinal of the locus's first read by (start, ordinal)."""
    place = ["tid", "strand"]
    starts = reads.groupBy(*place, "start").agg(F.max("end").alias("end"), F.min("ordinal").alias("ordinal"))
    binned = starts.withColumn("_bin", F.floor(F.col("start") / bin_size))
    bins = binned.groupBy(*place, "_bin").agg(F.max("end").alias("_most"))
    earlier = F.max("_most").over(Window.partitionBy(*place).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))
    carried = bins.select(*place, "_bin", earlier.alias("_carry"))
    inner = Window.partitionBy(*place, "_bin").orderBy("start")
    before = F.greatest("_carry", F.max("end").over(inner.rowsBetween(Window.unboundedPreceding, -1)))
    marked = binned.join(carried, [*place, "_bin"]).withColumn("_before", before)
    opens = F.when(F.col("_before").isNull() | (F.col("start") >= F.col("_before") + pos_tol), F.col("ordinal"))
    marked = marked.withColumn("_opens", opens).withColumn("_last", F.last("_opens", ignorenulls=True).over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    # A bin's reads before its first opening belong to the last locus of the bins before.
    last = marked.groupBy(*place, "_bin").agg(F.max_by("_opens", F.when(F.col("_opens").isNotNull(), F.col("start"))).alias("_open"))
    open_before = F.last("_open", ignorenulls=True).over(Window.partitionBy(*place).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))
    opened = last.select(*place, "_bin", open_before.alias("_inherited"))
    found = marked.join(opened, [*place, "_bin"]).select(*place, "start", F.coalesce("_last", "_inherited").alias("locus_id"))
    return reads.join(found, [*place, "start"]).select(*[F.col(c) for c in reads.columns], "locus_id")
