"""Loci as session windows: the genomic start is the event time and the gap follows each read's length.

Spark merges sessions that touch, whereas a locus ends where the next start equals the last end plus ``pos_tol``; hence
the gap is one shorter. The same expression serves batch and Structured Streaming; a stream must come in start order per
(tid, strand) within the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_loci(reads: DataFrame, pos_tol: int = 20, watermark: str | None = None) -> DataFrame:
    """(tid, strand, locus_start, locus_end, n_reads), one row per locus; reads: (tid, strand, start, end)."""
    timed = reads.select("tid", "strand", "start", "end", F.timestamp_seconds("start").alias("at"))
    if watermark:
        timed = timed.withWatermark("at", watermark)
    gap = F.concat((F.col("end") - F.col("start") + pos_tol - 1).cast("string"), F.lit(" seconds"))
    grouped = timed.groupBy("tid", "strand", F.session_window("at", gap))
    return grouped.agg(F.min("start").alias("locus_start"), F.max("end").alias("locus_end"), F.count("*").alias("n_reads")).select("tid", "strand", "locus_start", "locus_end", "n_reads")
