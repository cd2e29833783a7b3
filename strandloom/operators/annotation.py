"""Gene models and their joins with molecules' representatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import overlap

BIN = 1 << 16


def exon_unions(exons: DataFrame) -> DataFrame:
    """(tid, gene_idx, s, e): exons (tid, gene_idx, s, e) of each gene with overlapping and touching ones merged."""
    w = Window.partitionBy("tid", "gene_idx").orderBy("s", "e")
    most = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = exons.withColumn("_new", F.coalesce((F.col("s") > most).cast("int"), F.lit(1)))
    island = opened.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy("tid", "gene_idx", "_island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("_island")


def genes(features: DataFrame) -> DataFrame:
    """(tid, gene_idx, gene_id, strand, start, end, exons) from features (line, tid, feature, start, end, strand, gene_id).

    Gene records override the spans of transcripts and exons; genes are numbered by their first line.
    """
    is_gene = F.col("feature") == "gene"
    spans = features.groupBy("tid", "gene_id").agg(
        F.min("line").alias("line"), F.coalesce(F.min_by("strand", F.when(is_gene, F.col("line"))), F.min_by("strand", "line")).alias("strand"),
        F.coalesce(F.min(F.when(is_gene, F.col("start"))), F.min("start")).alias("start"), F.coalesce(F.max(F.when(is_gene, F.col("end"))), F.max("end")).alias("end"),
    ).withColumn("gene_idx", F.col("line"))
    exons = features.filter("feature = 'exon'").join(spans.select("tid", "gene_id", "gene_idx"), ["tid", "gene_id"]).select("tid", "gene_idx", F.col("start").alias("s"), F.col("end").alias("e"))
    merged = exon_unions(exons).groupBy("tid", "gene_idx").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("exons"))
    return spans.join(merged, ["tid", "gene_idx"], "left").select("tid", "gene_idx", "gene_id", "strand", "start", "end", F.coalesce("exons", F.array().cast("array<struct<s:bigint,e:bigint>>")).alias("exons"))


def transcripts(features: DataFrame, table: DataFrame) -> DataFrame:
    """(tid, tx_id, gene_idx, start, end, exons, exonic_len): exons sorted and distinct; the gene of the first exon line."""
    exons = features.filter("feature = 'exon' and tx_id is not null")
    found = exons.groupBy("tid", "tx_id").agg(F.min_by("gene_id", "line").alias("gene_id"), F.array_sort(F.collect_set(F.struct(F.col("start").alias("s"), F.col("end").alias("e")))).alias("exons"))
    total = F.aggregate("exons", F.lit(0).cast("long"), lambda t, x: t + x["e"] - x["s"])
    sized = found.withColumn("start", F.col("exons")[0]["s"]).withColumn("end", F.array_max(F.transform("exons", lambda x: x["e"]))).withColumn("exonic_len", total)
    return sized.join(table.select("tid", "gene_id", "gene_idx"), ["tid", "gene_id"]).select("tid", "tx_id", "gene_idx", "start", "end", "exons", "exonic_len")


def introns(txs: DataFrame) -> DataFrame:
    """(tid, s, e): gaps between consecutive exons of any transcript."""
    gap = F.filter(F.zip_with(F.slice("exons", 1, F.greatest(F.size("exons") - 1, F.lit(0))), F.slice("exons", 2, F.greatest(F.size("exons") - 1, F.lit(0))), lambda a, b: F.struct(a["e"].alias("s"), b["s"].alias("e"))), lambda x: x["s"] < x["e"])
    return txs.filter(F.size("exons") > 1).select("tid", F.explode(gap).alias("x")).select("tid", F.col("x.s").alias("s"), F.col("x.e").alias("e")).distinct()


def _bins(start: Column, end: Column) -> Column:
    return F.explode(F.sequence(F.floor(start / BIN), F.floor((F.greatest(end, start + 1) - 1) / BIN)))


def gene_overlaps(reads: DataFrame, table: DataFrame) -> DataFrame:
    """(ordinal, gene_idx, gene_id) of the genes on the read's strand whose span and exons meet its blocks.

    reads: (ordinal, tid, strand, blocks). The range join is an equi-join on bins of the spans.
    """
    spans = reads.select("ordinal", "tid", "strand", "blocks", F.col("blocks")[0]["s"].alias("lo"), F.element_at("blocks", -1)["e"].alias("hi"))
    left = spans.withColumn("bin", _bins(F.col("lo"), F.col("hi")))
    right = table.select("tid", "gene_idx", "gene_id", F.col("strand").alias("g_strand"), F.col("start").alias("g_start"), F.col("end").alias("g_end"), "exons").withColumn("bin", _bins(F.col("g_start"), F.col("g_end")))
    same = (F.col("strand") == F.col("g_strand")) | (F.col("strand") == ".") | (F.col("g_strand") == ".")
    models = F.when(F.size("exons") > 0, F.col("exons")).otherwise(F.array(F.struct(F.col("g_start").cast("long").alias("s"), F.col("g_end").cast("long").alias("e"))))
    met = left.join(right, ["tid", "bin"]).filter(same & (F.col("g_start") < F.col("hi")) & (F.col("g_end") > F.col("lo")))
    # A pair that shares several bins is kept in the first of them.
    met = met.filter(F.col("bin") == F.floor(F.greatest("lo", "g_start") / BIN))
    return met.filter(overlap(F.col("blocks"), models) > 0).select("ordinal", "gene_idx", "gene_id")


def gene_labels(overlaps: DataFrame) -> DataFrame:
    """(ordinal, genes): ids joined by commas in the order of the annotation."""
    return overlaps.groupBy("ordinal").agg(F.array_sort(F.collect_set(F.struct("gene_idx", "gene_id"))).alias("g")).select("ordinal", F.array_join(F.transform("g", lambda x: x["gene_id"]), ",").alias("genes"))


def full_length(reads: DataFrame, overlaps: DataFrame, txs: DataFrame, coverage: float = 0.8, terminal: int = 25) -> DataFrame:
    """(ordinal, fl_tx): the longest transcript of an overlapped gene that the read covers, ties to gene and id order."""
    met = reads.select("ordinal", "tid", "blocks").join(overlaps.select("ordinal", "gene_idx"), "ordinal").join(txs, ["tid", "gene_idx"])
    first, last = F.array(F.col("exons")[0]), F.array(F.element_at("exons", -1))
    blocks = F.col("blocks")
    fits = (overlap(blocks, F.col("exons")) > coverage * F.col("exonic_len")) & (overlap(blocks, first) >= terminal) & (overlap(blocks, last) >= terminal)
    best = F.min_by("tx_id", F.struct((-F.col("exonic_len")).alias("n"), "gene_idx", "tx_id"))
    return met.filter(fits).groupBy("ordinal").agg(best.alias("fl_tx"))
