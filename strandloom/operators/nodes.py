"""Nodes: reads of one locus and barcode whose anchors are linked, with bridges over skipped short first exons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from .graph import cut_lineage, undirected_min

MIN_BRIDGE_CLIP = 5


def linked(reads: DataFrame, config: Config) -> DataFrame:
    """``reads`` with island: gaps-and-islands of anchors (gap <= pos_tol) per (locus, key), all one where positions are off."""
    w = Window.partitionBy("locus_id", "umi_key").orderBy("anchor", "ordinal")
    gap = F.col("anchor") - F.lag("anchor").over(w)
    # Positions count neither where the strand is unknown nor where they are switched off.
    opens = F.when((F.col("strand") == ".") | F.lit(not config.positions), F.lit(0)).otherwise((gap > config.pos_tol).cast("int"))
    return reads.withColumn("_opens", F.coalesce(opens, F.lit(0))).withColumn("island", F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_opens")


def bridges(reads: DataFrame, config: Config) -> DataFrame:
    """(locus_id, umi_key, a, b): islands that a skipped short first exon joins."""
    if not config.positions:
        return reads.select("locus_id", "umi_key", F.col("island").alias("a"), F.col("island").alias("b")).limit(0)
    # Bins as wide as the tolerance, so that only what is near meets, however deep a barcode is.
    width = max(1, config.pos_tol)
    bin_of = lambda c: F.floor(F.col(c) / width)
    alts = reads.filter("alt_anchor is not null and strand <> '.'").select("locus_id", "umi_key", F.col("island").alias("a"), "alt_anchor", "alt_exon").distinct()
    alts = alts.withColumn("_bin", bin_of("alt_anchor"))
    # Only reads that are clipped far enough can end a bridge. They are few, so it is these that are put in three bins.
    others = reads.filter(F.col("clip5") >= MIN_BRIDGE_CLIP).groupBy("locus_id", "umi_key", F.col("island").alias("b"), "anchor").agg(F.max("clip5").alias("clip5"))
    others = others.withColumn("_bin", F.explode(F.array(*[bin_of("anchor") + F.lit(i) for i in (-1, 0, 1)])))
    near = F.abs(F.col("anchor") - F.col("alt_anchor")) <= config.pos_tol
    clipped = F.col("clip5") >= F.greatest(F.floor(F.col("alt_exon") / 2), F.lit(MIN_BRIDGE_CLIP))
    return alts.join(others, ["locus_id", "umi_key", "_bin"]).filter(near & clipped & (F.col("a") != F.col("b"))).select("locus_id", "umi_key", "a", "b").distinct()


def nodes(reads: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    """(reads with node_id, nodes). node_id counts from 1 within the locus by key and first read."""
    joined = cut_lineage(linked(reads, config))
    edges = bridges(joined, config).withColumn("grp", F.struct("locus_id", "umi_key"))
    # Bridges are rare; without any the rounds of label propagation are left out.
    some = bool(joined.filter("alt_anchor is not null").take(1))
    if config.positions and some and edges.take(1):
        top = undirected_min(edges.select("grp", "a", "b")).select(F.col("grp.locus_id").alias("locus_id"), F.col("grp.umi_key").alias("umi_key"), F.col("node").alias("island"), F.col("label").alias("_top"))
        joined = joined.join(top, ["locus_id", "umi_key", "island"], "left").withColumn("component", F.coalesce("_top", "island")).drop("_top")
        islands = F.size(F.collect_set("island")).cast("long")
    else:
        joined, islands = joined.withColumn("component", F.col("island")), F.max(F.lit(1)).cast("long")
    alt = F.when(F.col("alt_anchor").isNotNull(), F.struct(F.col("alt_anchor").alias("pos"), F.col("alt_exon").alias("exon")))
    # The key tells the blocks and the damage, the locus the strand. As keys they leave numbers alone to be aggregated, which
    # takes no sort; sets of alternatives do, and are taken only where there are any.
    none = F.array().cast("array<struct<pos:bigint,exon:bigint>>")
    grouped = joined.groupBy("locus_id", "umi_key", "component", "b0", "b1", "b2", "b3", "damaged", "strand").agg(
        F.count("*").alias("cnt"), F.min("anchor").alias("amin"), F.max("anchor").alias("amax"), F.max("clip5").alias("max_clip5"), islands.alias("islands"), *([F.array_sort(F.collect_set(alt)).alias("_alts")] if some else []),
    )
    grouped = grouped if some else grouped.withColumn("_alts", none)
    # Sorted by position, then exon: the first of each position is its shortest exon.
    alts = F.filter("_alts", lambda x, i: (i == 0) | (F.get("_alts", i - 1)["pos"] != x["pos"]))
    # Numbered within ranges of keys (their highest block) and offset by the ranges before: a deep locus is many tasks.
    ranged = cut_lineage(grouped.withColumn("alts", alts).withColumn("_part", F.shiftright("umi_key", 45)).drop("_alts"))
    before = F.sum("n").over(Window.partitionBy("locus_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = ranged.groupBy("locus_id", "_part").agg(F.count("*").alias("n")).select("locus_id", "_part", F.coalesce(before, F.lit(0)).alias("_base"))
    ids = F.row_number().over(Window.partitionBy("locus_id", "_part").orderBy("umi_key", "amin"))
    table = ranged.withColumn("_inner", ids).join(offsets, ["locus_id", "_part"]).withColumn("node_id", (F.col("_base") + F.col("_inner")).cast("long")).drop("_part", "_inner", "_base")
    marked = joined.join(table.select("locus_id", "umi_key", "component", "node_id"), ["locus_id", "umi_key", "component"])
    return marked, table
