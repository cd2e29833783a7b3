"""Facts of molecules, numbering, filtered and marked outputs, and the run report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.geometry import floor_median, pct
from .filters import REASONS
from .graph import cut_lineage
from .representative import MOLECULE

#: The rows of the run report in order.
METRICS = (
    "total_records", "dropped_unmapped", "dropped_secondary_supplementary", "dropped_low_mapq", "dropped_low_qs", "dropped_no_RX", "dropped_umi_undecodable", "dropped_chimeric_umi_end",
    "umi_clean", "umi_anchor_repaired", "umi_block_damaged", "umi_block_damaged_pct", "strand_from_TS", "strand_from_ts", "strand_unknown", "reads_used", "bundles", "max_bundle_reads",
    "umi_nodes", "umi_nodes_damaged", "umi_position_splits", "short_exon_bridges", "directional_merges", "density_gated_edges", "damaged_to_valid", "damaged_attached_beyond_1_edit",
    "damaged_to_damaged", "damaged_seeds", "molecules_out", "pcr_duplicate_reads", "pcr_duplicate_pct", "singleton_molecules", "cluster_size_p50", "cluster_size_p90", "cluster_size_max",
    "rep_switched_by_consensus", "rep_disagreements", "full_length_molecules", "full_length_pct", "polya_anchor_molecules", "polya_anchor_pct", "polya_missing_tag_molecules", "full_length_both_signals", "records_written",
)


def summary(reads: DataFrame) -> DataFrame:
    """Pooled facts: tid, strand, anchor (median), n_reads, poly(A) call and length."""
    pt = F.coalesce("pt", F.lit(-2))
    return reads.groupBy(*MOLECULE).agg(
        F.first("tid").alias("tid"), F.first("strand").alias("strand"), F.first("molecule_umi").alias("umi"), F.first("umi_damaged").alias("umi_damaged"), F.count("*").alias("n_reads"),
        floor_median(F.col("anchor")).alias("anchor"),
        F.when(F.max(pt) >= 0, "Y").when(F.max(pt) == -1, "N").otherwise("?").alias("polya"), floor_median(F.when(pt > 0, pt)).alias("polya_len"),
    )


def number(molecules: DataFrame, per: int = 1 << 20) -> DataFrame:
    """``molecules`` with mi: 1..N by rep_ordinal. Ranks are taken within ranges of ordinals and offset by the ranges before."""
    # Read twice, for the ranges' sizes and for the ranks.
    binned = cut_lineage(molecules).withColumn("_bin", F.floor(F.col("rep_ordinal") / per))
    before = F.sum("n").over(Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))
    # One row per range of ordinals.
    offsets = binned.groupBy("_bin").agg(F.count("*").alias("n")).select("_bin", F.coalesce(before, F.lit(0)).alias("_base"))
    inner = F.row_number().over(Window.partitionBy("_bin").orderBy("rep_ordinal"))
    return binned.withColumn("_inner", inner).join(offsets, "_bin").withColumn("mi", (F.col("_base") + F.col("_inner")).cast("long")).drop("_bin", "_inner", "_base")


def filter_mode(records: DataFrame, molecules: DataFrame) -> DataFrame:
    """Representatives only, flags untouched, with their molecule's number, barcode and size."""
    facts = molecules.select(F.col("rep_ordinal").alias("ordinal"), "mi", "umi", "n_reads")
    return records.join(facts, "ordinal")


def mark_mode(records: DataFrame, assigned: DataFrame, molecules: DataFrame, had_stale: str | None = None) -> DataFrame:
    """All records: representatives without the duplicate flag, other members with it, the rest as they are.

    Records outside molecules that carry marks of an earlier run (``had_stale``) lose the flag.
    """
    member = assigned.select("ordinal", *MOLECULE).join(molecules.select(*MOLECULE, "mi", "rep_ordinal", "umi", "n_reads"), MOLECULE)
    joined = records.join(member.select("ordinal", "mi", "rep_ordinal", "umi", "n_reads"), "ordinal", "left")
    is_rep = F.col("ordinal") == F.col("rep_ordinal")
    cleared, raised = F.col("flag").bitwiseAND(F.lit(~1024)), F.col("flag").bitwiseOR(F.lit(1024))
    stale = F.col(had_stale) if had_stale else F.lit(False)
    return joined.withColumn("flag", F.when(is_rep, cleared).when(F.col("mi").isNotNull(), raised).when(stale, cleared).otherwise(F.col("flag"))).withColumn("is_rep", F.coalesce(is_rep, F.lit(False))).drop("rep_ordinal")


def size_percentiles(sizes: DataFrame, quantiles=(0.5, 0.9)) -> DataFrame:
    """One row with p50, p90 ... and max by nearest rank ``round((n - 1) q)`` of sorted ``n_reads``."""
    hist = sizes.groupBy("n_reads").agg(F.count("*").alias("k"))
    # One row per distinct size.
    ran = hist.withColumn("upto", F.sum("k").over(Window.orderBy("n_reads"))).withColumn("total", F.sum("k").over(Window.partitionBy()))
    rank = lambda q: F.floor((F.col("total") - 1) * F.lit(q) + F.lit(0.5))
    return ran.agg(*[F.coalesce(F.min(F.when(F.col("upto") > rank(q), F.col("n_reads"))), F.lit(0)).alias(f"p{round(q * 100)}") for q in quantiles], F.coalesce(F.max("n_reads"), F.lit(0)).alias("max"))


def report(reasons: DataFrame, done, config: Config) -> DataFrame:
    """(line, metric, value): the rows of the run report in order; values as text, percentages with at most two decimals.

    reasons: all records with drop_reason; done: the ``Result`` of the plan. Every aggregate is one row.
    """
    n = lambda c: F.count(F.when(c, 1))
    zero = F.lit(0).cast("long")
    polya = lambda c: n(F.col("polya") == c) if config.full_length else F.max(zero)
    parts = [
        reasons.agg(F.count("*").alias("total_records"), *[n(F.col("drop_reason") == r).alias(f"dropped_{r}") for r in REASONS]),
        done.reads.agg(
            n(F.col("edits") == 0).alias("umi_clean"), n((F.col("edits") > 0) & ~F.col("damaged")).alias("umi_anchor_repaired"), n((F.col("edits") > 0) & F.col("damaged")).alias("umi_block_damaged"),
            n(F.col("strand_source") == "TS").alias("strand_from_TS"), n(F.col("strand_source") == "ts").alias("strand_from_fallback"), n(F.col("strand_source") == "unknown").alias("strand_unknown"), F.count("*").alias("reads_used")),
        done.reads.groupBy("locus_id").count().agg(F.count("*").alias("bundles"), F.coalesce(F.max("count"), zero).alias("max_bundle_reads")),
        done.nodes.agg(F.count("*").alias("umi_nodes"), n(F.col("damaged")).alias("umi_nodes_damaged"), (F.count("*") - F.countDistinct("locus_id", "umi_key")).alias("umi_position_splits"), (F.sum("islands") - F.count("*")).alias("short_exon_bridges")),
        done.placed.clusters.agg(n(F.col("node_id") != F.col("seed")).alias("directional_merges")),
        done.placed.edges.filter("dist >= 2").agg(F.countDistinct("locus_id", F.least("src", "dst"), F.greatest("src", "dst")).alias("density_gated_edges")),
        done.placed.parents.agg(F.count("*").alias("damaged_to_valid"), n(F.col("dist") >= 2).alias("damaged_attached_beyond_1_edit")),
        done.placed.leftovers.agg(n(F.col("node_id") != F.col("seed")).alias("damaged_to_damaged"), n(F.col("node_id") == F.col("seed")).alias("damaged_seeds")),
        done.molecules.agg(
            F.count("*").alias("molecules_out"), n(F.col("n_reads") == 1).alias("singleton_molecules"), F.sum(F.col("switched").cast("long")).alias("rep_switched_by_consensus"), F.sum("disagreements").alias("rep_disagreements"),
            n(F.col("fl") == "Y").alias("full_length_molecules"), polya("Y").alias("polya_anchor_molecules"), polya("?").alias("polya_missing_tag_molecules"),
            (n((F.col("fl") == "Y") & (F.col("polya") == "Y"))).alias("full_length_both_signals")),
        size_percentiles(done.molecules).select(F.col("p50").alias("cluster_size_p50"), F.col("p90").alias("cluster_size_p90"), F.col("max").alias("cluster_size_max")),
    ]
    row = parts[0]
    for part in parts[1:]:
        row = row.crossJoin(part)
    used, out = F.col("reads_used"), F.col("molecules_out")
    row = row.withColumn("pcr_duplicate_reads", used - F.least(out, used)).withColumn("records_written", F.col("total_records") if config.mode == "mark" else out)
    shares = {
        "umi_block_damaged_pct": pct(F.col("umi_block_damaged"), F.col("umi_clean") + F.col("umi_anchor_repaired") + F.col("umi_block_damaged")), "pcr_duplicate_pct": pct(F.col("pcr_duplicate_reads"), used),
        "full_length_pct": pct(F.col("full_length_molecules"), out), "polya_anchor_pct": pct(F.col("polya_anchor_molecules"), out - F.col("polya_missing_tag_molecules")),
    }
    row = row.withColumns(shares)
    # Column names do not tell upper from lower case.
    held = lambda c: "strand_from_fallback" if c == "strand_from_ts" else c
    value = lambda c: F.regexp_replace(F.format_string("%.2f", F.col(c)), r"\.?0+$", "") if c in shares else F.coalesce(F.col(held(c)), zero).cast("string")
    return row.select(F.explode(F.array(*[F.struct(F.lit(i).alias("line"), F.lit(c).alias("metric"), value(c).alias("value")) for i, c in enumerate(METRICS, 1)])).alias("x")).select("x.*")
