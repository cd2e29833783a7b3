"""The whole plan: from filtered reads to numbered and annotated molecules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.geometry import aligned_blocks
from ..operators import annotation, clusters, loci, molecules, nodes, representative
from ..operators.graph import cut_lineage


@dataclass
class Result:
    reads: DataFrame
    nodes: DataFrame
    placed: clusters.Placed
    assigned: DataFrame
    molecules: DataFrame


def annotated(found: DataFrame, assigned: DataFrame, features: DataFrame | None, config: Config) -> DataFrame:
    """``found`` with genes, fl (Y, N; null where not assessed) and fl_tx, by the blocks of the representatives."""
    if features is None:
        return found.withColumns({c: F.lit(None).cast("string") for c in ("genes", "fl", "fl_tx")})
    reps = assigned.join(found.select(F.col("rep_ordinal").alias("ordinal")), "ordinal")
    blocks = cut_lineage(reps.select("ordinal", "tid", "strand", aligned_blocks(F.col("start").cast("long"), F.col("end").cast("long"), F.transform("junctions", lambda j: F.struct(j["s"].cast("long").alias("s"), j["e"].cast("long").alias("e")))).alias("blocks")))
    table = cut_lineage(annotation.genes(features))
    overlaps = cut_lineage(annotation.gene_overlaps(blocks, table))
    out = found.join(annotation.gene_labels(overlaps).withColumnRenamed("ordinal", "rep_ordinal"), "rep_ordinal", "left")
    txs = cut_lineage(annotation.transcripts(features, table))
    if not config.full_length or not txs.take(1):
        return out.withColumns({c: F.lit(None).cast("string") for c in ("fl", "fl_tx")})
    calls = annotation.full_length(blocks, overlaps, txs, config.fl_cov, config.fl_terminal)
    return out.join(calls.withColumnRenamed("ordinal", "rep_ordinal"), "rep_ordinal", "left").withColumn("fl", F.when(F.col("fl_tx").isNull(), "N").otherwise("Y"))


def deduplicate(used: DataFrame, config: Config, features: DataFrame | None = None) -> Result:
    """``used``: filtered reads with ordinal, tid, strand, start, end, anchor, alt_anchor, alt_exon, clip5, junctions,
    exonic_len, qs, pt, has_sa, b0..b3, damaged, umi_key; ``features``: an annotation as ``read_gtf`` gives it."""
    # Each stage is read several times behind; checkpoints keep it from being computed again.
    placed = cut_lineage(loci.loci(used, config.pos_tol))
    reads, table = map(cut_lineage, nodes.nodes(placed, config))
    homes = clusters.place(table, config)
    assigned = cut_lineage(clusters.assign(reads, table, homes.homes))
    introns = None if features is None else cut_lineage(annotation.introns(annotation.transcripts(features, annotation.genes(features))))
    chosen = representative.longest(assigned) if config.rep == "longest" else representative.consensus(assigned, introns, not config.lenient_junctions)
    found = cut_lineage(molecules.number(molecules.summary(assigned).join(chosen, representative.MOLECULE)))
    return Result(reads, table, homes, assigned, cut_lineage(annotated(found, assigned, features, config)))
