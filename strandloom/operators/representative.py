"""The representative read of each molecule."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOLECULE = ["locus_id", "seed"]


def _longer() -> list:
    return [F.desc("exonic_len"), F.desc(F.coalesce("qs", F.lit(0.0))), F.asc("ordinal")]


def longest(reads: DataFrame) -> DataFrame:
    """(locus_id, seed, rep_ordinal, disagreements, same_chain, switched): the longest read."""
    rank = F.row_number().over(Window.partitionBy(*MOLECULE).orderBy(*_longer()))
    chain = F.count("*").over(Window.partitionBy(*MOLECULE, "junctions"))
    return reads.withColumn("_rank", rank).withColumn("same_chain", chain).filter("_rank = 1").select(*MOLECULE, F.col("ordinal").alias("rep_ordinal"), F.lit(0).cast("long").alias("disagreements"), "same_chain", F.lit(False).alias("switched"))


def junction_votes(reads: DataFrame, introns: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """(locus_id, seed, s, e, support, spanning, supported, bad) for every junction of every molecule."""
    # Dealt by molecule before junctions are counted: the counts are where the join wants them.
    dealt = reads.select(*MOLECULE, "tid", "junctions").repartition(*MOLECULE)
    carried = dealt.select(*MOLECULE, "tid", F.explode("junctions").alias("j")).select(*MOLECULE, "tid", F.col("j.s").alias("s"), F.col("j.e").alias("e"))
    support = carried.groupBy(*MOLECULE, "tid", "s", "e").agg(F.count("*").alias("support"))
    spans = support.join(reads.select(*MOLECULE, "start", "end"), MOLECULE)
    voted = spans.groupBy(*MOLECULE, "tid", "s", "e", "support").agg(F.count(F.when((F.col("start") <= F.col("s")) & (F.col("end") >= F.col("e")), 1)).alias("spanning"))
    if introns is not None:
        voted = voted.join(introns.select("tid", "s", "e").distinct().withColumn("annotated", F.lit(True)), ["tid", "s", "e"], "left").withColumn("annotated", F.coalesce("annotated", F.lit(False)))
    else:
        voted = voted.withColumn("annotated", F.lit(False))
    s, n = F.col("support"), F.col("spanning")
    alone = (s == 1) & ~F.col("annotated") & F.lit(strict)
    return voted.select(*MOLECULE, "s", "e", "support", "spanning", ((s >= 2) & (2 * s > n)).alias("supported"), ((2 * s < n) | alone).alias("bad"))


def consensus(reads: DataFrame, introns: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """As ``longest``, by junction votes: fewest penalties, then a poly(A) anchor, then no split alignment, then the longest.

    A read pays for each bad junction that it carries and each supported one that it spans but does not carry.
    """
    votes = junction_votes(reads, introns, strict)
    size = F.count("*").over(Window.partitionBy(*MOLECULE))
    rows = reads.withColumn("_size", size)
    alone = F.col("_size") == 1
    # All rows stay where their molecule is: those that no vote concerns come along without one, so nothing is joined back.
    kept = [*MOLECULE, "ordinal", "junctions", "_size", "pt", "has_sa", "exonic_len", "qs"]
    told = votes.filter("bad or supported").select(*[F.col(c).alias("_" + c) for c in MOLECULE], "s", "e", "bad", "supported")
    met = [F.col(c) == F.col("_" + c) for c in MOLECULE]
    judged = rows.select(*kept, "start", "end").join(told, [*met, F.col("_size") > 1], "left")
    has = F.exists("junctions", lambda j: (j["s"] == F.col("s")) & (j["e"] == F.col("e")))
    spans = (F.col("start") <= F.col("s")) & (F.col("end") >= F.col("e"))
    scored = judged.groupBy(*kept).agg(F.count(F.when(F.col("bad") & has | F.col("supported") & spans & ~has, 1)).alias("penalty"))
    order = [F.asc("penalty"), F.desc(F.coalesce("pt", F.lit(-2)) >= 0), F.asc("has_sa"), *_longer()]
    rank = F.row_number().over(Window.partitionBy(*MOLECULE).orderBy(*order))
    plain = F.row_number().over(Window.partitionBy(*MOLECULE).orderBy(*_longer()))
    chain = F.count("*").over(Window.partitionBy(*MOLECULE, "junctions"))
    out = scored.withColumn("_rank", rank).withColumn("_plain", plain).withColumn("same_chain", chain).filter("_rank = 1")
    return out.select(*MOLECULE, F.col("ordinal").alias("rep_ordinal"), F.when(alone, F.lit(0)).otherwise(F.col("penalty")).cast("long").alias("disagreements"), "same_chain", (F.col("_plain") != 1).alias("switched"))
