"""A corpus pipeline of five stages; each works on all that its predecessor kept.

Toxic documents go, one document of each group of near duplicates stays, documents that leak benchmark items go,
personal data become pseudonyms, and what is left is packed into sequences. All stages but the last return the columns
of documents, whatever further ones there are.

Defined results: an empty table gives an empty one in every stage. Toxicity judges each row by its text alone, a null or
empty one as a text without terms. Such texts belong to no group, leak nothing and have no personal data, and are packed
as an end id. Rows with a null id are neither near duplicates nor leaks. Rows that repeat an id go together as near
duplicates or leaks; of those with equal texts one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import decontaminate, neardup, packing, pii, toxicity
from strandloom.llm.common import free_name, read_table, staged

#: Ids of this number at most are broadcast for an anti join; above it the join is shuffled.
BROADCAST_IDS = 500_000


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id is in ``ids``; null ids stay."""
    ids = staged(ids.select(F.col("doc_id").alias("_gone")).distinct(), "rejected")
    gone = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.5 or more go; labels of held-out rows are not learned."""
    labels = read_table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(~toxicity.is_held_out("doc_id")))
    name = free_name("_toxicity", docs.columns)
    return toxicity.score(docs, model, name).filter(F.col(name) < 0.5).drop(name)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group stays (five-word shingles, similarity 0.8).

    Rows that repeat an id are one document: they stay or go together, and of those with equal texts one stays.
    Null ids and texts without words belong to no group and stay.
    """
    found = staged(neardup.near_duplicates(docs, words=5).select("doc_id", "kept"), "near-duplicates")
    kept = _without(docs, found.filter(~F.col("kept")))
    again = staged(found.filter("kept and doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated-ids")
    if not again.take(1):
        return kept
    of_again = again.withColumnRenamed("doc_id", "_again")
    repeated = kept.join(of_again, kept["doc_id"].cast("long") == of_again["_again"], "left_semi")
    return _without(kept, again).union(repeated.dropDuplicates(["doc_id", "text"]))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, decontaminate.leaks(docs, read_table(spark, sf_dir, "benchmark")))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name = free_name("_pii_kinds", docs.columns)
    out = pii.pseudonymise(docs, kinds_column=name)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.drop(name)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: The stages train a model, hash and permute: SQL cannot express them. tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, name)
    return docs
