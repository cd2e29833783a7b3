"""GTF annotation as a table of features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def attribute(column, key: str):
    """The quoted value of a whole key; null if it is missing or empty."""
    found = F.regexp_extract(column, f'(?:^|[ ;\t]){key} "([^"]*)"', 1)
    return F.when(found != "", found)


def read_gtf(spark: SparkSession, path: str, contigs: DataFrame) -> DataFrame:
    """(line, tid, feature, start, end, strand, gene_id, tx_id), 0-based half-open, from a text or gzip file.

    contigs: (name, tid); features on other contigs, malformed lines, empty spans and lines without gene_id go. The
    contig table is that of the alignment header, a few thousand rows at most.
    """
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id())
    parts = lines.filter("trim(value) <> '' and not startswith(value, '#')").withColumn("f", F.split("value", "\t", 9)).filter("size(f) = 9")
    rows = parts.select(
        "line", F.col("f")[0].alias("name"), F.col("f")[2].alias("feature"), (F.expr("try_cast(f[3] as bigint)") - 1).alias("start"), F.expr("try_cast(f[4] as bigint)").alias("end"),
        F.when(F.col("f")[6].isin("+", "-"), F.col("f")[6]).otherwise(".").alias("strand"), attribute(F.col("f")[8], "gene_id").alias("gene_id"), attribute(F.col("f")[8], "transcript_id").alias("tx_id"),
    )
    sound = rows.filter("feature in ('gene', 'transcript', 'exon') and start >= 0 and end > start and gene_id is not null")
    return sound.join(F.broadcast(contigs), "name").select("line", "tid", "feature", "start", "end", "strand", "gene_id", "tx_id")
