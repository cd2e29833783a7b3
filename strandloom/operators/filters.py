"""The filter cascade: every record is counted once, at the first test that it fails."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config

REASONS = ("unmapped", "secondary_supplementary", "low_mapq", "low_qs", "no_RX", "umi_undecodable", "chimeric_umi_end")


def drop_reasons(records: DataFrame, config: Config) -> DataFrame:
    """``records`` with drop_reason, null for those that are used. Needs flag, tid, mapq, qs, rx, edits, has_sa, strand, clip5."""
    flag = F.col("flag")
    chimeric = F.col("has_sa") & (F.col("strand") != ".") & (F.col("clip5") > config.chimera_clip)
    return records.withColumn(
        "drop_reason",
        F.when((flag.bitwiseAND(4) != 0) | (F.col("tid") < 0), "unmapped")
        .when(flag.bitwiseAND(0x100 | 0x800) != 0, "secondary_supplementary")
        .when(F.col("mapq") < config.min_mapq, "low_mapq")
        .when(F.coalesce("qs", F.lit(0.0)) < config.min_qs, "low_qs")
        .when(F.col("rx").isNull(), "no_RX")
        .when(F.col("edits").isNull(), "umi_undecodable")
        .when(chimeric, "chimeric_umi_end"),
    )


def used(records: DataFrame, config: Config) -> DataFrame:
    return drop_reasons(records, config).filter("drop_reason is null").drop("drop_reason")
