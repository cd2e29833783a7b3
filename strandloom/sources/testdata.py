"""Alignment-like relations derived from the driver's events table; the same SQL runs in Spark and in DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import geometry as geo
from ..functions import umi
from ..operators import filters
from ..operators.graph import cut_lineage

READS_SQL = """
with e0 as (
  select event_id as ordinal, cast(floor(event_id / 4.0) as bigint) as mol, event_id % 4 as copy from events),
e1 as (
  select *, mol % 40 as g, (mol * 2654435761 + 12345) % 43046721 as u from e0),
e2 as (
  select *, g % 3 as tid,
    case when g % 7 = 6 then '.' when g % 2 = 0 then '+' else '-' end as strand,
    10000 + 5000 * g + 40 * ((mol * 13) % 5) as tss,
    (ordinal * 7) % 4 as jit, 300 + ((ordinal * 31) % 5) * 100 as span,
    case when copy = 0 then 9 else ordinal % 10 end as ec,
    case when ordinal % 13 = 0 then 2 else 0 end as wob,
    concat(substr('ACG', cast(((cast(floor(u / 1.0) as bigint) % 3) + 0) % 3 + 1 as int), 1),substr('ACG', cast(((cast(floor(u / 3.0) as bigint) % 3) + 0) % 3 + 1 as int), 1),substr('ACG', cast(((cast(floor(u / 9.0) as bigint) % 3) + 0) % 3 + 1 as int), 1),substr('ACG', cast(((cast(floor(u / 27.0) as bigint) % 3) + 0) % 3 + 1 as int), 1)) as t0, concat(substr('ACG', cast(((cast(floor(u / 81.0) as bigint) % 3) + 0) % 3 + 1 as int), 1),substr('ACG', cast(((cast(floor(u / 243.0) as bigint) % 3) + 0) % 3 + 1 as int), 1),substr('ACG', cast(((cast(floor(u / 729.0) as bigint) % 3) + 0) % 3 + 1 as int), 1),substr('ACG', cast(((cast(floor(u / 2187.0) as bigint) % 3) + 0) % 3 + 1 as int), 1)) as t1, concat(substr('ACG', cast(((cast(floor(u / 6561.0) as bigint) % 3) + 0) % 3 + 1 as int), 1),substr('ACG', cast(((cast(floor(u / 19683.0) as bigint) % 3) + 0) % 3 + 1 as int), 1),substr('ACG', cast(((cast(floor(u / 59049.0) as bigint) % 3) + 0) % 3 + 1 as int), 1),substr('ACG', cast(((cast(floor(u / 177147.0) as bigint) % 3) + 0) % 3 + 1 as int), 1)) as t2, concat(substr('ACG', cast(((cast(floor(u / 531441.0) as bigint) % 3) + 0) % 3 + 1 as int), 1),substr('ACG', cast(((cast(floor(u / 1594323.0) as bigint) % 3) + 0) % 3 + 1 as int), 1),substr('ACG', cast(((cast(floor(u / 4782969.0) as bigint) % 3) + 0) % 3 + 1 as int), 1),substr('ACG', cast(((cast(floor(u / 14348907.0) as bigint) % 3) + 0) % 3 + 1 as int), 1)) as t3,
    substr('ACG', cast(((cast(floor(u / 3.0) as bigint) % 3) + 1) % 3 + 1 as int), 1) as alt
  from e1)
select ordinal, mol, copy, g, tid, strand, ec,
  case when ordinal % 50 = 49 then 4 when ordinal % 50 = 48 then 256 when ordinal % 50 = 47 then 2048
       when strand = '-' then 16 else 0 end as flag,
  case when ordinal % 33 = 32 then 0 else 60 end as mapq,
  case when strand = '-' then tss + 900 - jit - span else tss + jit end as r_start,
  case when strand = '-' then tss + 900 - jit else tss + jit + span end as r_end,
  case when strand = '-' then tss + 750 + wob else tss + 150 + wob end as j_start,
  case when strand = '-' then tss + 850 + wob else tss + 250 + wob end as j_end,
  span - 100 as exonic_len,
  case when ordinal % 29 = 0 and ordinal % 2 = 0 then 250 else 3 end as clip5,
  ordinal % 29 = 0 as has_sa,
  cast(10 + ordinal % 20 as double) as qs,
  case when ordinal % 9 = 0 then -2 when ordinal % 9 = 1 then -1 else 60 + ordinal % 30 end as pt,
  concat(t0, t1, t2, t3) as umi_true,
  case when ordinal % 37 = 36 then null else concat(
    case when ec = 1 then 'TT' else 'TTT' end,
    case when ec = 5 then concat(substr(t0, 1, 1), alt, substr(t0, 3, 2)) else t0 end,
    case when ec = 3 then 'TTT' else 'TT' end, t1, 'TT',
    case when ec = 7 then concat(substr(t2, 1, 1), 'T', substr(t2, 3, 2)) else t2 end,
    'TT', t3, 'TTT') end as rx
from e2
"""

#: A block of four digits to base 3 as that SQL writes it, digit by digit, and all 81 blocks in the order of their numbers.
_DIGITS = re.compile(r"concat\((?:substr\('ACG', cast\(\(\(cast\(floor\(u / (\d+)\.0\) as bigint\) % 3\) \+ 0\) % 3 \+ 1 as int\), 1\),?){4}\)")
_BLOCKS = ", ".join(repr("".join("ACG"[n // 3**i % 3] for i in range(4))) for n in range(81))

#: Gene models: two exons for each of the 40 genes.
GENES = 40


def _spark_sql() -> str:
    """``READS_SQL`` in forms that take Spark less time for the same values.

    A block is looked up whole; its digits one by one were most of the time of a row. What DuckDB divides as doubles Spark
    would divide as decimals.
    """
    blocks = _DIGITS.sub(lambda m: f"element_at(array({_BLOCKS}), cast(u div {int(m[1]) // 27} % 81 as int) + 1)", READS_SQL)
    return re.sub(r"(?<= / )(\d+\.0)\b", r"\1D", blocks)


def raw_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    # What is derived from a file is not small as it is: as many parts as there are cores at least, all about the same size,
    # where a file's own are as uneven as its row groups.
    events = events.repartition(max(events.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism), "event_id")
    return spark.sql(_spark_sql().replace("from events)", "from {events})"), events=events)


def records(spark: SparkSession, sf_dir: str, config: Config) -> DataFrame:
    """The derived reads with geometry columns, decoded barcodes and keys (null where undecodable)."""
    # Decoded before the geometry is added: one generated method for all of it would be too long for the JVM to compile.
    raw = umi.decode(raw_reads(spark, sf_dir), "rx", config.max_umi_edits)
    start, end, strand = F.col("r_start").cast("long"), F.col("r_end").cast("long"), F.lit(".") if config.ignore_strand else F.col("strand")
    junction = F.struct(F.col("j_start").cast("long").alias("s"), F.col("j_end").cast("long").alias("e"))
    blocks = [F.col(f"b{k}") for k in range(4)]
    base = raw.select("ordinal", "mol", "g", "tid", strand.alias("strand"), "flag", "mapq", start.alias("start"), end.alias("end"), F.array(junction).alias("junctions"), "exonic_len", "clip5", "has_sa", "qs", "pt", "rx", "ec", "umi_true", *blocks, "edits")
    alt = geo.alt_anchor(F.col("strand"), F.col("start"), F.col("end"), F.col("junctions"), config.bridge_exon_max)
    shaped = base.withColumn("anchor", geo.anchor(F.col("strand"), F.col("start"), F.col("end"))).withColumn("_alt", alt).withColumn("alt_anchor", F.col("_alt.pos")).withColumn("alt_exon", F.col("_alt.exon")).drop("_alt")
    return shaped.withColumn("damaged", umi.is_damaged(blocks)).withColumn("umi_key", umi.packed_key(blocks, F.col("damaged")))


def used_reads(spark: SparkSession, sf_dir: str, config: Config) -> DataFrame:
    # Through a checkpoint: a filter on what is costly to derive would derive it again.
    return filters.used(cut_lineage(records(spark, sf_dir, config)), config)


def features(spark: SparkSession) -> DataFrame:
    """GTF-like features (line, tid, feature, start, end, strand, gene_id, tx_id) of the derived genes."""
    g = spark.range(GENES).select(F.col("id").alias("g"))
    strand = F.when(F.col("g") % 7 == 6, ".").when(F.col("g") % 2 == 0, "+").otherwise("-")
    rows = g.select("g", (F.col("g") % 3).alias("tid"), strand.alias("strand"), (10000 + 5000 * F.col("g")).alias("at"))
    exon = lambda k, lo, hi, tx: F.struct(F.lit(k).alias("k"), (F.col("at") + lo).alias("start"), (F.col("at") + hi).alias("end"), F.lit(tx).alias("tx"))
    # A long and a short transcript.
    out = rows.select("g", "tid", "strand", F.explode(F.array(exon(0, 0, 100, "T"), exon(1, 100, 150, "T"), exon(2, 250, 1000, "T"), exon(3, 0, 150, "S"), exon(4, 250, 450, "S"))).alias("x"))
    return out.select((F.col("g") * 5 + F.col("x.k")).alias("line"), "tid", F.lit("exon").alias("feature"), F.col("x.start").alias("start"), F.col("x.end").alias("end"), "strand", F.format_string("G%d", "g").alias("gene_id"), F.concat("x.tx", F.col("g").cast("string")).alias("tx_id"))
