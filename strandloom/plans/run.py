"""A whole run: alignment files and an annotation in, filtered or marked alignments, molecules and the report out."""

from __future__ import annotations

import argparse
import logging
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import geometry as geo
from ..functions import umi
from ..operators import filters, molecules
from ..operators.graph import cut_lineage
from ..sources import bam, gtf
from .pipeline import Result, deduplicate

NAME, VERSION = "strandloom", "1"
log = logging.getLogger(NAME)


def features(records: DataFrame, config: Config) -> DataFrame:
    """Records as ``read_bam`` gives them, with what filters and the plan need; ``raw`` is not carried."""
    reverse = F.col("flag").bitwiseAND(16) != 0
    first, second = geo.genomic_strand(F.col("ts_dorado"), reverse), geo.genomic_strand(F.col("ts_mm2"), reverse)
    strand = F.lit(".") if config.ignore_strand else geo.resolved_strand(F.col("ts_dorado"), F.col("ts_mm2"), reverse)
    source = F.lit("unknown") if config.ignore_strand else F.when(first != ".", "TS").when(second != ".", "ts").otherwise("unknown")
    shaped = records.drop("raw").withColumn("g", geo.geometry(F.col("pos"), F.col("cigar"))).withColumn("strand", strand).withColumn("strand_source", source)
    shaped = shaped.withColumns({"start": F.col("g.start").cast("long"), "end": F.col("g.end").cast("long"), "exonic_len": F.col("g.exonic_len"), "junctions": F.transform("g.junctions", lambda j: F.struct(j["s"].cast("long").alias("s"), j["e"].cast("long").alias("e")))})
    shaped = shaped.withColumns({"clip5": geo.clip5(F.col("strand"), F.col("g.left"), F.col("g.right")), "anchor": geo.anchor(F.col("strand"), F.col("start"), F.col("end")), "_alt": geo.alt_anchor(F.col("strand"), F.col("start"), F.col("end"), F.col("junctions"), config.bridge_exon_max)})
    shaped = shaped.withColumns({"alt_anchor": F.col("_alt.pos"), "alt_exon": F.col("_alt.exon"), "qs": F.col("qs").cast("float"), "pt": F.coalesce("pt", F.lit(-2))}).drop("_alt", "g", "cigar")
    decoded = umi.decode(shaped, "rx", config.max_umi_edits)
    blocks = [F.col(f"b{k}") for k in range(4)]
    return decoded.withColumn("damaged", umi.is_damaged(blocks)).withColumn("umi_key", umi.packed_key(blocks, F.col("damaged")))


def require_order(used: DataFrame, per: int = 1 << 20) -> None:
    """Used reads must come by (tid, start): within ranges of ordinals, and from range to range."""
    at = F.struct("tid", "start")
    ranged = used.select("ordinal", at.alias("at"), F.floor(F.col("ordinal") / per).alias("part"))
    inner = ranged.filter("at is not null").withColumn("before", F.lag("at").over(Window.partitionBy("part").orderBy("ordinal"))).filter("at < before")
    ends = ranged.groupBy("part").agg(F.min_by("at", "ordinal").alias("first"), F.max_by("at", "ordinal").alias("last"))
    # One row per range of ordinals.
    across = ends.withColumn("before", F.lag("last").over(Window.orderBy("part"))).filter("first < before")
    if inner.take(1) or across.take(1):
        raise ValueError("input is not coordinate-sorted: a read starts before the one in front of it")


def _tag(name: str, kind: str, value: Column, when: Column) -> Column:
    return F.when(when & value.isNotNull(), F.struct(F.lit(name).alias("name"), F.lit(kind).alias("type"), value.cast("string").alias("value")))


def tags(config: Config) -> Column:
    """The tags of a record with its molecule's columns: number, barcode and size; more for representatives."""
    member, rep = F.col("mi").isNotNull(), F.coalesce(F.col("is_rep"), F.lit(False))
    found = [
        _tag("MI", "Z", F.col("mi"), member), _tag("uN", "Z", F.col("umi"), member), _tag("uS", "i", F.col("n_reads"), member),
        _tag("uJ", "i", F.col("same_chain"), rep), _tag("uD", "i", F.col("disagreements"), rep),
        _tag("uA", "A", F.col("polya"), rep & F.lit(config.full_length)), _tag("uP", "i", F.col("polya_len"), rep & F.lit(config.full_length) & (F.col("polya_len") > 0)),
        _tag("uF", "A", F.col("fl"), rep), _tag("uT", "Z", F.col("fl_tx"), rep), _tag("uG", "Z", F.col("genes"), rep & (F.col("genes") != "")),
    ]
    return F.array_compact(F.array(*found))


def output(records: DataFrame, done: Result, config: Config) -> DataFrame:
    """(ordinal, flag, raw, tags) of the records to write."""
    facts = ["umi", "n_reads", "same_chain", "disagreements", "polya", "polya_len", "fl", "fl_tx", "genes"]
    table = records.select("ordinal", "flag", "raw", "had_stale")
    if config.mode == "filter":
        found = molecules.filter_mode(table, done.molecules).withColumn("is_rep", F.lit(True))
    else:
        found = molecules.mark_mode(table, done.assigned, done.molecules, "had_stale")
    found = found.drop("umi", "n_reads").join(done.molecules.select("mi", *facts), "mi", "left")
    return found.select("ordinal", "flag", "raw", tags(config).alias("tags"))


def molecule_table(records: DataFrame, done: Result, contigs: list[tuple[str, int]]) -> DataFrame:
    """The 17 columns of the molecules file, by the order of representatives; '.' stands for what is absent."""
    names = records.sparkSession.createDataFrame([(i, name) for i, (name, _) in enumerate(contigs)], "tid int, chrom string")
    rep = done.assigned.select(F.col("ordinal").alias("rep_ordinal"), F.col("start").alias("rep_start"), F.col("end").alias("rep_end"), F.col("qname").alias("rep_read"))
    absent = lambda c: F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit("."))
    # The contigs of the header, a few thousand rows at most.
    found = done.molecules.join(rep, "rep_ordinal").join(F.broadcast(names), "tid")
    return found.select(
        F.col("mi").alias("MI"), "chrom", "strand", (F.col("anchor") + 1).alias("anchor"), "umi", F.when(F.col("umi_damaged"), "Y").otherwise("N").alias("umi_damaged"), F.col("n_reads").alias("reads"), "same_chain", "disagreements",
        "rep_read", (F.col("rep_start") + 1).alias("rep_start"), "rep_end", F.col("polya").alias("polyA"), F.col("polya_len").alias("polyA_len"), absent("fl").alias("full_length"), absent("fl_tx").alias("transcript"), absent("genes").alias("genes"),
    )


def run(spark: SparkSession, paths: list[str], out: str, config: Config | None = None, annotation: str | None = None, stats: str | None = None, table: str | None = None, command: str = NAME) -> dict[str, str]:
    """Write ``out`` (one file if it ends with .bam, else a folder of them), and the report and the molecules where asked; returns the report."""
    config = config or Config()
    text, contigs = bam.header(paths[0])
    records = bam.read_bam(spark, paths)
    models = None
    if annotation:
        models = cut_lineage(gtf.read_gtf(spark, annotation, spark.createDataFrame([(name, i) for i, (name, _) in enumerate(contigs)], "name string, tid int")))
        if config.full_length and not models.filter("feature = 'exon'").take(1):
            log.warning("the annotation has no exon records, so full-length calls are not assessed")
    reasons = cut_lineage(filters.drop_reasons(features(records, config), config))
    used = reasons.filter("drop_reason is null").drop("drop_reason")
    require_order(used)
    done = deduplicate(used, config, models)
    rows = molecules.report(reasons, done, config).orderBy("line").collect()
    found = {r.metric: r.value for r in rows}
    if not config.ignore_strand and 2 * int(found["strand_unknown"]) > int(found["reads_used"]) > 0:
        log.warning("%s of %s reads have no strand; they are grouped by locus and barcode only", found["strand_unknown"], found["reads_used"])

    head = bam.with_program(text, NAME, VERSION, command)
    single = out.endswith(".bam")
    parts = bam.write_bam(output(records, done, config), out + ".parts" if single else out, head, contigs, whole=not single).orderBy("part").collect()
    # The second look at the input must have found what the first one did.
    if sum(p.n for p in parts) != int(found["records_written"]):
        raise ValueError(f"{sum(p.n for p in parts)} records were written, {found['records_written']} were expected: the input has changed")
    if single:
        bam.merge([p.file for p in parts], out, head, contigs)
        fs, folder = bam._open(out + ".parts")
        fs.delete_dir(folder)
    if stats:
        fs, path = bam._open(stats)
        with fs.open_output_stream(path, compression=None) as f:
            f.write(("metric\tvalue\n" + "".join(f"{r.metric}\t{r.value}\n" for r in rows)).encode())
    if table:
        molecule_table(records, done, contigs).orderBy("MI").write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").csv(table)
    return found


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    default = Config()
    p = argparse.ArgumentParser(prog=NAME, description="One representative alignment per original molecule.")
    p.add_argument("-i", "--bam", required=True, action="append", help="sorted alignments; may be given several times")
    p.add_argument("-o", "--out", required=True, help="a file if it ends with .bam, else a folder of files")
    p.add_argument("--gtf"), p.add_argument("--stats"), p.add_argument("--molecules")
    p.add_argument("--mode", choices=("filter", "mark"), default=default.mode)
    p.add_argument("--rep", choices=("junction-consensus", "longest"), default=default.rep)
    for name in ("umi_dist", "damaged_umi_dist", "collision_budget", "damaged_collision_budget", "max_umi_edits", "pos_tol", "bridge_exon_max", "chimera_clip", "min_mapq", "min_qs", "fl_cov", "fl_terminal"):
        p.add_argument("--" + name.replace("_", "-"), type=type(getattr(default, name)), default=getattr(default, name))
    for name in ("no_position", "ignore_strand", "lenient_junctions", "no_full_length"):
        p.add_argument("--" + name.replace("_", "-"), action="store_true")
    p.add_argument("-t", "--threads", type=int, default=4, help="cores of a local session; unused where a master is set")
    p.add_argument("-v", "--verbose", action="store_true")
    return p.parse_args(argv)


def main(argv: list[str] | None = None) -> None:
    a = arguments(argv)
    logging.basicConfig(level=logging.INFO if a.verbose else logging.WARNING)
    builder = SparkSession.builder.appName(NAME)
    if not SparkSession.getActiveSession():
        from pyspark import SparkConf

        builder = builder if SparkConf().get("spark.master", None) else builder.master(f"local[{a.threads}]")
    config = replace(Config(), full_length=not a.no_full_length, **{k: v for k, v in vars(a).items() if k in Config.__dataclass_fields__})
    for metric, value in run(builder.getOrCreate(), a.bam, a.out, config, a.gtf, a.stats, a.molecules, " ".join(argv or [NAME])).items():
        log.info("%s\t%s", metric, value)
