"""Alignment geometry and strand as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ACC = "struct<pos:int,left:int,right:int,exonic:int,seen:boolean,junctions:array<struct<s:int,e:int>>>"


def cigar_ops(cigar: Column) -> Column:
    """A CIGAR string as array<struct<op, len>>."""
    return F.transform(F.regexp_extract_all(cigar, F.lit("([0-9]+[MIDNSHP=X])"), F.lit(1)), lambda x: F.struct(F.right(x, F.lit(1)).alias("op"), F.regexp_extract(x, "^([0-9]+)", 1).cast("int").alias("len")))


def geometry(pos: Column, ops: Column) -> Column:
    """struct(start, end, left, right, exonic_len, junctions) of an alignment that starts at ``pos``."""
    zero = F.struct(pos.cast("int").alias("pos"), F.lit(0).alias("left"), F.lit(0).alias("right"), F.lit(0).alias("exonic"), F.lit(False).alias("seen"), F.array().cast("array<struct<s:int,e:int>>").alias("junctions"))

    def step(a: Column, x: Column) -> Column:
        op, n = x["op"], x["len"]
        exon, skip, clip = op.isin("M", "=", "X", "D"), op == "N", op.isin("S", "H")
        moves = exon | skip
        junction = F.array(F.struct(a["pos"].alias("s"), (a["pos"] + n).alias("e")))
        return F.struct(
            F.when(moves, a["pos"] + n).otherwise(a["pos"]).alias("pos"),
            F.when(clip & ~a["seen"], a["left"] + n).otherwise(a["left"]).alias("left"),
            F.when(moves, F.lit(0)).when(clip & a["seen"], a["right"] + n).otherwise(a["right"]).alias("right"),
            F.when(exon, a["exonic"] + n).otherwise(a["exonic"]).alias("exonic"),
            (a["seen"] | moves).alias("seen"),
            F.when(skip, F.concat(a["junctions"], junction)).otherwise(a["junctions"]).alias("junctions"),
        )

    return F.aggregate(ops, zero.cast(ACC), lambda a, x: step(a, x).cast(ACC), lambda a: F.struct(pos.cast("int").alias("start"), F.greatest(a["pos"], pos.cast("int") + 1).alias("end"), a["left"].alias("left"), a["right"].alias("right"), a["exonic"].alias("exonic_len"), a["junctions"].alias("junctions")))


def genomic_strand(orientation: Column, is_reverse: Column) -> Column:
    """'+', '-' or '.' from the transcript orientation relative to the read and the read's direction."""
    return F.when(orientation == "+", F.when(is_reverse, "-").otherwise("+")).when(orientation == "-", F.when(is_reverse, "+").otherwise("-")).otherwise(".")


def resolved_strand(primary: Column, fallback: Column, is_reverse: Column) -> Column:
    """The primary tag's strand, or the fallback tag's where that is missing or unresolvable."""
    first = genomic_strand(primary, is_reverse)
    return F.when(first != ".", first).otherwise(genomic_strand(fallback, is_reverse))


def clip5(strand: Column, left: Column, right: Column) -> Column:
    return F.when(strand == "-", right).otherwise(left)


def anchor(strand: Column, start: Column, end: Column) -> Column:
    return F.when(strand == "-", end - 1).otherwise(start)


def alt_anchor(strand: Column, start: Column, end: Column, junctions: Column, longest: int) -> Column:
    """struct(pos, exon) of the anchor that a skipped short first exon would give; null if none."""
    first, last = F.try_element_at(junctions, F.lit(1)), F.try_element_at(junctions, F.lit(-1))
    plus = F.struct(first["e"].cast("long").alias("pos"), (first["s"] - start).cast("long").alias("exon"))
    minus = F.struct(F.greatest(last["s"] - 1, F.lit(0)).cast("long").alias("pos"), (end - last["e"]).cast("long").alias("exon"))
    found = F.when((strand == "+") & (F.size(junctions) > 0), plus).when((strand == "-") & (F.size(junctions) > 0), minus)
    return F.when(found["exon"] <= longest, found)


def aligned_blocks(start: Column, end: Column, junctions: Column) -> Column:
    """The parts of the span that are not junctions."""
    return F.zip_with(F.concat(F.array(start), F.transform(junctions, lambda j: j["e"])), F.concat(F.transform(junctions, lambda j: j["s"]), F.array(end)), lambda s, e: F.struct(s.alias("s"), e.alias("e")))


def overlap(a: Column, b: Column) -> Column:
    """Bases that two lists of disjoint intervals share."""
    parts = F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.greatest(F.lit(0), F.least(x["e"], y["e"]) - F.greatest(x["s"], y["s"])).cast("long"))))
    return F.aggregate(parts, F.lit(0).cast("long"), lambda t, x: t + x)


def pct(part: Column, whole: Column) -> Column:
    """Per cent with two decimals, halves away from zero; 0 of nothing."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(F.lit(10000.0) * part / whole) / 100)


def floor_median(values: Column) -> Column:
    return F.coalesce(F.floor(F.median(values)).cast("long"), F.lit(0).cast("long"))
