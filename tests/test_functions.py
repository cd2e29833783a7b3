from __future__ import annotations

import random

from pyspark.sql import functions as F

from strandloom.functions import geometry as geo
from strandloom.functions import umi

TAG = "TTTACGATTCGACTTGACGTTACGCTTT"
BLOCKS = ("ACGA", "CGAC", "GACG", "ACGC")


def test_alignment_of_tags():
    cases = {
        TAG: (*BLOCKS, 0),
        TAG[1:]: (*BLOCKS, 0),
        TAG[2:-1]: (*BLOCKS, 0),
        TAG.replace("ATTC", "ATTTC"): (*BLOCKS, 1),
        TAG.replace("GACG", "GTCG"): ("ACGA", "CGAC", "GTCG", "ACGC", 1),
        TAG.replace("ACGATT", "ACGTT"): ("ACG", "CGAC", "GACG", "ACGC", 1),
        "A" * 28: None,
        "": None,
        "ACGT": None,
    }
    assert umi.align(list(cases)) == list(cases.values())


def test_edit_cap():
    broken = TAG.replace("TT", "CC")
    assert umi.align([broken], 2) == [None]


def test_decode_and_key(spark):
    rows = spark.createDataFrame([(1, TAG), (2, TAG.lower()), (3, None), (4, "GARBAGE"), (5, TAG.replace("GACG", "GTCG"))], "id long, rx string")
    got = {r.id: r for r in umi.decode(rows).withColumn("damaged", umi.is_damaged([F.col(f"b{k}") for k in range(4)])).withColumn("key", umi.packed_key([F.col(f"b{k}") for k in range(4)], F.col("damaged"))).collect()}
    assert got[1].key == got[2].key and not got[1].damaged
    code = {c: i for i, c in enumerate("ACGT")}
    expected = sum((4 << 12 | sum(code[c] << 2 * i for i, c in enumerate(b))) << 15 * k for k, b in enumerate(BLOCKS))
    assert got[1].key == expected
    assert got[3].edits is None and got[4].edits is None
    assert got[5].damaged and got[5].key >= 1 << 60


def test_reach_cut_offs(spark):
    rows = spark.createDataFrame([(m,) for m in (1, 839, 840, 4310, 4311, 41955, 41956)], "m long")
    got = {r.m: (r.a, r.b) for r in rows.select("m", umi.reach(2, F.col("m"), 0.01).alias("a"), umi.reach(3, F.col("m"), 0.5).alias("b")).collect()}
    assert got == {1: (2, 3), 839: (2, 3), 840: (1, 3), 4310: (1, 3), 4311: (1, 2), 41955: (1, 2), 41956: (1, 1)}


def test_geometry(spark):
    row = spark.createDataFrame([(100, "3S20M500N50M2D10M40S")], "pos int, cigar string").select(geo.geometry(F.col("pos"), geo.cigar_ops(F.col("cigar"))).alias("g")).first().g
    assert (row.start, row.end, row.exonic_len, row.left, row.right) == (100, 682, 82, 3, 40)
    assert [(j.s, j.e) for j in row.junctions] == [(120, 620)]


def test_overlap_against_sets(spark):
    rng = random.Random(3)

    def intervals():
        cuts = sorted(rng.sample(range(60), 6))
        return [(cuts[i], cuts[i + 1]) for i in (0, 2, 4)]

    pairs = [(intervals(), intervals()) for _ in range(40)]
    kind = "array<struct<s:bigint,e:bigint>>"
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], f"i int, a {kind}, b {kind}")
    cover = lambda x: {p for s, e in x for p in range(s, e)}
    for r in df.select("i", geo.overlap(F.col("a"), F.col("b")).alias("n")).collect():
        a, b = pairs[r.i]
        assert r.n == len(cover(a) & cover(b))


def test_strand_table(spark):
    rows = [(o, rev) for o in "+-?" for rev in (False, True)]
    got = [r.s for r in spark.createDataFrame(rows, "o string, rev boolean").select(geo.genomic_strand(F.col("o"), F.col("rev")).alias("s")).collect()]
    assert got == ["+", "-", "-", "+", ".", "."]
