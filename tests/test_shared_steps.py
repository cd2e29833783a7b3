"""Steps that many queries share: each does its work once, and no more of it than its rows need."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from strandloom.config import Config
from strandloom.operators import molecules, neighbours
from strandloom.plans import catalogue
from strandloom.sources import testdata


def test_reads_are_derived_without_decimals(spark, tmp_path):
    ids = [*range(200), 4 * 43046721 - 1, 4 * 43046721 + 3, 399_999_999]
    spark.createDataFrame([(i,) for i in ids], "event_id long").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = testdata.raw_reads(spark, str(tmp_path))
    assert "decimal" not in got._jdf.queryExecution().optimizedPlan().toString().lower()
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(testdata.READS_SQL + " order by ordinal").fetchall()
    assert [tuple(r) for r in got.orderBy("ordinal").collect()] == want


def test_numbering_computes_its_molecules_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def same(x):
        seen.add(1)
        return x

    found = spark.range(40).repartition(3).select((F.col("id") * 7 + 1).alias("id")).select(same("id").alias("rep_ordinal"))
    got = sorted(tuple(r) for r in molecules.number(found, per=50).select("rep_ordinal", "mi").collect())
    assert got == [(7 * i + 1, i + 1) for i in range(40)]
    assert seen.value == 40


def test_truth_is_scored_on_one_derivation(spark, monkeypatch):
    calls, derive = [], testdata.used_reads
    monkeypatch.setattr(testdata, "used_reads", lambda *a: calls.append(1) or derive(*a))
    catalogue.truth_score(spark, "/root/testdata/sf0.001")
    assert len(calls) == 1


def test_parents_are_spread_only_as_far_as_damaged_nodes_reach(spark, monkeypatch):
    sizes, meet = [], neighbours.pairs

    def kept(left, right, left_sizes, right_sizes, same):
        sizes.append(spark.range(1).select(right_sizes.alias("s")).first().s)
        return meet(left, right, left_sizes, right_sizes, same)

    monkeypatch.setattr(neighbours, "pairs", kept)
    shape = "locus_id long, node_id long, b0 string, b1 string, b2 string, b3 string, cnt long, amin long, amax long, max_clip5 int, alts array<struct<pos:bigint,exon:bigint>>, strand string, own_reach int, damaged boolean, density long"
    row = lambda i, b2, reach, damaged: (1, i, "ACGA", "CGAC", b2, "ACGC", 1, 100, 100, 3, [], "+", reach, damaged, 9)
    for reach, want in ((1, [3]), (2, [2, 3]), (3, [1, 2, 3])):
        table = spark.createDataFrame([row(1, "GACG", 2, False), row(2, "GTCG", reach, True)], shape)
        assert [tuple(r) for r in neighbours.credits(table, Config()).collect()] == [(1, 2, 1, 1)]
        assert sizes.pop() == want
    assert not neighbours.credits(table.filter("not damaged"), Config()).collect()
