"""Shared steps whose time grows with the reads: what each spares, and that it gives what the longer way gave."""

from __future__ import annotations

import re
from itertools import product

import pytest
from pyspark.sql import functions as F

from strandloom.config import Config
from strandloom.functions import umi
from strandloom.operators import graph, neighbours, nodes, representative
from strandloom.sources import testdata

NODE = "locus_id long, node_id long, b0 string, b1 string, b2 string, b3 string, cnt long, amin long, amax long, max_clip5 int, alts array<struct<pos:bigint,exon:bigint>>, strand string, own_reach int, damaged boolean, density long, weight long"


def _plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_reads_are_derived_in_even_parts(spark, tmp_path):
    """One large file and many small ones: the parts' sizes are not those of the files."""
    for i in range(16):
        spark.range(i * 4000, i * 4000 + (4000 if i == 0 else 1)).toDF("event_id").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    got = testdata.raw_reads(spark, str(tmp_path))
    sizes = [r["n"] for r in got.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 4015 and max(sizes) < 1500


def test_blocks_of_reads_are_looked_up_whole():
    assert testdata._spark_sql().count("element_at(array('AAAA'") == 4
    assert testdata._spark_sql().count("substr('ACG'") == 1  # the changed base


@pytest.mark.parametrize("blocks", [("ACGA", "CGAC", "GACG", "ACGC"), ("AAAA", "AAAA", "AAAA", "AAAA")])
def test_tags_without_outer_t_need_no_alignment(spark, blocks):
    a, b, c, d = blocks
    tags = ["T" * k + f"{a}TT{b}TT{c}TT{d}" + "T" * n for k, n in product(range(4), repeat=2)]
    assert all(re.fullmatch(umi.CLEAN, t) for t in tags)
    assert umi.align(tags) == [(*blocks, 0)] * len(tags)
    got = umi.decode(spark.createDataFrame([(t,) for t in tags], "rx string")).select("rx", "b0", "b1", "b2", "b3", "edits").collect()
    assert sorted(tuple(r) for r in got) == sorted((t, *blocks, 0) for t in tags)


def test_undamaged_nodes_are_spread_only_by_blocks_that_damage_spares(spark, monkeypatch):
    rows, spread = [], neighbours.keyed

    def counted(found, sizes):
        out = spread(found, sizes)
        rows.append(out.count())
        return out

    monkeypatch.setattr(neighbours, "keyed", counted)
    row = lambda i, b2, reach, damaged: (1, i, "ACGA", "CGAC", b2, "ACGC", 1, 100, 100, 3, [], "+", reach, damaged, 9, 1)
    sound = [row(i, b2, 2, False) for i, b2 in enumerate(("GACG", "GCCG", "AAAA"), 1)]
    table = spark.createDataFrame([*sound, row(9, "GTCG", 2, True)], NODE)
    assert [tuple(r) for r in neighbours.credits(table, Config()).collect()] == [(1, 9, 1, 1)]
    # Three blocks are whole: one way to keep three of them and three to keep two, of four and six.
    assert rows == [4, 12]


def test_edges_shuffle_their_nodes_once(spark):
    row = lambda i, b3, weight, at: (1, i, "ACGA", "CGAC", "GACG", b3, 1, at, at + 5, 3, [(700, 30)], "-", 1, False, 9, weight)
    table = spark.createDataFrame([row(1, "ACGC", 5, 100), row(2, "ACGA", 1, 124), row(3, "ACGG", 1, 200)], NODE)
    edges = neighbours.directed_edges(table, Config())
    assert [(r.src, r.dst, r.dist) for r in edges.collect()] == [(1, 2, 1)]
    assert "ReusedExchange" in _plan(neighbours.directed_edges(graph.cut_lineage(table), Config()))


def test_consensus_joins_nothing_back(spark):
    shape = "locus_id long, seed long, tid int, ordinal long, start long, end long, junctions array<struct<s:bigint,e:bigint>>, exonic_len long, qs double, pt long, has_sa boolean"
    rows = [(1, 1, 0, 1, 0, 500, [(100, 200)], 400, 9.0, None, False), (1, 1, 0, 2, 0, 400, [(100, 200)], 300, None, 5, False), (1, 1, 0, 3, 0, 600, [(110, 200)], 510, 9.0, 5, False), (1, 2, 0, 4, 0, 50, [], 50, None, None, True)]
    found = representative.consensus(spark.createDataFrame(rows, shape))
    # The longest of the first molecule carries a junction of its own and skips the one that two reads support.
    assert sorted(tuple(r) for r in found.collect()) == [(1, 1, 2, 0, 2, True), (1, 2, 4, 0, 1, False)]
    assert len(re.findall(r"\bJoin ", found._jdf.queryExecution().optimizedPlan().toString())) == 2


def test_bridges_start_from_reads_that_are_clipped_far_enough(spark):
    shape = "locus_id long, umi_key long, island long, anchor long, alt_anchor long, alt_exon long, clip5 int, strand string"
    rows = [(1, 7, 0, 900, 520, 12, 3, "-"), (1, 7, 1, 500, None, None, 6, "-"), (1, 7, 2, 541, None, None, 40, "-"), (1, 7, 3, 530, None, None, 4, "-")]
    found = nodes.bridges(spark.createDataFrame(rows, shape), Config())
    assert [tuple(r) for r in found.collect()] == [(1, 7, 0, 1)]
    assert re.search(r"clip5#\d+ >= 5", found._jdf.queryExecution().optimizedPlan().toString())


def test_votes_are_counted_where_they_are_joined(spark):
    shape = "locus_id long, seed long, tid int, ordinal long, start long, end long, junctions array<struct<s:bigint,e:bigint>>"
    rows = [(1, m, 0, 4 * m + i, i, 500 + i, [(100 + (i == 3), 200)]) for m in range(40) for i in range(4)]
    table = graph.cut_lineage(spark.createDataFrame(rows, shape))
    found = representative.junction_votes(table)
    assert sorted(tuple(r) for r in found.collect()) == [x for m in range(40) for x in ((1, m, 100, 200, 3, 4, True, False), (1, m, 101, 200, 1, 4, False, True))]
    # One shuffle for each side of the join, none between the counts and the join.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = representative.junction_votes(table)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2
