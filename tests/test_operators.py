from __future__ import annotations

import random

from pyspark.sql import functions as F

from strandloom.config import Config
from strandloom.functions import umi
from strandloom.operators import annotation, graph, loci, molecules, representative
from strandloom.plans.pipeline import deduplicate
from strandloom.streaming.loci import session_loci

SHAPE = "ordinal long, tid long, strand string, start long, end long, anchor long, alt_anchor long, alt_exon long, clip5 long, junctions array<struct<s:bigint,e:bigint>>, exonic_len long, qs double, pt int, has_sa boolean, b0 string, b1 string, b2 string, b3 string"
B = ("ACGA", "CGAC", "GACG", "ACGC")


def reads(spark, rows):
    """rows: (start, blocks, overrides)."""
    out = []
    for i, (start, blocks, more) in enumerate(rows):
        r = {"ordinal": i, "tid": 0, "strand": "+", "start": start, "end": start + 500, "anchor": start, "alt_anchor": None, "alt_exon": None, "clip5": 3, "junctions": [], "exonic_len": 500, "qs": 20.0, "pt": -2, "has_sa": False} | dict(zip(("b0", "b1", "b2", "b3"), blocks, strict=True)) | more
        out.append(tuple(r[c.split()[0]] for c in SHAPE.split(", ")))
    blocks = [F.col(f"b{k}") for k in range(4)]
    return spark.createDataFrame(out, SHAPE).withColumn("damaged", umi.is_damaged(blocks)).withColumn("umi_key", umi.packed_key(blocks, F.col("damaged")))


def sub(blocks, k, block):
    return (*blocks[:k], block, *blocks[k + 1 :])


HURT, NEAR = sub(B, 0, "ACG"), sub(B, 0, "ACGC")
#: Reads (start, blocks, overrides) and the sizes of the molecules that they are to make.
SCENARIOS = {
    "three to one merges": ([(100, B, {})] * 3 + [(100, NEAR, {})], [4]),
    "two to two does not": ([(100, B, {})] * 2 + [(100, NEAR, {})] * 2, [2, 2]),
    "same barcode far apart": ([(100, B, {}), (105, B, {}), (5000, B, {})], [1, 2]),
    "neighbour too far off": ([(100, B, {})] * 3 + [(400, NEAR, {})], [1, 3]),
    "two hubs are not bridged": ([(100, B, {})] * 10 + [(100, sub(NEAR, 3, "ACGA"), {})] * 10 + [(100, NEAR, {})] * 3, [10, 13]),
    "damaged joins its source": ([(100, B, {}), (100, B, {}), (100, HURT, {})], [3]),
    "damaged group together": ([(100, HURT, {}), (101, sub(B, 0, "ACT"), {})], [2]),
    "short exon bridge": ([(400, B, {"clip5": 20}), (100, B, {"end": 900, "alt_anchor": 400, "alt_exon": 30})], [2]),
    "no bridge without a clip": ([(400, B, {"clip5": 3}), (100, B, {"end": 900, "alt_anchor": 400, "alt_exon": 30})], [1, 1]),
    "unknown strand ignores position": ([(100, B, {"strand": "."}), (400, B, {"strand": "."})], [2]),
}


def test_scenarios(spark):
    rows = [(start, blocks, {"tid": tid} | more) for tid, (case, _) in enumerate(SCENARIOS.values()) for start, blocks, more in case]
    made: dict[int, list[int]] = {}
    for r in deduplicate(reads(spark, rows), Config()).molecules.collect():
        made.setdefault(r.tid, []).append(r.n_reads)
    assert {name: sorted(made[tid]) for tid, name in enumerate(SCENARIOS)} == {name: sorted(want) for name, (_, want) in SCENARIOS.items()}


def test_polya_outranks_length(spark):
    molecule = reads(spark, [(100, B, {"exonic_len": 450, "pt": -1}), (100, B, {"exonic_len": 400, "pt": 55}), (100, B, {"exonic_len": 450, "pt": -1, "qs": 21.0})]).withColumns({"locus_id": F.lit(0), "seed": F.lit(1)})
    assert representative.consensus(molecule).first().rep_ordinal == 1
    assert representative.longest(molecule).first().rep_ordinal == 2


def sweep(rows, tol):
    """Loci by one pass, as a loop: {ordinal: first ordinal of its locus}."""
    out, most, first = {}, {}, {}
    for o, tid, strand, start, end in sorted(rows, key=lambda r: (r[1], r[2], r[3], r[0])):
        k = (tid, strand)
        if k not in most or start >= most[k] + tol:
            first[k] = o
            most[k] = end
        most[k] = max(most[k], end)
        out[o] = first[k]
    return out


def test_loci_against_a_loop_with_small_bins(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        start = rng.randrange(3000)
        rows.append((i, rng.randrange(3), rng.choice("+-."), start, start + rng.randrange(1, 60)))
    df = spark.createDataFrame(rows, "ordinal long, tid int, strand string, start long, end long")
    for size in (100, 1 << 20):
        assert {r.ordinal: r.locus_id for r in loci.loci(df, 20, size).collect()} == sweep(rows, 20)
    spans = {}
    for o, tid, strand, start, end in rows:
        k = (tid, strand, sweep(rows, 20)[o])
        lo, hi, n = spans.get(k, (start, end, 0))
        spans[k] = (min(lo, start), max(hi, end), n + 1)
    assert sorted((r.tid, r.strand, r.locus_start, r.locus_end, r.n_reads) for r in session_loci(df).collect()) == sorted((k[0], k[1], *v) for k, v in spans.items())


def test_min_label_is_the_smallest_ancestor(spark):
    rng = random.Random(2)
    n = 40
    edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(45)}
    nodes = spark.createDataFrame([(1, i, i) for i in range(n)], "locus_id long, node_id long, rank long")
    got = {r.node_id: r.label for r in graph.min_label(nodes, spark.createDataFrame([(1, a, b) for a, b in edges], "locus_id long, src long, dst long")).collect()}
    label = list(range(n))
    for _ in range(n):
        for a, b in edges:
            label[b] = min(label[b], label[a])
    assert got == dict(enumerate(label))


def test_percentiles_are_nearest_rank(spark):
    row = molecules.size_percentiles(spark.createDataFrame([(1,), (2,)], "n_reads long")).first()
    assert (row.p50, row.p90, row.max) == (2, 2, 2)


def test_touching_exons_merge(spark):
    rows = spark.createDataFrame([(0, 1, 0, 10), (0, 1, 10, 20), (0, 1, 25, 30), (0, 2, 5, 6)], "tid int, gene_idx long, s long, e long")
    assert sorted((r.gene_idx, r.s, r.e) for r in annotation.exon_unions(rows).collect()) == [(1, 0, 20), (1, 25, 30), (2, 5, 6)]


def test_long_paths_take_few_rounds(spark, monkeypatch):
    rng = random.Random(7)
    order = rng.sample(range(150), 150)
    path = list(zip(order, order[1:], strict=False))
    calls, cut = [], graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df: calls.append(1) or cut(df))
    got = graph.undirected_min(spark.createDataFrame([(g, a, b) for g in (1, 2) for a, b in path] + [(3, 8, 9), (3, 4, 4)], "grp long, a long, b long")).collect()
    assert {(r.grp, r.node): r.label for r in got} == {(g, n): 0 for g in (1, 2) for n in range(150)} | {(3, 8): 8, (3, 9): 8, (3, 4): 4}
    assert len(calls) <= 2 + 3 * 9
    calls.clear()
    nodes = spark.createDataFrame([(1, i, i) for i in range(150)], "locus_id long, node_id long, rank long")
    labels = graph.min_label(nodes, spark.createDataFrame([(1, i, i + 1) for i in range(149)], "locus_id long, src long, dst long")).collect()
    assert {r.label for r in labels} == {0} and len(labels) == 150 and len(calls) <= 2 + 10
