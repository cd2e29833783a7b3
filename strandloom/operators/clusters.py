"""Directional clusters, damaged leftovers and the assignment of reads to molecules."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from . import neighbours as nb
from .graph import cut_lineage, min_label


def directional(weighted: DataFrame, edges: DataFrame) -> DataFrame:
    """Undamaged nodes with seed: the first by (weight descending, key, amin) of all nodes that reach them."""
    rank = F.struct((-F.col("weight")).alias("less"), "umi_key", "amin", F.col("node_id").alias("seed"))
    labels = min_label(weighted.select("locus_id", "node_id", rank.alias("rank")), edges).select("locus_id", "node_id", F.col("label.seed").alias("seed"))
    return weighted.join(labels, ["locus_id", "node_id"])


def place_leftovers(pdf: pd.DataFrame) -> pd.DataFrame:
    """The order-dependent step for one locus: rows of nodes (kind 0) and candidate pairs (kind 1).

    Nodes go by (count descending, key, amin); each joins the nearest damaged node that is placed already, by
    (distance, total of its cluster descending, count descending, node id), or founds a molecule.
    """
    nodes, pairs = pdf[pdf.kind == 0], pdf[pdf.kind == 1]
    count = dict(zip(nodes.node_id, nodes.cnt, strict=True))
    home = {n: s for n, s in zip(nodes.node_id, nodes.seed, strict=True) if s >= 0}
    total: dict[int, int] = {}
    for n, t, s in zip(nodes.node_id, nodes.total, nodes.seed, strict=True):
        if s >= 0:
            total[s] = int(t)
    near: dict[int, list[tuple[int, int]]] = {}
    for a, b, d in zip(pairs.node_id, pairs.other, pairs.dist, strict=True):
        near.setdefault(a, []).append((d, b))
    out = []
    left = nodes[nodes.seed < 0].sort_values(["cnt", "umi_key", "amin"], ascending=[False, True, True])
    for n in left.node_id:
        best = min(((d, -total[home[b]], -count[b], b) for d, b in near.get(n, []) if b in home), default=None)
        home[n] = home[best[3]] if best else n
        total[home[n]] = total.get(home[n], 0) + int(count[n])
        out.append((pdf.locus_id.iloc[0], n, home[n]))
    return pd.DataFrame(out, columns=["locus_id", "node_id", "seed"]).astype("int64")


def leftovers(nodes: DataFrame, parents: DataFrame, clusters: DataFrame, config: Config) -> DataFrame:
    """(locus_id, node_id, seed) of the damaged nodes without an undamaged parent. Loci without any never reach Python."""
    hurt = nodes.filter("damaged")
    totals = clusters.groupBy("locus_id", "seed").agg(F.sum("weight").alias("total"))
    followed = hurt.join(parents.select("locus_id", "node_id", "parent"), ["locus_id", "node_id"]).join(clusters.select("locus_id", F.col("node_id").alias("parent"), "seed"), ["locus_id", "parent"]).join(totals, ["locus_id", "seed"])
    left = hurt.join(parents, ["locus_id", "node_id"], "left_anti")
    met = nb.pairs(left, hurt, nb.kept_for(F.col("own_reach")), nb.kept_by_any(hurt), same=False)
    met = met.filter((F.col("u.node_id") != F.col("v.node_id")) & (F.col("dist") <= F.col("u.own_reach")) & nb.compatible(nb._side("u"), nb._side("v"), config))
    blank = F.lit(-1).cast("long")
    shape = lambda d, seed, total: d.select("locus_id", F.lit(0).alias("kind"), "node_id", "cnt", "umi_key", "amin", seed.alias("seed"), total.alias("total"), blank.alias("other"), blank.alias("dist"))
    pairs = met.select("locus_id", F.lit(1).alias("kind"), F.col("u.node_id").alias("node_id"), blank.alias("cnt"), blank.alias("umi_key"), blank.alias("amin"), blank.alias("seed"), blank.alias("total"), F.col("v.node_id").alias("other"), F.col("dist").cast("long"))
    here = left.select("locus_id").distinct()
    wanted = met.select("locus_id", F.col("v.node_id").alias("node_id")).distinct()
    known = shape(followed.join(wanted, ["locus_id", "node_id"], "left_semi"), F.col("seed"), F.col("total"))
    rows = shape(left, blank, blank).union(known.join(here, "locus_id", "left_semi")).union(pairs)
    return rows.groupBy("locus_id").applyInPandas(place_leftovers, "locus_id long, node_id long, seed long")


@dataclass
class Placed:
    """Where every node went, and the steps on the way: (locus_id, node_id, seed) in ``homes``."""

    homes: DataFrame
    dense: DataFrame
    parents: DataFrame
    edges: DataFrame
    clusters: DataFrame
    leftovers: DataFrame


def place(nodes: DataFrame, config: Config) -> Placed:
    # Each of these is read by several later steps.
    dense = cut_lineage(nb.with_reach(nb.density(nodes, config), config))
    parents = cut_lineage(nb.credits(dense, config))
    weighted = cut_lineage(nb.weights(dense, parents))
    edges = cut_lineage(nb.directed_edges(weighted, config))
    clusters = cut_lineage(directional(weighted, edges))
    own = clusters.select("locus_id", "node_id", "seed")
    followers = parents.join(clusters.select("locus_id", F.col("node_id").alias("parent"), "seed"), ["locus_id", "parent"]).select("locus_id", "node_id", "seed")
    left = cut_lineage(leftovers(dense, parents, clusters, config))
    return Placed(own.union(followers).union(left), dense, parents, edges, clusters, left)


def assign(reads: DataFrame, nodes: DataFrame, homes: DataFrame) -> DataFrame:
    """``reads`` (with node_id) with seed: the node that names their molecule within the locus; and the molecule's barcode."""
    names = nodes.select("locus_id", F.col("node_id").alias("seed"), F.concat("b0", "b1", "b2", "b3").alias("molecule_umi"), F.col("damaged").alias("umi_damaged"))
    # Nodes are fewer than reads: these are shuffled once.
    return reads.join(homes.join(names, ["locus_id", "seed"]), ["locus_id", "node_id"])
