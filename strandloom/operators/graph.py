"""Label propagation over edge tables. Rounds go through checkpoint(), so lost executors do not break the lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut_lineage(df: DataFrame) -> DataFrame:
    """``checkpoint()`` in the session's shared folder; a temporary one only in local mode and where none is configured."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc._jsc.sc().isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="strandloom-"))
    return df.checkpoint()


def min_label(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The smallest ``rank`` (any type that has an order) among all nodes that reach each node.

    nodes: (locus_id, node_id, rank), ranks unique within a locus; edges: directed (locus_id, src, dst). Returns nodes with
    a column label. Only nodes with edges take part in the rounds, and only labels that changed are offered again. A node
    also takes the label of the node whose rank it has, so that a long path takes rounds by the logarithm of its length.
    """
    key = ["locus_id", "node_id"]
    edges = cut_lineage(edges.select("locus_id", "src", "dst").distinct())
    touched = edges.select("locus_id", F.col("src").alias("node_id")).union(edges.select("locus_id", F.col("dst").alias("node_id"))).distinct()
    labels = cut_lineage(nodes.join(touched, key).select(*key, "rank", F.col("rank").alias("label"), F.lit(True).alias("moved")))
    while labels.filter("moved").take(1):
        offered = labels.filter("moved").select("locus_id", F.col("node_id").alias("src"), "label").join(edges, ["locus_id", "src"]).groupBy("locus_id", F.col("dst").alias("node_id")).agg(F.min("label").alias("offer"))
        # Only nodes that have another one's rank lead further.
        further = labels.filter("label < rank").select("locus_id", F.col("rank").alias("_near"), F.col("label").alias("_far"))
        near = labels.drop("moved").join(offered, key, "left").withColumn("_near", F.least("label", "offer"))
        best = near.join(further, ["locus_id", "_near"], "left").withColumn("_best", F.least("_near", "_far"))
        labels = cut_lineage(best.select(*key, "rank", F.col("_best").alias("label"), (F.col("_best") < F.col("label")).alias("moved")))
    return nodes.join(labels.drop("moved", "rank"), key, "left").withColumn("label", F.coalesce("label", "rank"))


def undirected_min(edges: DataFrame) -> DataFrame:
    """(group, node, label): the smallest node of each node's component, within each group. edges: (grp, a, b).

    A round offers each node the labels of its neighbours, offers the same to the node whose label it has, and then takes
    the label of its label.
    """
    both = cut_lineage(edges.select("grp", "a", "b").union(edges.select("grp", F.col("b"), F.col("a"))).distinct())
    labels = cut_lineage(both.select("grp", F.col("a").alias("node"), F.col("a").alias("label")).distinct())
    while True:
        offered = labels.withColumnRenamed("node", "a").join(both, ["grp", "a"]).groupBy("grp", F.col("b").alias("node")).agg(F.min("label").alias("offer"))
        near = cut_lineage(labels.join(offered, ["grp", "node"], "left"))
        hooks = near.filter("offer < label").groupBy("grp", F.col("label").alias("node")).agg(F.min("offer").alias("hook"))
        hooked = cut_lineage(near.join(hooks, ["grp", "node"], "left").select("grp", "node", F.col("label").alias("old"), F.least("label", "offer", "hook").alias("label")))
        further = hooked.filter("label < node").select("grp", F.col("node").alias("label"), F.col("label").alias("_far"))
        moved = cut_lineage(hooked.join(further, ["grp", "label"], "left").select("grp", "node", F.least("label", "_far").alias("label"), (F.least("label", "_far") < F.col("old")).alias("moved")))
        labels = moved.drop("moved")
        if not moved.filter("moved").take(1):
            return labels
