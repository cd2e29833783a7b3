"""Neighbour search among barcodes: density, exact block-sharing joins, credit of damaged nodes and directed edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import umi
from .nodes import MIN_BRIDGE_CLIP

SIDES = ("node_id", "b0", "b1", "b2", "b3", "cnt", "amin", "amax", "max_clip5", "alts", "strand", "own_reach", "damaged", "density", "weight")


def density(nodes: DataFrame, config: Config) -> DataFrame:
    """``nodes`` with density: undamaged nodes of the locus whose amin lies within pos_tol of the node's anchors.

    A difference of two running counts. These run over distinct positions, of which a deep locus has no more than others.
    """
    total = nodes.filter(~F.col("damaged")).groupBy("locus_id").agg(F.count("*").alias("_all"))
    if not config.positions:
        return nodes.join(total, "locus_id", "left").withColumn("density", F.coalesce("_all", F.lit(0))).drop("_all")
    below, upto = F.col("amin") - config.pos_tol - 1, F.col("amax") + config.pos_tol
    counted = nodes.select("locus_id", "damaged", F.explode(F.array(F.struct(F.col("amin").alias("at"), F.when(F.col("damaged"), 0).otherwise(1).alias("one")), F.struct(below.alias("at"), F.lit(0).alias("one")), F.struct(upto.alias("at"), F.lit(0).alias("one")))).alias("x"))
    at = counted.groupBy("locus_id", F.col("x.at").alias("at")).agg(F.sum("x.one").alias("one"))
    running = at.select("locus_id", "at", F.sum("one").over(Window.partitionBy("locus_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)).alias("seen"))
    side = lambda name: running.select("locus_id", F.col("at").alias("_" + name), F.col("seen").alias("_seen_" + name))
    out = nodes.withColumn("_below", below).withColumn("_upto", upto).join(side("below"), ["locus_id", "_below"]).join(side("upto"), ["locus_id", "_upto"]).join(total, "locus_id", "left")
    near = F.when(F.col("strand") == ".", F.coalesce("_all", F.lit(0))).otherwise(F.col("_seen_upto") - F.col("_seen_below"))
    return out.withColumn("density", near).select(*nodes.columns, "density")


def compatible(a, b, config: Config) -> Column:
    """Anchor ranges within pos_tol, or joined by a bridge; always true where positions are off."""
    def bridged(x, y) -> Column:
        near = lambda alt: (alt["pos"] >= y("amin") - config.pos_tol) & (alt["pos"] <= y("amax") + config.pos_tol) & (y("max_clip5") >= F.greatest(F.floor(alt["exon"] / 2), F.lit(MIN_BRIDGE_CLIP)))
        return F.exists(x("alts"), near)

    if not config.positions:
        return F.lit(True)
    # A locus has one strand. Columns of both sides are asked for in the same order, so that both sides of a join of nodes with
    # themselves are one shuffle.
    gap = F.greatest(a("amin"), b("amin")) - F.least(a("amax"), b("amax")) <= config.pos_tol
    some = (F.size(a("alts")) > 0) | (F.size(b("alts")) > 0)
    return (a("strand") == ".") & (b("strand") == ".") | gap | some & (bridged(a, b) | bridged(b, a))


def keyed(nodes: DataFrame, sizes: Column) -> DataFrame:
    """A row per way to keep as many blocks as each entry of ``sizes`` (an array of numbers of kept blocks) says.

    Where nodes have a column masks, only ways that it lists are taken.
    """
    ways = F.array(*[F.struct(F.lit(k).alias("kept"), F.lit(sum(1 << i for i in m)).alias("mask"), F.xxhash64(*[F.col(f"b{i}") for i in m]).alias("blocks")) for k in (1, 2, 3, 4) for m in umi.masks(k)])
    listed = (lambda w: F.array_contains("masks", w["mask"])) if "masks" in nodes.columns else (lambda w: F.lit(True))
    return nodes.withColumn("_way", F.explode(F.filter(ways, lambda w: F.array_contains(sizes, w["kept"]) & listed(w)))).withColumn("mask", F.col("_way.mask")).withColumn("blocks", F.col("_way.blocks")).drop("_way")


def pairs(left: DataFrame, right: DataFrame, left_sizes: Column, right_sizes: Column, same: bool) -> DataFrame:
    """Pairs of nodes (u.*, v.*) of a locus that share enough whole blocks, with dist; each pair once.

    A pair meets under every mask of shared blocks that both sides were spread by. It is kept under one of them, that of
    all its shared blocks or, where all four are equal, of the first three; only whole barcodes are spread by the mask of
    all four, and by no other then. This also drops what meets by the hash of the blocks alone.
    """
    side = lambda d, sizes, name: keyed(d, sizes).select("locus_id", "mask", "blocks", F.struct(*[c for c in SIDES if c in d.columns]).alias(name))
    met = side(left, left_sizes, "u").join(side(right, right_sizes, "v"), ["locus_id", "mask", "blocks"])
    shared = sum((F.when(F.col(f"u.b{i}") == F.col(f"v.b{i}"), 1 << i).otherwise(0) for i in range(4)), F.lit(0))
    own = F.when(shared == 15, F.when(F.col("mask") == 15, 15).otherwise(7)).otherwise(shared)
    met = met.filter(F.col("mask") == own)
    if same:
        met = met.filter(F.col("u.node_id") < F.col("v.node_id"))
    return met.withColumn("dist", umi.distance([F.col(f"u.b{i}") for i in range(4)], [F.col(f"v.b{i}") for i in range(4)]))


def _side(name: str):
    return lambda c: F.col(f"{name}.{c}")


def kept_for(reach: Column) -> Column:
    """Within ``reach`` edits, at least 4 - reach of the blocks are equal: the mask sizes to index."""
    return F.when(reach <= 0, F.array(F.lit(4))).when(reach == 1, F.array(F.lit(3))).when(reach == 2, F.array(F.lit(3), F.lit(2))).otherwise(F.array(F.lit(3), F.lit(2), F.lit(1)))


def kept_by_any(nodes: DataFrame) -> Column:
    """The mask sizes that any of ``nodes`` is indexed by: deep loci have short reaches, and what they meet needs few ways.

    Asks for the longest and the shortest reach, one row.
    """
    found = nodes.agg(F.min("own_reach").alias("least"), F.max("own_reach").alias("most")).first()
    most = 0 if found.most is None else min(found.most, 3)
    sizes = [4] if most <= 0 else list(range(4 - most, 4))
    return F.array(*[F.lit(k) for k in sizes + [4] * (most > 0 and found.least <= 0)])


def with_reach(nodes: DataFrame, config: Config) -> DataFrame:
    valid = umi.reach(config.umi_dist, F.col("density"), config.collision_budget)
    hurt = umi.reach(config.damaged_umi_dist, F.col("density"), config.damaged_collision_budget)
    return nodes.withColumn("own_reach", F.when(F.col("damaged"), hurt).otherwise(valid))


def credits(nodes: DataFrame, config: Config) -> DataFrame:
    """(locus_id, node_id, parent, dist): the nearest undamaged compatible node of each damaged node within its reach.

    Ties go to more reads, then to the smaller node id. ``nodes`` come with density and own_reach.
    """
    # A damaged block equals no block of an undamaged node: pairs meet by the others only, and an undamaged node is spread by
    # the ways that any damaged node needs.
    whole = sum((F.when(umi.is_damaged([F.col(f"b{k}")]), 0).otherwise(1 << k) for k in range(4)), F.lit(0))
    every = F.array(*[F.lit(sum(1 << i for i in m)) for k in (1, 2, 3, 4) for m in umi.masks(k)])
    hurt = nodes.filter("damaged").withColumn("_whole", whole).withColumn("masks", F.filter(every, lambda m: m.bitwiseAND(F.col("_whole")) == m))
    # At most 16 rows.
    needed = sorted({m for row in hurt.select("masks").distinct().collect() for m in row.masks})
    sound = nodes.filter(~F.col("damaged")).withColumn("masks", F.array(*[F.lit(m) for m in needed]).cast("array<int>"))
    met = pairs(hurt, sound, kept_for(F.col("own_reach")), kept_by_any(hurt), same=False)
    fit = met.filter((F.col("dist") <= F.col("u.own_reach")) & compatible(_side("u"), _side("v"), config))
    best = fit.groupBy("locus_id", F.col("u.node_id").alias("node_id")).agg(F.min(F.struct("dist", (-F.col("v.cnt")).alias("few"), F.col("v.node_id").alias("parent"))).alias("best"))
    return best.select("locus_id", "node_id", F.col("best.parent").alias("parent"), F.col("best.dist").alias("dist"))


def weights(nodes: DataFrame, credited: DataFrame) -> DataFrame:
    """Undamaged nodes with weight: their reads and those of the damaged nodes credited to them."""
    extra = credited.join(nodes.select("locus_id", "node_id", "cnt"), ["locus_id", "node_id"]).groupBy("locus_id", F.col("parent").alias("node_id")).agg(F.sum("cnt").alias("_extra"))
    return nodes.filter(~F.col("damaged")).join(extra, ["locus_id", "node_id"], "left").withColumn("weight", F.col("cnt") + F.coalesce("_extra", F.lit(0))).drop("_extra")


def neighbour_pairs(nodes: DataFrame, config: Config) -> DataFrame:
    """Undamaged pairs (u, v) whose positions are compatible and whose distance both reach, before the rules of weight.

    The reach falls with density, so that of both is the reach in the denser one's surroundings.
    """
    if config.umi_dist <= 0:
        sizes = F.array(F.lit(4))
        return pairs(nodes, nodes, sizes, sizes, same=True).filter(F.lit(False))
    sizes = kept_for(F.col("own_reach"))
    met = pairs(nodes, nodes, sizes, sizes, same=True)
    return met.filter((F.col("dist") <= F.least("u.own_reach", "v.own_reach")) & compatible(_side("u"), _side("v"), config))


def directed_edges(weighted: DataFrame, config: Config) -> DataFrame:
    """(locus_id, src, dst, dist): u to v if weight(u) >= 2 weight(v) - 1, within the reach of the denser node."""
    met = neighbour_pairs(weighted, config)
    met = met.withColumn("wu", F.col("u.weight")).withColumn("wv", F.col("v.weight"))
    met = met.filter((F.col("dist") < 2) | (F.least("wu", "wv") <= 2))
    one = lambda a, b: F.when(F.col("w" + a) >= 2 * F.col("w" + b) - 1, F.struct(F.col(a + ".node_id").alias("src"), F.col(b + ".node_id").alias("dst")))
    edge = F.explode(F.array_compact(F.array(one("u", "v"), one("v", "u"))))
    return met.select("locus_id", "dist", edge.alias("e")).select("locus_id", F.col("e.src").alias("src"), F.col("e.dst").alias("dst"), "dist")
