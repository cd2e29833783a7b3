"""The registered queries over the driver's tables and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import geometry as geo
from ..functions import umi
from ..operators import annotation, clusters, filters, loci, molecules, neighbours, nodes, representative
from ..operators.graph import cut_lineage
from ..sources import testdata
from ..sources.testdata import READS_SQL
from ..streaming.loci import session_loci
from .pipeline import deduplicate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CONFIG = Config()


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- DuckDB building blocks: each extends the one before -------------------------------------------------------------

_RAW = f"with recursive raw as ({READS_SQL}),"
_BLOCK = "(length({b}) * 4096 + " + " + ".join(f"(case when length({{b}}) > {i} then (instr('ACGT', substr({{b}}, {i + 1}, 1)) - 1) * {4**i} else 0 end)" for i in range(6)) + ")"
_KEY = " + ".join(f"cast({_BLOCK.format(b=f'b{k}')} as bigint) * {1 << (15 * k)}" for k in range(4))
#: Barcodes by construction: class 5 changes one base of block 0, class 7 damages block 2.
_RECORDS = _RAW + f"""
rec0 as (
  select *, r_start as "start", r_end as "end", case when strand = '-' then r_end - 1 else r_start end as anchor,
    case when ec = 5 then substr(umi_true, 1, 1) || (case substr(umi_true, 2, 1) when 'A' then 'C' when 'C' then 'G' else 'A' end) || substr(umi_true, 3, 2) else substr(umi_true, 1, 4) end as b0,
    substr(umi_true, 5, 4) as b1, case when ec = 7 then substr(umi_true, 9, 1) || 'T' || substr(umi_true, 11, 2) else substr(umi_true, 9, 4) end as b2, substr(umi_true, 13, 4) as b3,
    case when ec in (3, 7) then 1 else 0 end as edits, ec = 7 as damaged
  from raw),
rec as (select *, case when damaged then 1152921504606846976 else 0 end + {_KEY} as umi_key from rec0),"""
_USED = _RECORDS + """
used as (select * from rec where flag in (0, 16) and mapq >= 1 and rx is not null and not (has_sa and strand <> '.' and clip5 > 60)),"""
_LOCI = _USED + """
l0 as (select *, max("end") over (partition by tid, strand order by "start", ordinal rows between unbounded preceding and 1 preceding) as before from used),
l1 as (select *, case when before is null or "start" >= before + 20 then ordinal end as opens from l0),
loci as (select *, last_value(opens ignore nulls) over (partition by tid, strand order by "start", ordinal rows between unbounded preceding and current row) as locus_id from l1),"""
_NODES = _LOCI + """
n0 as (select *, case when strand = '.' then 0 when anchor - lag(anchor) over (partition by locus_id, umi_key order by anchor, ordinal) > 20 then 1 else 0 end as gap from loci),
n1 as (select *, sum(gap) over (partition by locus_id, umi_key order by anchor, ordinal rows between unbounded preceding and current row) as component from n0),
n2 as (select locus_id, umi_key, component, min(b0) as b0, min(b1) as b1, min(b2) as b2, min(b3) as b3, bool_and(damaged) as damaged, min(strand) as strand, count(*) as cnt, min(anchor) as amin, max(anchor) as amax from n1 group by 1, 2, 3),
nodes as (select *, row_number() over (partition by locus_id order by umi_key, amin) as node_id from n2),
reads as (select n1.*, nodes.node_id from n1 join nodes using (locus_id, umi_key, component)),"""
_REACH = "case when {m} * 513 / 43046721.0 <= 0.01 then 2 else 1 end"
_HURT = "case when {m} * 4993 / 43046721.0 <= 0.5 then 3 when {m} * 513 / 43046721.0 <= 0.5 then 2 else 1 end"
_DENSE = _NODES + f"""
dense0 as (
  select n.locus_id, n.node_id, count(*) filter (where not m.damaged and (n.strand = '.' or m.amin between n.amin - 20 and n.amax + 20)) as density
  from nodes n join nodes m on n.locus_id = m.locus_id group by 1, 2),
dense as (select nodes.*, density, case when damaged then {_HURT.format(m='density')} else {_REACH.format(m='density')} end as own_reach from nodes join dense0 using (locus_id, node_id)),"""
_DIST = "levenshtein(u.b0, v.b0) + levenshtein(u.b1, v.b1) + levenshtein(u.b2, v.b2) + levenshtein(u.b3, v.b3)"
_NEAR = "(u.strand = '.' or greatest(v.amin - u.amax, u.amin - v.amax) <= 20)"
_PAIRS = _DENSE + f"""
near as (
  select u.locus_id, u.node_id as u_id, v.node_id as v_id, {_DIST} as dist
  from dense u join dense v on u.locus_id = v.locus_id and u.node_id < v.node_id and not u.damaged and not v.damaged and {_NEAR}
  where {_DIST} <= least(u.own_reach, v.own_reach)),"""
_CREDIT = _PAIRS + f"""
credit0 as (
  select u.locus_id, u.node_id, v.node_id as parent, {_DIST} as dist, row_number() over (partition by u.locus_id, u.node_id order by {_DIST}, v.cnt desc, v.node_id) as r
  from dense u join dense v on u.locus_id = v.locus_id and u.damaged and not v.damaged and {_NEAR} where {_DIST} <= u.own_reach),
credit as (select locus_id, node_id, parent, dist from credit0 where r = 1),
weighted as (
  select d.*, d.cnt + coalesce(x.extra, 0) as weight from dense d
  left join (select c.locus_id, c.parent as node_id, sum(n.cnt) as extra from credit c join nodes n using (locus_id, node_id) group by 1, 2) x using (locus_id, node_id)
  where not d.damaged),"""
_EDGES = _CREDIT + f"""
gated as (
  select near.locus_id, u_id, v_id, dist, u.weight as wu, v.weight as wv from near
  join weighted u on u.locus_id = near.locus_id and u.node_id = u_id join weighted v on v.locus_id = near.locus_id and v.node_id = v_id
  where dist < 2 or (dist <= {_REACH.format(m='greatest(u.density, v.density)')} and least(u.weight, v.weight) <= 2)),
edges as (
  select locus_id, u_id as src, v_id as dst, dist from gated where wu >= 2 * wv - 1
  union all select locus_id, v_id, u_id, dist from gated where wv >= 2 * wu - 1),"""
_CLUSTERS = _EDGES + """
ranked as (select *, row_number() over (partition by locus_id order by weight desc, umi_key, amin) as rank from weighted),
walk as (
  select locus_id, node_id, rank as label from ranked
  union select w.locus_id, e.dst, w.label from walk w join edges e on e.locus_id = w.locus_id and e.src = w.node_id),
labelled as (select locus_id, node_id, min(label) as label from walk group by 1, 2),
clusters as (select l.locus_id, l.node_id, s.node_id as seed from labelled l join ranked s on s.locus_id = l.locus_id and s.rank = l.label),"""
#: Damaged nodes without a parent, one after another: a row of state (homes, totals) per locus and turn.
_LEFTOVERS = _CLUSTERS + f"""
homed as (select c.locus_id, c.node_id, k.seed from credit c join clusters k on k.locus_id = c.locus_id and k.node_id = c.parent),
left0 as (
  select d.*, row_number() over (partition by d.locus_id order by d.cnt desc, d.umi_key, d.amin) as turn
  from dense d left join credit c on c.locus_id = d.locus_id and c.node_id = d.node_id where d.damaged and c.node_id is null),
offers as (
  select u.locus_id, u.node_id, list({{'other': v.node_id, 'cnt': v.cnt, 'dist': {_DIST}}}) as offered
  from left0 u join dense v on u.locus_id = v.locus_id and v.damaged and u.node_id <> v.node_id and {_NEAR}
  where {_DIST} <= u.own_reach and (u.b0 = v.b0 or u.b1 = v.b1 or u.b2 = v.b2 or u.b3 = v.b3) group by 1, 2),
lefts as (select left0.locus_id, left0.node_id, left0.cnt, left0.turn, coalesce(offered, []) as offered from left0 left join offers on offers.locus_id = left0.locus_id and offers.node_id = left0.node_id),
totals0 as (select locus_id, seed, cast(sum(weight) as bigint) as total from clusters join weighted using (locus_id, node_id) group by 1, 2),
starts as (
  select l.locus_id, coalesce(h.homes, map([]::bigint[], []::bigint[])) as homes, coalesce(t.totals, map([]::bigint[], []::bigint[])) as totals
  from (select distinct locus_id from left0) l
  left join (select locus_id, map(list(cast(node_id as bigint)), list(cast(seed as bigint))) as homes from homed group by 1) h on h.locus_id = l.locus_id
  left join (select locus_id, map(list(cast(seed as bigint)), list(total)) as totals from totals0 group by 1) t on t.locus_id = l.locus_id),
turns as (
  select locus_id, cast(0 as bigint) as turn, homes, totals, cast(null as bigint) as node_id, cast(null as bigint) as seed from starts
  union all
  select locus_id, turn, map_concat(homes, map([node_id], [seed])), map_concat(totals, map([seed], [coalesce(totals[seed], 0) + cnt])), node_id, seed
  from (
    select locus_id, turn, homes, totals, node_id, cnt, coalesce(homes[list_sort(best)[1].other], node_id) as seed
    from (
      select t.locus_id, cast(t.turn + 1 as bigint) as turn, t.homes, t.totals, cast(l.node_id as bigint) as node_id, cast(l.cnt as bigint) as cnt,
        list_transform(list_filter(l.offered, lambda x: map_contains(t.homes, cast(x.other as bigint))), lambda x: {{'dist': cast(x.dist as bigint), 'less': -t.totals[t.homes[cast(x.other as bigint)]], 'few': -cast(x.cnt as bigint), 'other': cast(x.other as bigint)}}) as best
      from turns t join lefts l on l.locus_id = t.locus_id and l.turn = t.turn + 1))),
leftovers as (select locus_id, node_id, seed from turns where turn > 0),"""
_MEMBERS = _LEFTOVERS + """
homes as (select locus_id, node_id, seed from clusters union all select locus_id, node_id, seed from homed union all select locus_id, node_id, seed from leftovers),
members as (select r.*, h.seed from reads r join homes h using (locus_id, node_id)),"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived records, through a checkpoint: filters on what is costly to derive would derive it again."""
    return cut_lineage(testdata.records(spark, sf_dir, CONFIG))


def _used(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testdata.used_reads(spark, sf_dir, CONFIG)


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loci.loci(_used(spark, sf_dir), CONFIG.pos_tol)


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_lineage(neighbours.with_reach(neighbours.density(nodes.nodes(_placed(spark, sf_dir), CONFIG)[1], CONFIG), CONFIG))


def _weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense = _dense(spark, sf_dir)
    return cut_lineage(neighbours.weights(dense, neighbours.credits(dense, CONFIG)))


#: What the steps from loci to molecules never read.
UNREAD = ("mol", "g", "flag", "mapq", "rx", "ec", "umi_true", "edits")
#: What the molecules' members no longer need once their nodes are known.
PLACED = ("b0", "b1", "b2", "b3", "umi_key", "damaged", "alt_anchor", "alt_exon", "clip5", "island", "component")


def _members(spark: SparkSession, sf_dir: str, used: DataFrame | None = None) -> DataFrame:
    """All used reads with the seeds of their molecules."""
    found = _used(spark, sf_dir).drop(*UNREAD) if used is None else used.drop(*UNREAD[1:])
    reads, table = map(cut_lineage, nodes.nodes(loci.loci(found, CONFIG.pos_tol), CONFIG))
    return cut_lineage(clusters.assign(reads.drop(*PLACED), table, clusters.place(table, CONFIG).homes))


@query(_RAW + """
d as (select case when (flag & 4) <> 0 or tid < 0 then 'unmapped' when (flag & 2304) <> 0 then 'secondary_supplementary' when mapq < 1 then 'low_mapq' when coalesce(qs, 0) < 0 then 'low_qs'
  when rx is null then 'no_RX' when has_sa and strand <> '.' and clip5 > 60 then 'chimeric_umi_end' else 'used' end as reason from raw)
select reason, count(*) as n from d group by reason""")
def drop_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filters.drop_reasons(_records(spark, sf_dir), CONFIG)
    return found.groupBy(F.coalesce("drop_reason", F.lit("used")).alias("reason")).agg(F.count("*").alias("n"))


@query("""
with t as (select event_id, case event_id % 4 when 0 then '+' when 1 then '-' when 2 then '?' end as ts1, case event_id % 3 when 0 then '+' when 1 then '-' end as ts2, event_id % 5 < 2 as rev from events),
s as (select *, case when ts1 = '+' then case when rev then '-' else '+' end when ts1 = '-' then case when rev then '+' else '-' end else '.' end as s1,
  case when ts2 = '+' then case when rev then '-' else '+' end when ts2 = '-' then case when rev then '+' else '-' end else '.' end as s2 from t)
select event_id, case when s1 <> '.' then s1 else s2 end as strand from s""")
def strand_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    ts1 = F.when(e % 4 == 0, "+").when(e % 4 == 1, "-").when(e % 4 == 2, "?")
    ts2 = F.when(e % 3 == 0, "+").when(e % 3 == 1, "-")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", geo.resolved_strand(ts1, ts2, e % 5 < 2).alias("strand"))


_CIGAR = "concat(cast(clip5 as {t}), 'S', cast(j_start - r_start as {t}), 'M2I', cast(j_end - j_start as {t}), 'N', cast(r_end - j_end as {t}), 'M7H')"


@query(_RAW + """
c as (select * from raw where j_start > r_start and r_end > j_end)
select ordinal, cast(r_start as int) as g_start, cast(r_end as int) as g_end, cast(clip5 as int) as left_clip, 7 as right_clip, cast(j_start - r_start + r_end - j_end as int) as exonic, cast(j_start as int) as js, cast(j_end as int) as je from c""")
def cigar_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = testdata.raw_reads(spark, sf_dir).filter("j_start > r_start and r_end > j_end").withColumn("cigar", F.expr(_CIGAR.format(t="string")))
    g = raw.select("ordinal", geo.geometry(F.col("r_start"), geo.cigar_ops(F.col("cigar"))).alias("g"))
    return g.select("ordinal", F.col("g.start").alias("g_start"), F.col("g.end").alias("g_end"), F.col("g.left").alias("left_clip"), F.col("g.right").alias("right_clip"), F.col("g.exonic_len").alias("exonic"), F.col("g.junctions")[0]["s"].alias("js"), F.col("g.junctions")[0]["e"].alias("je"))


@query(_USED + """x as (select ordinal, unnest([{'s': r_start, 'e': j_start}, {'s': j_end, 'e': r_end}]) as b from used)
select ordinal, cast(b.s as bigint) as s, cast(b.e as bigint) as e from x""")
def aligned_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = _used(spark, sf_dir)
    return used.select("ordinal", F.explode(geo.aligned_blocks(F.col("start"), F.col("end"), F.col("junctions"))).alias("b")).select("ordinal", F.col("b.s").alias("s"), F.col("b.e").alias("e"))


@query(_RECORDS + "z as (select 1) select ordinal, b0, b1, b2, b3, cast(edits as int) as edits, damaged, cast(umi_key as bigint) as umi_key from rec where rx is not null and edits = 0")
def umi_clean_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).filter("edits = 0").select("ordinal", "b0", "b1", "b2", "b3", "edits", "damaged", "umi_key")


@query(_RECORDS + "z as (select 1) select ordinal, b0, b1, b2, b3, cast(edits as int) as edits, damaged, cast(umi_key as bigint) as umi_key from rec where rx is not null and edits > 0")
def umi_decode_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).filter("edits > 0").select("ordinal", "b0", "b1", "b2", "b3", "edits", "damaged", "umi_key")


@query(_LOCI + "z as (select 1) select ordinal, cast(locus_id as bigint) as locus_id from loci")
def locus_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir).select("ordinal", "locus_id")


@query(_LOCI + """z as (select 1) select cast(tid as bigint) as tid, strand, cast(min("start") as bigint) as locus_start, cast(max("end") as bigint) as locus_end, count(*) as n_reads from loci group by tid, strand, locus_id""")
def locus_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_loci(_used(spark, sf_dir), CONFIG.pos_tol)


@query(_NODES + """z as (select 1) select cast(locus_id as bigint) as locus_id, cast(node_id as bigint) as node_id, cast(umi_key as bigint) as umi_key, damaged, cast(cnt as bigint) as cnt, cast(amin as bigint) as amin, cast(amax as bigint) as amax from nodes""")
def anchor_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.nodes(_placed(spark, sf_dir), CONFIG)[1].select("locus_id", "node_id", "umi_key", "damaged", "cnt", "amin", "amax")


_BRIDGE = """with recursive b as (select event_id as ordinal, user_id % 50 as locus_id, user_id % 7 as umi_key, (event_id * 37) % 4000 as anchor, event_id % 40 as clip5,
  case when event_id % 5 = 0 then (event_id * 53) % 4000 end as alt_anchor, case when event_id % 5 = 0 then 10 + event_id % 40 end as alt_exon from events),"""


@query(_BRIDGE + """
g0 as (select *, case when anchor - lag(anchor) over (partition by locus_id, umi_key order by anchor, ordinal) > 20 then 1 else 0 end as gap from b),
g as (select *, sum(gap) over (partition by locus_id, umi_key order by anchor, ordinal rows between unbounded preceding and current row) as island from g0)
select distinct cast(x.locus_id as bigint) as locus_id, cast(x.umi_key as bigint) as umi_key, cast(x.island as bigint) as a, cast(y.island as bigint) as b
from g x join g y on x.locus_id = y.locus_id and x.umi_key = y.umi_key and x.alt_anchor is not null and abs(y.anchor - x.alt_anchor) <= 20 and y.clip5 >= greatest(x.alt_exon // 2, 5) and x.island <> y.island""")
def short_exon_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    i, some = F.col("event_id"), F.col("event_id") % 5 == 0
    rows = e.select(i.alias("ordinal"), (F.col("user_id") % 50).alias("locus_id"), (F.col("user_id") % 7).alias("umi_key"), ((i * 37) % 4000).alias("anchor"), (i % 40).alias("clip5"), F.when(some, (i * 53) % 4000).alias("alt_anchor"), F.when(some, 10 + i % 40).alias("alt_exon"), F.lit("+").alias("strand"))
    return nodes.bridges(nodes.linked(rows, CONFIG), CONFIG)


@query(_NODES + f"""z as (select 1) select cast(u.locus_id as bigint) as locus_id, cast(u.node_id as bigint) as u_id, cast(v.node_id as bigint) as v_id, cast({_DIST} as int) as dist
from nodes u join nodes v on u.locus_id = v.locus_id and v.node_id = u.node_id + 1""")
def blockwise_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = nodes.nodes(_placed(spark, sf_dir), CONFIG)[1].select("locus_id", "node_id", "b0", "b1", "b2", "b3")
    v = table.select("locus_id", (F.col("node_id") - 1).alias("node_id"), *[F.col(f"b{k}").alias(f"v{k}") for k in range(4)])
    dist = umi.distance([F.col(f"b{k}") for k in range(4)], [F.col(f"v{k}") for k in range(4)])
    return table.join(v, ["locus_id", "node_id"]).select("locus_id", F.col("node_id").alias("u_id"), (F.col("node_id") + 1).alias("v_id"), dist.alias("dist"))


@query(_DENSE + "z as (select 1) select cast(locus_id as bigint) as locus_id, cast(node_id as bigint) as node_id, cast(density as bigint) as density, cast(own_reach as int) as own_reach from dense")
def density_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir).select("locus_id", "node_id", "density", "own_reach")


@query(_PAIRS + "z as (select 1) select cast(locus_id as bigint) as locus_id, cast(u_id as bigint) as u_id, cast(v_id as bigint) as v_id, cast(dist as int) as dist from near")
def umi_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neighbours.neighbour_pairs(_dense(spark, sf_dir).filter("not damaged"), CONFIG)
    return found.select("locus_id", F.col("u.node_id").alias("u_id"), F.col("v.node_id").alias("v_id"), "dist")


@query(_CREDIT + "z as (select 1) select cast(locus_id as bigint) as locus_id, cast(node_id as bigint) as node_id, cast(parent as bigint) as parent, cast(dist as int) as dist from credit")
def damaged_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.credits(_dense(spark, sf_dir), CONFIG).select("locus_id", "node_id", "parent", "dist")


@query(_EDGES + "z as (select 1) select cast(locus_id as bigint) as locus_id, cast(src as bigint) as src, cast(dst as bigint) as dst, cast(dist as int) as dist from edges")
def directional_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.directed_edges(_weighted(spark, sf_dir), CONFIG).select("locus_id", "src", "dst", "dist")


@query(_CLUSTERS + "z as (select 1) select cast(locus_id as bigint) as locus_id, cast(node_id as bigint) as node_id, cast(seed as bigint) as seed from clusters")
def directional_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighted = _weighted(spark, sf_dir)
    return clusters.directional(weighted, neighbours.directed_edges(weighted, CONFIG)).select("locus_id", "node_id", "seed")


#: Nodes with many damaged barcodes that are alike: leftovers join one another, earlier leftovers and placed ones, and tie.
_HURT_NODES = """with recursive e as (
  select event_id as i, event_id % 150 as locus_id, event_id % 7 < 5 as damaged from events),
n0 as (
  select locus_id, damaged, concat('AC', substr('ACGT', cast(i // 3 % 4 + 1 as int), 1), substr('ACG', cast(i // 11 % 3 + 1 as int), 1)) as b0, concat('GA', substr('ACG', cast(i // 5 % 3 + 1 as int), 1), 'C') as b1,
    case when damaged then concat(substr('ACG', cast(i // 13 % 3 + 1 as int), 1), 'TG') else concat(substr('ACG', cast(i // 13 % 3 + 1 as int), 1), 'CGA') end as b2, concat('CC', substr('ACG', cast(i // 17 % 3 + 1 as int), 1), substr('ACG', cast(i // 23 % 3 + 1 as int), 1)) as b3,
    1000 + i // 150 % 7 * 9 as anchor from e),
rec1 as (select *, contains(b0, 'T') or damaged as hurt from n0),"""
_HURT_SQL = _HURT_NODES + f"""
rec as (select locus_id, hurt as damaged, b0, b1, b2, b3, anchor, case when hurt then 1152921504606846976 else 0 end + {_KEY} as umi_key from rec1),
n2 as (select locus_id, umi_key, anchor // 30 as place, min(b0) as b0, min(b1) as b1, min(b2) as b2, min(b3) as b3, bool_and(damaged) as damaged, '+' as strand, count(*) as cnt, min(anchor) as amin, max(anchor) as amax from rec group by 1, 2, 3),
nodes as (select *, row_number() over (partition by locus_id order by umi_key, amin) as node_id from n2),""" + _LEFTOVERS[len(_NODES):]


@query(_HURT_SQL + "z as (select 1) select cast(locus_id as bigint) as locus_id, node_id, seed from leftovers")
def damaged_leftovers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over nodes derived from events of which most are damaged; the order within a locus decides."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    rows = spark.sql(_HURT_NODES.replace("with recursive", "with").replace("from events", "from {events}").replace("//", "div").rstrip(",") + " select * from rec1", events=events)
    blocks = [F.col(f"b{k}") for k in range(4)]
    keyed = rows.withColumn("damaged", F.col("hurt")).withColumn("umi_key", umi.packed_key(blocks, F.col("hurt"))).withColumn("place", F.floor(F.col("anchor") / 30))
    grouped = keyed.groupBy("locus_id", "umi_key", "place").agg(*[F.first(f"b{k}").alias(f"b{k}") for k in range(4)], F.first("damaged").alias("damaged"), F.lit("+").alias("strand"), F.count("*").alias("cnt"), F.min("anchor").alias("amin"), F.max("anchor").alias("amax"), F.lit(0).alias("max_clip5"))
    table = grouped.withColumn("alts", F.array().cast("array<struct<pos:bigint,exon:bigint>>")).withColumn("node_id", F.row_number().over(Window.partitionBy("locus_id").orderBy("umi_key", "amin")).cast("long"))
    dense = cut_lineage(neighbours.with_reach(neighbours.density(cut_lineage(table), CONFIG), CONFIG))
    parents = cut_lineage(neighbours.credits(dense, CONFIG))
    weighted = cut_lineage(neighbours.weights(dense, parents))
    return clusters.leftovers(dense, parents, clusters.directional(weighted, neighbours.directed_edges(weighted, CONFIG)), CONFIG)


_SUMMARY = """select cast(locus_id as bigint) as locus_id, cast(seed as bigint) as seed, count(*) as n_reads, cast(floor(median(anchor)) as bigint) as anchor,
  case when max(coalesce(pt, -2)) >= 0 then 'Y' when max(coalesce(pt, -2)) = -1 then 'N' else '?' end as polya, cast(coalesce(floor(median(case when pt > 0 then pt end)), 0) as bigint) as polya_len from members group by locus_id, seed"""


@query(_MEMBERS + "z as (select 1) " + _SUMMARY)
def molecule_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return molecules.summary(_members(spark, sf_dir)).select("locus_id", "seed", "n_reads", "anchor", "polya", "polya_len")


_VOTES = _MEMBERS + """
sup as (select locus_id, seed, j_start as s, j_end as e, count(*) as support from members group by 1, 2, 3, 4),
votes as (
  select sup.locus_id, sup.seed, s, e, support, count(*) filter (where m."start" <= s and m."end" >= e) as spanning
  from sup join members m on m.locus_id = sup.locus_id and m.seed = sup.seed group by 1, 2, 3, 4, 5),
judged as (select *, support >= 2 and 2 * support > spanning as supported, 2 * support < spanning or support = 1 as bad from votes),"""


@query(_VOTES + "z as (select 1) select cast(locus_id as bigint) as locus_id, cast(seed as bigint) as seed, cast(s as bigint) as s, cast(e as bigint) as e, support, spanning, supported, bad from judged")
def junction_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return representative.junction_votes(_members(spark, sf_dir))


@query(_MEMBERS + """r as (select *, row_number() over (partition by locus_id, seed order by exonic_len desc, qs desc, ordinal) as k, count(*) over (partition by locus_id, seed, j_start, j_end) as same_chain from members)
select cast(locus_id as bigint) as locus_id, cast(seed as bigint) as seed, ordinal as rep_ordinal, cast(0 as bigint) as disagreements, same_chain, false as switched from r where k = 1""")
def representative_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return representative.longest(_members(spark, sf_dir))


_CONSENSUS = _VOTES + """
pen as (
  select m.locus_id, m.seed, m.ordinal, count(*) filter (where (j.bad and m.j_start = j.s and m.j_end = j.e) or (j.supported and m."start" <= j.s and m."end" >= j.e and not (m.j_start = j.s and m.j_end = j.e))) as penalty
  from members m join judged j on j.locus_id = m.locus_id and j.seed = m.seed group by 1, 2, 3),
r as (
  select m.*, p.penalty, count(*) over (partition by m.locus_id, m.seed) as n_reads,
    row_number() over (partition by m.locus_id, m.seed order by p.penalty, (m.pt >= 0) desc, m.has_sa, m.exonic_len desc, m.qs desc, m.ordinal) as k,
    row_number() over (partition by m.locus_id, m.seed order by m.exonic_len desc, m.qs desc, m.ordinal) as plain, count(*) over (partition by m.locus_id, m.seed, m.j_start, m.j_end) as same_chain
  from members m join pen p on p.locus_id = m.locus_id and p.seed = m.seed and p.ordinal = m.ordinal),"""


@query(_CONSENSUS + """z as (select 1)
select cast(locus_id as bigint) as locus_id, cast(seed as bigint) as seed, ordinal as rep_ordinal, cast(case when n_reads = 1 then 0 else penalty end as bigint) as disagreements, same_chain, plain <> 1 as switched from r where k = 1""")
def representative_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return representative.consensus(_members(spark, sf_dir))


_MI = _CONSENSUS + """rep as (select *, row_number() over (order by ordinal) as mi from r where k = 1),"""


def _numbered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    members = _members(spark, sf_dir)
    return members, molecules.number(molecules.summary(members).join(representative.consensus(members), representative.MOLECULE))


@query(_MI + "z as (select 1) select cast(locus_id as bigint) as locus_id, cast(seed as bigint) as seed, ordinal as rep_ordinal, mi from rep")
def mi_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(spark, sf_dir)[1].select("locus_id", "seed", "rep_ordinal", "mi")


@query(_MI + "z as (select 1) select ordinal, flag, mi, n_reads from rep")
def filter_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found = _numbered(spark, sf_dir)
    return molecules.filter_mode(testdata.raw_reads(spark, sf_dir).select("ordinal", "flag"), found).select("ordinal", "flag", "mi", "n_reads")


@query(_MI + """z as (select 1)
select raw.ordinal, cast(case when m.ordinal is null then raw.flag when m.ordinal = rep.ordinal then raw.flag & ~1024 else raw.flag | 1024 end as int) as flag, rep.mi, coalesce(m.ordinal = rep.ordinal, false) as is_rep
from raw left join members m on m.ordinal = raw.ordinal left join rep on rep.locus_id = m.locus_id and rep.seed = m.seed""")
def mark_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, found = _numbered(spark, sf_dir)
    return molecules.mark_mode(testdata.raw_reads(spark, sf_dir).select("ordinal", "flag"), members, found).select("ordinal", "flag", "mi", "is_rep")


@query(_MI + """h as (select n_reads, row_number() over (order by n_reads) - 1 as i, count(*) over () as n from rep)
select cast(max(n_reads) filter (where i = floor((n - 1) * 0.5 + 0.5)) as bigint) as p50, cast(max(n_reads) filter (where i = floor((n - 1) * 0.9 + 0.5)) as bigint) as p90, cast(max(n_reads) as bigint) as max from h""")
def size_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return molecules.size_percentiles(molecules.summary(_members(spark, sf_dir)))


_GENES = """with g as (select range as g, range % 3 as tid, case when range % 7 = 6 then '.' when range % 2 = 0 then '+' else '-' end as strand, 10000 + 5000 * range as lo from range(40))"""


@query(_GENES + """ select tid, g * 5 as gene_idx, lo as s, lo + 150 as e from g union all select tid, g * 5, lo + 250, lo + 1000 from g""")
def gene_exon_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotation.genes(testdata.features(spark)).select("tid", "gene_idx", F.explode("exons").alias("x")).select("tid", "gene_idx", F.col("x.s").alias("s"), F.col("x.e").alias("e"))


@query(_GENES + " select tid, lo + 150 as s, lo + 250 as e from g")
def annotated_introns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = testdata.features(spark)
    return annotation.introns(annotation.transcripts(found, annotation.genes(found)))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = _used(spark, sf_dir)
    return used.select("ordinal", "tid", "strand", geo.aligned_blocks(F.col("start"), F.col("end"), F.col("junctions")).alias("blocks"))


_GENE_SQL = _USED + """genes as (select range as g, range % 3 as tid, case when range % 7 = 6 then '.' when range % 2 = 0 then '+' else '-' end as strand, 10000 + 5000 * range as lo from range(40)),
shared as (
  select u.ordinal, genes.g, greatest(0, least(u.j_start, lo + 150) - greatest(u.r_start, lo)) + greatest(0, least(u.r_end, lo + 150) - greatest(u.j_end, lo)) as first,
    greatest(0, least(u.j_start, lo + 1000) - greatest(u.r_start, lo + 250)) + greatest(0, least(u.r_end, lo + 1000) - greatest(u.j_end, lo + 250)) as last
  from used u join genes on u.tid = genes.tid and (u.strand = genes.strand or u.strand = '.' or genes.strand = '.') and lo < u.r_end and lo + 1000 > u.r_start),"""


@query(_GENE_SQL + "z as (select 1) select ordinal, cast(g * 5 as bigint) as gene_idx, concat('G', g) as gene_id from shared where first + last > 0")
def gene_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotation.gene_overlaps(_blocks(spark, sf_dir), annotation.genes(testdata.features(spark)))


@query(_GENE_SQL + """parts as (
  select s.ordinal, s.g, first, greatest(0, least(u.j_start, lo + 450) - greatest(u.r_start, lo + 250)) + greatest(0, least(u.r_end, lo + 450) - greatest(u.j_end, lo + 250)) as ended
  from shared s join used u using (ordinal) join genes on genes.g = s.g where first + last > 0)
select ordinal, min(concat('S', g)) as fl_tx from parts where first + ended > 0.8 * 350 and first >= 25 and ended >= 25 group by ordinal""")
def full_length_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At the default coverage: the genes' short transcripts are covered, the long ones never."""
    found = testdata.features(spark)
    table, blocks = annotation.genes(found), _blocks(spark, sf_dir)
    return annotation.full_length(blocks, annotation.gene_overlaps(blocks, table), annotation.transcripts(found, table), CONFIG.fl_cov, CONFIG.fl_terminal)


_PCT = r"regexp_replace(format('{{:.2f}}', case when {whole} = 0 then 0.0 else floor(10000.0 * {part} / {whole} + 0.5) / 100 end), '\.?0+$', '')"
_REPORT = {
    "total_records": "(select count(*) from rec)",
    **{f"dropped_{name}": f"(select count(*) from reasons where reason = '{name}')" for name in filters.REASONS},
    "umi_clean": "(select count(*) from used where edits = 0)", "umi_anchor_repaired": "(select count(*) from used where edits > 0 and not damaged)", "umi_block_damaged": "(select count(*) from used where damaged)",
    "umi_block_damaged_pct": _PCT.format(part="(select count(*) from used where damaged)", whole="(select count(*) from used)"),
    "strand_from_TS": "(select count(*) from used where strand <> '.')", "strand_from_ts": "0", "strand_unknown": "(select count(*) from used where strand = '.')",
    "reads_used": "(select count(*) from used)", "bundles": "(select count(distinct locus_id) from loci)", "max_bundle_reads": "(select max(n) from (select count(*) as n from loci group by locus_id))",
    "umi_nodes": "(select count(*) from nodes)", "umi_nodes_damaged": "(select count(*) from nodes where damaged)", "umi_position_splits": "(select count(*) - count(distinct (locus_id, umi_key)) from nodes)", "short_exon_bridges": "0",
    "directional_merges": "(select count(*) from clusters where node_id <> seed)", "density_gated_edges": "(select count(*) from (select distinct locus_id, least(src, dst), greatest(src, dst) from edges where dist >= 2))",
    "damaged_to_valid": "(select count(*) from credit)", "damaged_attached_beyond_1_edit": "(select count(*) from credit where dist >= 2)",
    "damaged_to_damaged": "(select count(*) from leftovers where node_id <> seed)", "damaged_seeds": "(select count(*) from leftovers where node_id = seed)",
    "molecules_out": "(select count(*) from rep)", "pcr_duplicate_reads": "(select (select count(*) from used) - count(*) from rep)",
    "pcr_duplicate_pct": _PCT.format(part="(select (select count(*) from used) - count(*) from rep)", whole="(select count(*) from used)"),
    "singleton_molecules": "(select count(*) from rep where n_reads = 1)",
    "cluster_size_p50": "(select max(n_reads) from ranks where i = floor((n - 1) * 0.5 + 0.5))", "cluster_size_p90": "(select max(n_reads) from ranks where i = floor((n - 1) * 0.9 + 0.5))", "cluster_size_max": "(select max(n_reads) from rep)",
    "rep_switched_by_consensus": "(select count(*) from rep where plain <> 1)", "rep_disagreements": "(select sum(case when n_reads = 1 then 0 else penalty end)::bigint from rep)",
    "full_length_molecules": "0", "full_length_pct": "0",
    "polya_anchor_molecules": "(select count(*) from facts where polya = 'Y')", "polya_anchor_pct": _PCT.format(part="(select count(*) from facts where polya = 'Y')", whole="(select count(*) from facts where polya <> '?')"),
    "polya_missing_tag_molecules": "(select count(*) from facts where polya = '?')", "full_length_both_signals": "0", "records_written": "(select count(*) from rep)",
}


@query(_MI + f"""facts as ({_SUMMARY}),
reasons as (select case when (flag & 4) <> 0 or tid < 0 then 'unmapped' when (flag & 2304) <> 0 then 'secondary_supplementary' when mapq < 1 then 'low_mapq' when coalesce(qs, 0) < 0 then 'low_qs'
  when rx is null then 'no_RX' when has_sa and strand <> '.' and clip5 > 60 then 'chimeric_umi_end' else 'used' end as reason from raw),
ranks as (select n_reads, row_number() over (order by n_reads) - 1 as i, count(*) over () as n from rep),
z as (select unnest([{", ".join("{'line': " + str(i + 1) + ", 'metric': '" + m + "', 'value': cast(" + v + " as varchar)}" for i, (m, v) in enumerate(_REPORT.items()))}]) as x)
select cast(x.line as int) as line, x.metric as metric, x.value as value from z""")
def stats_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.when(F.col("strand") == ".", "unknown").otherwise("TS")
    reasons = filters.drop_reasons(_records(spark, sf_dir).withColumn("strand_source", source), CONFIG)
    # The report counts edits; the rest is never read.
    used = reasons.filter("drop_reason is null").drop("drop_reason", *[c for c in UNREAD if c != "edits"])
    return molecules.report(reasons, deduplicate(used, CONFIG), CONFIG)


@query(_MI + """t as (select mol, count(*) as copies from used group by mol),
s as (select count(*) as observable from t),
o as (select count(distinct mol) as seen, count(*) as reps from rep)
select observable, reps as molecules_out, reps - seen as split, observable - seen as lost from s, o""")
def truth_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Molecules out against the molecules that the reads were derived from."""
    used = _used(spark, sf_dir)
    truth = used.select("mol").distinct().agg(F.count("*").alias("observable"))
    members = _members(spark, sf_dir, used)
    seen = representative.consensus(members).join(members.select(F.col("ordinal").alias("rep_ordinal"), "mol"), "rep_ordinal").agg(F.countDistinct("mol").alias("seen"), F.count("*").alias("molecules_out"))
    # One row each.
    return truth.join(seen).select("observable", "molecules_out", (F.col("molecules_out") - F.col("seen")).alias("split"), (F.col("observable") - F.col("seen")).alias("lost"))
