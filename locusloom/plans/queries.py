"""Registered queries over the driver tables, each with its independent SQL oracle where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import views
from ..functions import sequence as seqf
from ..operators import features as ft
from ..operators import intervals as iv
from ..operators import matching as mt
from ..operators import overlap as ov
from ..operators import qnorm as qn
from ..operators import signal as sg
from ..operators import stats as st
from ..operators import tables as tb
from ..operators import values as vl
from ..session import cut_lineage, ensure_checkpoint_dir
from ..sources import store
from .oracle_views import CTES, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns])


def _r(*exprs: str, digits: int = 6) -> str:
    return ", ".join(f"round({e.split(' as ')[0]}, {digits}) as {e.split(' as ')[1]}" for e in exprs)


# ---------------------------------------------------------------- filters


@query(
    "regions_filter",
    with_views("regions")
    + """ select chrom, "start", "end", name from regions
    where regexp_matches(chrom, '^(chr)?[0-3]') and "end" - "start" >= 40""",
)
def regions_filter(spark, sf):
    from ..functions.names import matches_from_start

    r = views.regions(spark, sf)
    return r.filter(matches_from_start(F.col("chrom"), "(chr)?[0-3]") & (F.col("end") - F.col("start") >= 40)).select(
        "chrom", "start", "end", "name"
    )


@query(
    "top_percent",
    with_views("regions")
    + """ select chrom, "start", "end", name, score from regions
    where score >= (select quantile_cont(score, 0.7) from regions)""",
)
def top_percent(spark, sf):
    return vl.top_percent(views.regions(spark, sf), "score", 30)


@query(
    "region_names",
    with_views("regions")
    + """ select chrom, "start", "end", concat('region_', row_number() over (order by chrom, "start", "end") - 1) as name
    from (select chrom, "start", "end" from regions)""",
)
def region_names(spark, sf):
    plain = views.regions(spark, sf).select("chrom", "start", "end")
    numbered = tb.row_number_by_position(plain, "idx")
    return numbered.select("chrom", "start", "end", F.concat(F.lit("region_"), "idx").alias("name"))


# ---------------------------------------------------------------- interval sets

_ISLANDS = """select *, sum(case when prev is null or "start" > prev then 1 else 0 end)
    over (partition by chrom order by "start", "end", name) as g from (
    select *, max("end") over (partition by chrom order by "start", "end", name rows between unbounded preceding and 1 preceding) as prev
    from regions)"""


@query(
    "merge_overlapping",
    with_views("regions")
    + f""" select chrom, min("start") as "start", max("end") as "end", count(*) as n_merged from ({_ISLANDS}) group by chrom, g""",
)
def merge_overlapping(spark, sf):
    return iv.merge_overlapping(views.regions(spark, sf))


@query(
    "merge_names",
    with_views("regions")
    + f""" select chrom, min("start") as "start", max("end") as "end",
    string_agg(name, '-' order by "start", "end", name) as name, count(*) as n_merged from ({_ISLANDS}) group by chrom, g""",
)
def merge_names(spark, sf):
    return iv.merge_with_names(views.regions(spark, sf))


@query(
    "island_members",
    with_views("regions")
    + f""", i as ({_ISLANDS}) select chrom, "start", "end", name, min("start") over w as island_start, max("end") over w as island_end
    from i window w as (partition by chrom, g)""",
)
def island_members(spark, sf):
    r = views.regions(spark, sf).select("chrom", "start", "end", "name")
    return iv.island_members(r).select("chrom", "start", "end", "name", "island_start", "island_end")


@query(
    "merge_with_probability",
    with_views("regions")
    + f""" select chrom, min("start") as "start", max("end") as "end", round(avg(score / 50), 6) as class_prob
    from ({_ISLANDS}) group by chrom, g""",
)
def merge_with_probability(spark, sf):
    merged = iv.merge_overlapping(views.regions(spark, sf), total=F.col("score") / 50)
    return merged.select("chrom", "start", "end", F.round(F.col("total") / F.col("n_merged"), 6).alias("class_prob"))


@query(
    "coverage",
    with_views("regions")
    + """ select chrom, count(*) as numreg, cast(sum("end" - "start") as bigint) as covbp from regions group by chrom""",
)
def coverage(spark, sf):
    return iv.coverage(views.regions(spark, sf))


@query(
    "mask_complement",
    with_views("islands_of_blocks", "sizes")
    + """ , edges as (select chrom, "start", "end" from islands_of_blocks
      union all select chrom, -1, 0 from sizes union all select chrom, size, size from sizes)
    select chrom, "end" as "start", nxt as "end" from (
      select chrom, "end", lead("start") over (partition by chrom order by "start", "end") as nxt from edges)
    where nxt > "end" """,
)
def mask_complement(spark, sf):
    return iv.gaps(views.target_blocks(spark, sf), views.sizes(spark, sf))


@query(
    "mask_runs",
    with_views("islands_of_blocks", "sizes")
    + """ , edges as (select chrom, "start", "end" from islands_of_blocks
      union all select chrom, -1, 0 from sizes union all select chrom, size, size from sizes)
    select chrom, "end" as "start", nxt as "end", false as conserved from (
      select chrom, "end", lead("start") over (partition by chrom order by "start", "end") as nxt from edges)
    where nxt > "end" union all select chrom, "start", "end", true from islands_of_blocks""",
)
def mask_runs(spark, sf):
    return iv.runs_and_select(views.target_blocks(spark, sf), views.sizes(spark, sf))


@query(
    "overlap_check",
    with_views("regions")
    + """ , f as (select chrom, "start", max("end") as "end", count(*) as n from regions group by 1, 2)
    select chrom, "start", "end", n from (select *, max("end") over (partition by chrom order by "start"
      rows between unbounded preceding and 1 preceding) as prev from f) where n > 1 or "start" < prev""",
)
def overlap_check(spark, sf):
    return iv.overlapping_rows(views.regions(spark, sf))


@query(
    "consecutive_blocks",
    """with p as (select distinct concat('chr', cast(o_custkey % 5 as varchar)) as chrom, o_orderkey as pos from orders)
    select chrom, min(pos) as "start", max(pos) + 1 as "end", count(*) as n_positions
    from (select *, pos - row_number() over (partition by chrom order by pos) as g from p) group by chrom, g""",
)
def consecutive_blocks(spark, sf):
    orders = views.table(spark, sf, "orders")
    return iv.consecutive_blocks(orders.select(views._chrom("o_custkey").alias("chrom"), F.col("o_orderkey").alias("pos")))


@query(
    "interval_intersection",
    with_views("rois", "tblocks")
    + """ select r.chrom, greatest(r."start", b."start") as "start", least(r."end", b."end") as "end"
    from rois r join tblocks b on r.chrom = b.chrom and r."start" < b."end" and r."end" > b."start" """,
)
def interval_intersection(spark, sf):
    return iv.intersect(views.rois(spark, sf), views.target_blocks(spark, sf))


# ---------------------------------------------------------------- range joins


@query(
    "roi_overlap",
    with_views("regions", "rois")
    + """ select r.name, o.name as roi, least(r."end", o."end") - greatest(r."start", o."start") as bp
    from regions r join rois o on r.chrom = o.chrom and r."start" < o."end" and r."end" > o."start" """,
)
def roi_overlap(spark, sf):
    hits = iv.range_join(views.regions(spark, sf), views.rois(spark, sf))
    bp = iv.overlap_length(F.col("start"), F.col("end"), F.col("start_r"), F.col("end_r"))
    return hits.select("name", F.col("name_r").alias("roi"), bp.alias("bp"))


@query(
    "roi_features",
    with_views("regions", "rois")
    + """ , h as (select r.name, count(*) as n, sum(least(r."end", o."end") - greatest(r."start", o."start")) as bp
      from regions r join rois o on r.chrom = o.chrom and r."start" < o."end" and r."end" > o."start" group by r.name)
    select r.chrom, r."start", r."end", r.name, case when h.n is null then 0 else 1 end as ftroi_prom_bin_obs,
      coalesce(h.n, 0) as ftroi_prom_abs_num, round(coalesce(h.bp, 0) / (r."end" - r."start")::double * 100, 6) as ftroi_prom_pct_cov
    from regions r left join h on r.name = h.name""",
)
def roi_features(spark, sf):
    r = views.regions(spark, sf).select("chrom", "start", "end", "name")
    return rounded(ft.roi_features(r, views.rois(spark, sf), "prom"), "ftroi_prom_pct_cov")


def _eval_sql(sets: list[tuple[str, str]], mode: str) -> str:
    views_used = [v for _, v in sets]
    parts = []
    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            (la, a), (lb, b) = sets[i], sets[j]
            if mode == "contained":
                cond = 'b."start" >= a."start" and b."end" <= a."end"'
                bp = 'b."end" - b."start"'
            else:
                cond = 'b."start" < a."end" and b."end" > a."start"'
                bp = 'least(a."end", b."end") - greatest(a."start", b."start")'
            parts.append(
                f"""select '{la}' as label_a, '{lb}' as label_b, c.chrom,
                (select count(*) from {a} x where x.chrom = c.chrom) as a_num,
                (select coalesce(sum("end" - "start"), 0) from {a} x where x.chrom = c.chrom) as a_cov,
                (select count(*) from {b} x where x.chrom = c.chrom) as b_num,
                (select coalesce(sum("end" - "start"), 0) from {b} x where x.chrom = c.chrom) as b_cov,
                coalesce(p.a_hits, 0) as a_hits, coalesce(p.b_hits, 0) as b_hits, coalesce(p.bp, 0) as bp
                from (select chrom from {a} union select chrom from {b}) c left join (
                  select a.chrom, count(distinct a.name) as a_hits, count(distinct b.name) as b_hits, sum({bp}) as bp
                  from {a} a join {b} b on a.chrom = b.chrom and {cond} group by a.chrom) p on c.chrom = p.chrom"""
            )
    body = " union all ".join(parts)
    return (
        with_views(*views_used)
        + f""", s as ({body})
        select label_a, label_b, coalesce(chrom, 'wg') as chrom, cast(sum(a_num) as bigint) as a_num, cast(sum(a_cov) as bigint) as a_cov,
        cast(sum(a_hits) as bigint) as a_hits, cast(sum(b_num) as bigint) as b_num, cast(sum(b_cov) as bigint) as b_cov,
        cast(sum(b_hits) as bigint) as b_hits, cast(sum(bp) as bigint) as ovl_cov_bp, cast(0 as bigint) as roi_hits,
        cast(0 as bigint) as roi_miss, cast(sum(a_num) - sum(a_hits) as bigint) as a_miss,
        cast(sum(b_num) - sum(b_hits) as bigint) as b_miss, cast(sum(a_cov) + sum(b_cov) - sum(bp) as bigint) as union_cov_bp,
        round(sum(bp)::double / (sum(a_cov) + sum(b_cov) - sum(bp))::double, 6) as jaccard
        from s group by grouping sets ((label_a, label_b, chrom), (label_a, label_b))"""
    )


@query("containment_eval", _eval_sql([("reg", "regions"), ("roi", "rois"), ("aln", "tblocks")], "contained"))
def containment_eval(spark, sf):
    sets = {"reg": views.regions(spark, sf), "roi": views.rois(spark, sf), "aln": views.target_blocks(spark, sf)}
    return rounded(ov.pairwise_overlap(sets), "jaccard")


@query("jaccard_rollup", _eval_sql([("reg", "regions"), ("aln", "tblocks")], "overlap"))
def jaccard_rollup(spark, sf):
    sets = {"reg": views.regions(spark, sf), "aln": views.target_blocks(spark, sf)}
    return rounded(ov.pairwise_overlap(sets, mode="overlap"), "jaccard")


@query(
    "roi_restricted_eval",
    with_views("regions", "rois", "tblocks")
    + """ , o as (select chrom, "start" - 1 as "start", "end" + 30 as "end" from rois),
    a as (select distinct r.* from regions r join o on r.chrom = o.chrom and r."start" > o."start" and r."end" <= o."end"),
    b as (select distinct t.* from tblocks t join o on t.chrom = o.chrom and t."start" > o."start" and t."end" <= o."end"),
    h as (select o.chrom, exists (select 1 from regions r where r.chrom = o.chrom and r."start" > o."start" and r."end" <= o."end")
       or exists (select 1 from tblocks t where t.chrom = o.chrom and t."start" > o."start" and t."end" <= o."end") as hit from o),
    p as (select a.chrom, count(distinct a.name) as a_hits, count(distinct b.name) as b_hits, sum(b."end" - b."start") as bp
       from a join b on a.chrom = b.chrom and b."start" >= a."start" and b."end" <= a."end" group by 1)
    select h.chrom, (select count(*) from a where a.chrom = h.chrom) as a_num,
      cast((select coalesce(sum("end" - "start"), 0) from a where a.chrom = h.chrom) as bigint) as a_cov, coalesce(any_value(p.a_hits), 0) as a_hits,
      (select count(*) from b where b.chrom = h.chrom) as b_num,
      cast((select coalesce(sum("end" - "start"), 0) from b where b.chrom = h.chrom) as bigint) as b_cov, coalesce(any_value(p.b_hits), 0) as b_hits,
      cast(coalesce(any_value(p.bp), 0) as bigint) as ovl_cov_bp,
      count(*) filter (hit) as roi_hits, count(*) filter (not hit) as roi_miss from h left join p on h.chrom = p.chrom group by h.chrom""",
)
def roi_restricted_eval(spark, sf):
    o = views.rois(spark, sf).select("chrom", (F.col("start") - 1).alias("start"), (F.col("end") + 30).alias("end"))
    return ov.pair_stats(views.regions(spark, sf), views.target_blocks(spark, sf), o)


@query(
    "roi_semi_join",
    with_views("regions", "rois")
    + """ select distinct r.chrom, r."start", r."end", r.name, r.score from regions r join rois o
    on r.chrom = o.chrom and r."start" > o."start" and r."end" <= o."end" """,
)
def roi_semi_join(spark, sf):
    return iv.restrict_to(views.regions(spark, sf), views.rois(spark, sf))


@query(
    "chrom_intersect",
    with_views("regions", "rois", "tblocks")
    + " select chrom from regions intersect select chrom from rois intersect select chrom from tblocks",
)
def chrom_intersect(spark, sf):
    return ov.common_chroms(views.regions(spark, sf), views.rois(spark, sf), views.target_blocks(spark, sf))


@query("chrom_union", with_views("regions", "blocks") + " select chrom from regions union select qchrom from blocks")
def chrom_union(spark, sf):
    return ov.all_chroms(views.regions(spark, sf), views.blocks(spark, sf).select(F.col("qchrom").alias("chrom")))


# ---------------------------------------------------------------- windows, motifs, associations


@query(
    "sliding_windows",
    with_views("regions")
    + """ , w as (select chrom, name as source, s, s + 20 as e from (select chrom, name, "start", "end",
       unnest(range("start", least("end" - 20, ("end" // 20)*20 - 1) + 1, 10)) as s from regions
       where least("end" - 20, ("end" // 20)*20 - 1) >= "start"))
    select chrom, source, s as "start", e as "end" from w union all
    select chrom, name, "start", "end" from regions where least("end" - 20, ("end" // 20)*20 - 1) < "start" """,
)
def sliding_windows(spark, sf):
    return ft.sliding_windows(views.regions(spark, sf), 20, 10)


@query(
    "bin_weighted",
    with_views("rois", "motif_bins")
    + """ select r.chrom, r."start", r."end", m.motif, round(sum(m.n * (least(r."end", m.bin + 250) - greatest(r."start", m.bin)) / 250.0::double)
      / (r."end" - r."start") * 100, 6) as pct
    from (select distinct chrom, "start", "end" from rois) r join motif_bins m
      on r.chrom = m.chrom and m.bin < r."end" and m.bin + 250 > r."start" group by 1, 2, 3, 4""",
)
def bin_weighted(spark, sf):
    return rounded(ft.bin_weighted_motifs(views.rois(spark, sf), views.motif_bins(spark, sf), 250), "pct")


@query(
    "motif_bin_counts",
    with_views("motif_bins") + " select chrom, bin, motif, n as count from motif_bins",
)
def motif_bin_counts(spark, sf):
    return views.motif_bins(spark, sf)


_ASSOC = (
    with_views("rois", "assoc", "track")
    + """ , u as (select distinct chrom, "start", "end" from assoc),
    px as (select u.chrom, u."start", u."end", t.value, least(u."end", t."end") - greatest(u."start", t."start") as w
      from u join track t on u.chrom = t.chrom and u."start" < t."end" and u."end" > t."start"),
    st as (select u.chrom, u."start", u."end", sum(coalesce(px.w, 0)) as n_sig, coalesce(sum(px.w * px.value), 0.0) as total,
      max(px.value) as hi, min(px.value) as lo from u left join px using (chrom, "start", "end") group by 1, 2, 3),
    sv as (select chrom, "start", "end", case when n_sig < 250 then greatest(coalesce(hi, 0), 0) else hi end as mx,
      case when n_sig < 250 then least(coalesce(lo, 0), 0) else lo end as mn, total / 250 as me from st),
    pr as (select r.name, r.chrom, r."start" as rs, a.idx, a.wt, sv.mx, sv.mn, sv.me,
      abs((a."start" + 125) - (r."start" + 20)) as dist
      from rois r join assoc a on r.chrom = a.chrom and r.name = a.name join sv on a.chrom = sv.chrom and a."start" = sv."start" and a."end" = sv."end"),
    ag as (select name, count(*) as num, avg(dist) as dme, min(dist) as dmi, max(dist) as dma, avg(mx) as mx, avg(mn) as mn, avg(me) as me,
      sum(mx * wt) / sum(wt) as wmx, sum(me * wt) / sum(wt) as wme, arg_min(mx, dist * 10 + idx) as nmx, arg_min(me, dist * 10 + idx) as nme from pr group by 1)
    select r.chrom, r."start", r."end", r.name, coalesce(num, 0) as ftasc_enh_abs_num, round(coalesce(dme, 0), 6) as ftasc_enh_abs_dist_mean,
      coalesce(dmi, 0) as ftasc_enh_abs_dist_min, coalesce(dma, 0) as ftasc_enh_abs_dist_max, round(coalesce(mx, 0), 6) as ftasc_enh_sig_abs_max,
      round(coalesce(mn, 0), 6) as ftasc_enh_sig_abs_min, round(coalesce(me, 0), 6) as ftasc_enh_sig_abs_mean,
      round(coalesce(wmx, 0), 6) as "ftasc_enh_sig_abs_wt-max", round(coalesce(wme, 0), 6) as "ftasc_enh_sig_abs_wt-mean",
      round(coalesce(nmx, 0), 6) as "ftasc_enh_sig_abs_nx-max", round(coalesce(nme, 0), 6) as "ftasc_enh_sig_abs_nx-mean"
    from rois r left join ag on r.name = ag.name"""
)


@query("assoc_regions", _ASSOC)
def assoc_regions(spark, sf):
    made = ft.associated_features(views.rois(spark, sf), views.associated(spark, sf), "enh", views.track(spark, sf), "sig")
    p = "ftasc_enh_sig_abs_"
    doubles = ["ftasc_enh_abs_dist_mean", *[p + c for c in ("max", "min", "mean", "wt-max", "wt-mean", "nx-max", "nx-mean")]]
    ints = ["ftasc_enh_abs_num", "ftasc_enh_abs_dist_min", "ftasc_enh_abs_dist_max"]
    return rounded(made.select("chrom", "start", "end", "name", *ints, *[F.col(f"`{c}`") for c in doubles]), *doubles)


# ---------------------------------------------------------------- maps


@query(
    "liftover_signal",
    with_views("tracks", "blocks")
    + """ select t.sample, b.qchrom as chrom, t.value,
      case when qstrand = 1 then qstart + greatest(t."start", tstart) - tstart else qend - (least(t."end", tend) - tstart) end as "start",
      case when qstrand = 1 then qstart + least(t."end", tend) - tstart else qend - (greatest(t."start", tstart) - tstart) end as "end"
    from tracks t join blocks b on t.chrom = b.tchrom and t."start" < b.tend and t."end" > b.tstart""",
)
def liftover_signal(spark, sf):
    return sg.map_signal(views.tracks(spark, sf), views.blocks(spark, sf))


@query(
    "dump_map_query",
    with_views("blocks")
    + """ select qchrom, qstart, qend, '+' as tstrand, blockid, tchrom, tstart, tend, case when qstrand = 1 then '+' else '-' end as qstrand from blocks""",
)
def dump_map_query(spark, sf):
    from .dump import map_rows

    return map_rows(views.blocks(spark, sf), "query", full=True)


@query(
    "map_pairs",
    with_views("blocks")
    + """ select qchrom, tchrom, count(*) as n_blocks, cast(sum(tend - tstart) as bigint) as bp,
    cast(sum(case when qstrand = -1 then 1 else 0 end) as bigint) as n_reverse from blocks group by 1, 2""",
)
def map_pairs(spark, sf):
    return views.blocks(spark, sf).groupBy("qchrom", "tchrom").agg(
        F.count(F.lit(1)).alias("n_blocks"),
        F.sum(F.col("tend") - F.col("tstart")).alias("bp"),
        F.count_if(F.col("qstrand") == -1).alias("n_reverse"),
    )


@query(
    "chain_blocks",
    """with l as (select l_orderkey as k, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as r,
        count(*) over (partition by l_orderkey) as n, cast(l_quantity as bigint) as size, l_linenumber as dt, l_linenumber + 2 as dq from lineitem),
    g as (select *, case when r = n then 0 else dt end as gt, case when r = n then 0 else dq end as gq from l),
    b as (select *, sum(size + gt) over w - size - gt as ot, sum(size + gq) over w - size - gq as oq from g window w as (partition by k order by r))
    select concat('chr', cast(o_custkey % 5 as varchar)) as tchrom, cast(k*1000 + ot as bigint) as tstart, cast(k*1000 + ot + size as bigint) as tend,
      concat('q', cast(k % 3 as varchar)) as qchrom,
      cast(case when k % 4 = 0 then 100000000000 - (k*900 + oq + size) else k*900 + oq end as bigint) as qstart,
      cast(case when k % 4 = 0 then 100000000000 - (k*900 + oq) else k*900 + oq + size end as bigint) as qend,
      case when k % 4 = 0 then -1 else 1 end as qstrand, concat(k, '.', r) as blockid
    from b join orders on k = o_orderkey""",
)
def chain_blocks(spark, sf):
    """Alignment chains spelled out as text lines from orders and line items, then parsed."""
    from pyspark.sql import Window

    from ..sources.chain import parse_chain_lines

    w = Window.partitionBy("l_orderkey")
    order = w.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    items = views.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("k"),
        F.row_number().over(order).alias("r"),
        F.count(F.lit(1)).over(w).alias("n"),
        F.col("l_quantity").cast("bigint").alias("size"),
        F.col("l_linenumber").alias("dt"),
    )
    last = F.col("r") == F.col("n")
    rows = items.select("k", "r", "size", F.when(last, 0).otherwise(F.col("dt")).alias("gt"), F.when(last, 0).otherwise(F.col("dt") + 2).alias("gq"), last.alias("last"))
    data = rows.select(
        (F.col("k") * 1000 + F.col("r")).alias("line_no"),
        F.when(F.col("last"), F.col("size").cast("string")).otherwise(F.concat_ws("\t", "size", "gt", "gq")).alias("value"),
    )
    heads = rows.groupBy("k").agg(F.sum(F.col("size") + F.col("gt")).alias("tl"), F.sum(F.col("size") + F.col("gq")).alias("ql"))
    k = F.col("k")
    head = heads.join(views.table(spark, sf, "orders"), F.col("k") == F.col("o_orderkey")).select(
        (k * 1000).alias("line_no"),
        F.concat_ws(
            " ", F.lit("chain 100"), views._chrom("o_custkey"), F.lit("100000000000 +"), k * 1000, k * 1000 + F.col("tl"),
            F.concat(F.lit("q"), k % 3), F.lit(100000000000), F.when(k % 4 == 0, "-").otherwise("+"), k * 900, k * 900 + F.col("ql"), k,
        ).alias("value"),
    )
    blocks = parse_chain_lines(data.unionByName(head))
    return blocks.select("tchrom", "tstart", "tend", "qchrom", "qstart", "qend", "qstrand", "blockid")


@query(
    "signal_on_conserved",
    with_views("track", "islands_of_blocks")
    + """ select t.chrom, greatest(t."start", b."start") as "start", least(t."end", b."end") as "end", t.value
    from track t join islands_of_blocks b on t.chrom = b.chrom and t."start" < b."end" and t."end" > b."start" """,
)
def signal_on_conserved(spark, sf):
    masked = sg.axis_pieces({"value": views.track(spark, sf)}, {"cons": views.target_blocks(spark, sf)})
    return masked.filter("cons and value is not null").select("chrom", "start", "end", "value")


# ---------------------------------------------------------------- signal


@query(
    "clip_percentile",
    with_views("tracks", "sizes")
    + """ , z as (select sample, chrom, sum("end" - "start") as used from tracks group by 1, 2),
    seen as (select sample, chrom, value as v, "end" - "start" as w from tracks
      union all select sample, z.chrom, 0.0, size - used from z join sizes using (chrom)),
    c as (select sample, chrom, v, sum(w) over (partition by sample, chrom order by v, w rows unbounded preceding) as upto, w,
      sum(w) over (partition by sample, chrom) as n from seen),
    f as (select sample, chrom, n, floor(0.95::double * (n - 1)) as lo, ceil(0.95::double * (n - 1)) as hi, 0.95::double * (n - 1) as pos from (select distinct sample, chrom, n from c)),
    e as (select f.sample, f.chrom, min(case when c.upto > f.lo then c.v end) as a, min(case when c.upto > f.hi then c.v end) as b, any_value(f.pos - f.lo) as d
      from f join c on f.sample = c.sample and f.chrom = c.chrom group by 1, 2)
    select t.sample, t.chrom, t."start", t."end", round(least(greatest(t.value, 0), a + (b - a) * d), 6) as value from tracks t join e on t.sample = e.sample and t.chrom = e.chrom""",
)
def clip_percentile(spark, sf):
    t = views.tracks(spark, sf)
    used = t.groupBy("sample", "chrom").agg(F.sum(F.col("end") - F.col("start")).alias("used"))
    zeros = used.join(views.sizes(spark, sf), "chrom").select("sample", "chrom", (F.col("size") - F.col("used")).alias("n_zero"))
    clipped = vl.clip_percentile(t, ["sample", "chrom"], "value", 95, F.col("end") - F.col("start"), zeros)
    return rounded(clipped, "value")


@query(
    "decile_rank",
    with_views("tracks")
    + """ , p as (select sample, chrom, quantile_cont(value, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]) as q from tracks where value <> 0 group by 1, 2)
    select t.sample, t.chrom, t."start", cast(case when value = 0 then 0 else 1 + len(list_filter(q, lambda x: value > x)) end as integer) as dec_rank
    from tracks t left join p on t.sample = p.sample and t.chrom = p.chrom""",
)
def decile_rank(spark, sf):
    return vl.decile_ranks(views.tracks(spark, sf), ["sample", "chrom"], "value").select("sample", "chrom", "start", "dec_rank")


_QNORM = (
    with_views("tracks")
    + """ , d as (select chrom, sample, "start" as pos, cast(round(round_even(value, 3) * 1000) as bigint) as v from tracks),
    kept as (select chrom, pos from d group by 1, 2 having sum(v) > 0),
    smp as (select distinct chrom, sample from d), ns as (select chrom, count(*) as n_s from smp group by 1),
    m as (select k.chrom, k.pos, s.sample, coalesce(d.v, 0) as v from kept k join smp s on k.chrom = s.chrom
      left join d on d.chrom = k.chrom and d.pos = k.pos and d.sample = s.sample),
    r as (select *, rank() over (partition by chrom, sample order by v) as r, row_number() over (partition by chrom, sample order by v) as i from m),
    mi as (select chrom, i, cast(round_even(sum(v)::double / any_value(n_s), 0) as bigint) as mean from r join ns using (chrom) group by 1, 2),
    g as (select chrom, mean, min(i) as mr from mi group by 1, 2),
    gl as (select *, lead(mean) over (partition by chrom order by mean) as nxt from g),
    rk as (select x.chrom, x.r, max(mr) as lo from (select distinct chrom, r from r) x join g on g.chrom = x.chrom and g.mr <= x.r group by 1, 2),
    nv as (select rk.chrom, rk.r, case when rk.r = gl.mr then gl.mean else cast(round_even((gl.mean + coalesce(gl.nxt, gl.mean)) / 2.0::double, 0) as bigint) end as new
      from rk join gl on gl.chrom = rk.chrom and gl.mr = rk.lo)
    select r.chrom, r.sample, r.pos, nv.new / 1000.0::double as value from r join nv on r.chrom = nv.chrom and r.r = nv.r"""
)


@query("qnorm", _QNORM)
def qnorm(spark, sf):
    t = views.tracks(spark, sf).select("chrom", "sample", F.col("start").alias("pos"), "value")
    return qn.nonzero_qnorm(t)


@query(
    "preprocess_qnorm",
    with_views("tracks")
    + """ , d as (select chrom, sample, "start" as pos, value, row_number() over w as i, rank() over (partition by chrom, sample order by value) as lo,
      count(*) over (partition by chrom, sample, value) as n from tracks window w as (partition by chrom, sample order by value, "start")),
    m as (select chrom, i, avg(value) as mean from d group by 1, 2), r as (select *, lo + (n - 1) / 2.0::double as r from d)
    select r.chrom, r.sample, r.pos, round((a.mean + b.mean) / 2, 6) as value from r join m a on a.chrom = r.chrom and a.i = floor(r.r)
    join m b on b.chrom = r.chrom and b.i = ceil(r.r)""",
)
def preprocess_qnorm(spark, sf):
    t = views.tracks(spark, sf).select("chrom", "sample", F.col("start").alias("pos"), "value")
    return rounded(qn.preprocess_qnorm(t), "value")


@query(
    "simple_qnorm",
    with_views("tracks")
    + """ , d as (select chrom, sample, "start" as pos, value, row_number() over (partition by chrom, sample order by value, "start") as i from tracks),
    m as (select chrom, i, avg(value) as mean from d group by 1, 2)
    select d.chrom, d.sample, d.pos, round(m.mean, 6) as value from d join m on d.chrom = m.chrom and d.i = m.i""",
)
def simple_qnorm(spark, sf):
    t = views.tracks(spark, sf).select("chrom", "sample", F.col("start").alias("pos"), "value")
    return rounded(qn.simple_qnorm(t), "value")


@query(
    "merge_stat",
    with_views("spans")
    + """ select chrom, "start", "end", round(sum(value) / 5, 6) as mean, max(case when n < 5 then greatest(hi, 0) else hi end) as max,
      min(case when n < 5 then least(lo, 0) else lo end) as min, round(any_value(med), 6) as median from (
      select *, count(*) over w as n, max(value) over w as hi, min(value) over w as lo,
        list_sort(list(value) over w || list_transform(range(5 - count(*) over w), lambda x: 0.0::double))[3] as med
      from spans window w as (partition by chrom, "start")) group by 1, 2, 3""",
)
def merge_stat(spark, sf):
    keys = ["chrom", "start", "end"]
    spans = sg.split_at_boundaries(views.tracks(spark, sf))
    out = None
    for stat in ("mean", "max", "min", "median"):
        one = sg.merge_samples(spans, keys, stat, 5).withColumnRenamed("value", stat)
        out = one if out is None else out.join(one, keys)
    return rounded(out, "mean", "median")


_BINS = (
    with_views("track", "sizes")
    + """ , p as (select t.chrom, b as bin, t.value as v, least(t."end", (b + 1)*1000) - greatest(t."start", b*1000) as w,
      least(size, (b + 1)*1000) - b*1000 as len from (select *, unnest(range("start" // 1000, ("end" - 1) // 1000 + 1)) as b from track) t join sizes s on t.chrom = s.chrom)
    select chrom, bin*1000 as "start", bin*1000 + max(len) as "end", """
)


@query(
    "binned_dump",
    _BINS
    + """ round(sum(v*w) / max(len), 6) as mean, round(sum(v*w), 3) as sum, max(case when w < len then greatest(v, 0) else v end) as max,
    min(case when w < len then least(v, 0) else v end) as min from (select *, sum(w) over (partition by chrom, bin) as ww from p)
    group by chrom, bin""",
)
def binned_dump(spark, sf):
    t, s = views.track(spark, sf), views.sizes(spark, sf)
    keys = ["chrom", "start", "end"]
    out = None
    for stat in ("mean", "sum", "max", "min"):
        one = sg.bin_signal(t, s, 1000, stat).withColumnRenamed("value", stat)
        out = one if out is None else out.join(one, keys)
    return rounded(rounded(out, "mean"), "sum", digits=3)


@query(
    "binned_median",
    _BINS
    + """ round(case when sum(w) * 2 > max(len) then max(v) when sum(w) * 2 = max(len) then max(v) / 2 else 0 end, 6) as value
    from p group by chrom, bin""",
)
def binned_median(spark, sf):
    return rounded(sg.bin_signal(views.track(spark, sf), views.sizes(spark, sf), 1000, "median"), "value")


@query(
    "masked_stats",
    with_views("regions", "track", "islands_of_blocks")
    + """ , u as (select distinct chrom, "start", "end" from regions),
    tb as (select t.chrom, greatest(t."start", b."start") as s, least(t."end", b."end") as e, t.value from track t join islands_of_blocks b
      on t.chrom = b.chrom and t."start" < b."end" and t."end" > b."start"),
    px as (select u.chrom, u."start", u."end", value, least(u."end", e) - greatest(u."start", s) as w from u join tb on u.chrom = tb.chrom and u."start" < e and u."end" > s),
    cn as (select u.chrom, u."start", u."end", sum(least(u."end", b."end") - greatest(u."start", b."start")) as n from u join islands_of_blocks b
      on u.chrom = b.chrom and u."start" < b."end" and u."end" > b."start" group by 1, 2, 3),
    sm as (select chrom, "start", "end", sum(w) as w, sum(w*value) as t, max(value) as hi, min(value) as lo from px group by 1, 2, 3),
    md as (select chrom, "start", "end", median(v) as md from (
      select chrom, "start", "end", unnest(list_transform(range(cast(w as bigint)), lambda x: value)) as v from px
      union all select chrom, "start", "end", unnest(list_transform(range(cast(cn.n - coalesce(sm.w, 0) as bigint)), lambda x: 0.0::double)) from cn left join sm using (chrom, "start", "end"))
      group by 1, 2, 3)
    select u.chrom, u."start", u."end", round(coalesce(cn.n, 0) / (u."end" - u."start")::double * 100, 6) as ftmsig_s_pct_cons,
      round(coalesce(sm.t / cn.n, 0), 6) as ftmsig_s_abs_mean, round(coalesce(md, 0), 6) as ftmsig_s_abs_median,
      coalesce(case when coalesce(sm.w, 0) < cn.n then greatest(coalesce(hi, 0), 0) else hi end, 0) as ftmsig_s_abs_max,
      coalesce(case when coalesce(sm.w, 0) < cn.n then least(coalesce(lo, 0), 0) else lo end, 0) as ftmsig_s_abs_min
    from u left join cn using (chrom, "start", "end") left join sm using (chrom, "start", "end") left join md using (chrom, "start", "end")""",
)
def masked_stats(spark, sf):
    out = sg.masked_stats(views.regions(spark, sf), views.track(spark, sf), views.target_blocks(spark, sf), "s")
    return rounded(out, "ftmsig_s_pct_cons", "ftmsig_s_abs_mean", "ftmsig_s_abs_median")


@query(
    "distribution_stats",
    """with m as (select event_type, avg(value) as mu, count(*) as n from events group by 1)
    select e.event_type, """
    + _r(
        "any_value(mu) as ftdst_abs_mean",
        "var_samp(value) as ftdst_abs_var",
        "avg(power(value - mu, 3)) / power(var_pop(value), 1.5) as ftdst_abs_skew",
        "avg(power(value - mu, 4)) / power(var_pop(value), 2) as ftdst_abs_kurt",
    )
    + ", min(value) as ftdst_abs_min, max(value) as ftdst_abs_max from events e join m on e.event_type = m.event_type group by 1",
)
def distribution_stats(spark, sf):
    d = sg.distribution_stats(views.table(spark, sf, "events"), ["event_type"], "value")
    return rounded(d, "ftdst_abs_mean", "ftdst_abs_var", "ftdst_abs_skew", "ftdst_abs_kurt")


# ---------------------------------------------------------------- correlation

_PAIR = """ , pr as (select x.sample as sample_a, y.sample as sample_b from (select distinct sample from tracks) x join (select distinct sample from tracks) y
    on x.sample < y.sample),
    ab as (select sample_a, sample_b, chrom, "start", "end", coalesce(max(value) filter (sample = sample_a), 0) as a,
    coalesce(max(value) filter (sample = sample_b), 0) as b from spans join pr on sample in (sample_a, sample_b) group by 1, 2, 3, 4, 5)"""
_BY_PAIR = "sample_a, sample_b, chrom"


def _by_sample(spark, sf):
    """One track for each sample; their names are as few as the input files."""
    t = views.tracks(spark, sf)
    names = sorted(r[0] for r in views.table(spark, sf, "events").select("event_type").distinct().collect())
    return {n: t.filter(F.col("sample") == n).drop("sample") for n in names}


def _pearson_sql(source: str, keys: str = "chrom") -> str:
    return f""" select {keys}, cast(n as bigint) as n, round(sxy / (sqrt(sxx) * sqrt(syy)), 6) as stat from (
    select {keys}, sum(w)::double as n, sum(w*(a - ma)*(a - ma)) as sxx, sum(w*(b - mb)*(b - mb)) as syy, sum(w*(a - ma)*(b - mb)) as sxy
    from {source} join (select {keys}, sum(w*a)::double / sum(w) as ma, sum(w*b)::double / sum(w) as mb from {source} group by {keys}) using ({keys}) group by {keys})"""


@query(
    "corr_full",
    with_views("spans", "sizes")
    + _PAIR
    + """ , f as (select sample_a, sample_b, chrom, a, b, ("end" - "start") as w from ab union all
      select sample_a, sample_b, s.chrom, 0, 0, s.size - u.used from sizes s
      join (select sample_a, sample_b, chrom, sum("end" - "start") as used from ab group by 1, 2, 3) u on s.chrom = u.chrom)"""
    + _pearson_sql("f", _BY_PAIR),
)
def corr_full(spark, sf):
    """Every pair of samples over whole chromosomes."""
    return rounded(st.corr_full(st.aligned_pairs(_by_sample(spark, sf)), views.sizes(spark, sf), keys=[*st.PAIR, "chrom"]), "stat")


@query(
    "corr_active",
    with_views("spans")
    + _PAIR
    + """ , f as (select sample_a, sample_b, chrom, a, b, ("end" - "start") as w from ab where a > 0 or b > 0)"""
    + _pearson_sql("f", _BY_PAIR),
)
def corr_active(spark, sf):
    return rounded(st.corr_active(st.aligned_pairs(_by_sample(spark, sf)), keys=[*st.PAIR, "chrom"]), "stat")


_SEGMENTS = (
    with_views("spans", "islands_of_blocks", "rois")
    + _PAIR
    + """ , seg as (select b.chrom, greatest(b."start", r."start") as s, least(b."end", r."end") as e from islands_of_blocks b join rois r
      on b.chrom = r.chrom and b."start" < r."end" and b."end" > r."start"),
    sg as (select seg.sample_a, seg.sample_b, seg.chrom, s, e, e - s as size, coalesce(sum(ab.a * (least(e, ab."end") - greatest(s, ab."start"))), 0) / (e - s) as a,
      coalesce(sum(ab.b * (least(e, ab."end") - greatest(s, ab."start"))), 0) / (e - s) as b
      from (select * from seg cross join pr) seg left join ab on seg.sample_a = ab.sample_a and seg.sample_b = ab.sample_b
      and seg.chrom = ab.chrom and s < ab."end" and e > ab."start" where e - s >= 30 group by 1, 2, 3, 4, 5)"""
)


def _segments(spark, sf):
    return st.segment_pairs(_by_sample(spark, sf), views.target_blocks(spark, sf), views.rois(spark, sf), 30)


@query("corr_segments", _SEGMENTS + " , f as (select sample_a, sample_b, chrom, a, b, 1 as w from sg)" + _pearson_sql("f", _BY_PAIR))
def corr_segments(spark, sf):
    return rounded(st.weighted_pearson(_segments(spark, sf), [*st.PAIR, "chrom"], "a", "b"), "stat")


@query(
    "segment_summary",
    _SEGMENTS
    + """ select sample_a, sample_b, chrom, count(*) as num_regions, min(size) as reg_size_min, max(size) as reg_size_max, round(min(a), 2) as sig1_mean_min,
    round(max(a), 2) as sig1_mean_max, round(min(b), 2) as sig2_mean_min, round(max(b), 2) as sig2_mean_max,
    cast(trunc(median(size)) as bigint) as reg_size_median, round(median(a), 2) as sig1_mean_median, round(median(b), 2) as sig2_mean_median from sg group by 1, 2, 3""",
)
def segment_summary(spark, sf):
    return st.pair_summary(_by_sample(spark, sf), views.target_blocks(spark, sf), views.rois(spark, sf), 30)


@query(
    "spearman",
    """with e as (select event_type as chrom, value as v, cast(user_id as double) as u from events),
    r as (select chrom, rank() over (partition by chrom order by v) + (count(*) over (partition by chrom, v) - 1) / 2.0::double as a,
      rank() over (partition by chrom order by u) + (count(*) over (partition by chrom, u) - 1) / 2.0::double as b, 1 as w from e)"""
    + _pearson_sql("r"),
)
def spearman(spark, sf):
    e = views.table(spark, sf, "events").select(F.col("event_type").alias("chrom"), "value", "user_id")
    return rounded(st.weighted_spearman(e, ["chrom"], "value", "user_id"), "stat")


@query(
    "pearson_shifted",
    "with r as (select l_returnflag as chrom, 1e9 + l_quantity::double as a, 1e9 - l_quantity::double + l_linenumber as b, 1 as w from lineitem)" + _pearson_sql("r"),
)
def pearson_shifted(spark, sf):
    """Correlation of values near 1e9 that vary by units."""
    q = F.col("l_quantity").cast("double")
    items = views.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("chrom"), (F.lit(1e9) + q).alias("a"), (F.lit(1e9) - q + F.col("l_linenumber")).alias("b"))
    return rounded(st.weighted_pearson(items, ["chrom"], "a", "b"), "stat")


@query(
    "kendall",
    """with p as (select l_returnflag as flag, l_quantity as a, l_discount as b, count(*) as c from lineitem group by 1, 2, 3),
    pq as (select x.flag, sum(case when sign(x.a - y.a) * sign(x.b - y.b) > 0 then x.c::double * y.c else 0 end) / 2 as p,
      sum(case when sign(x.a - y.a) * sign(x.b - y.b) < 0 then x.c::double * y.c else 0 end) / 2 as q,
      sum(case when x.a <> y.a then x.c::double * y.c else 0 end) / 2 as na, sum(case when x.b <> y.b then x.c::double * y.c else 0 end) / 2 as nb
      from p x join p y on x.flag = y.flag group by 1)
    select flag, (select cast(sum(c) as bigint) from p where p.flag = pq.flag) as n, round((p - q) / sqrt(na) / sqrt(nb), 6) as stat from pq""",
)
def kendall(spark, sf):
    items = views.table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "flag")
    return rounded(st.kendall_tau(items, ["flag"], "l_quantity", "l_discount"), "stat")


@query(
    "rank_forms",
    """with f as (select l_returnflag as grp, l_extendedprice as v, count(*) as n_equal from lineitem group by 1, 2),
    g as (select *, cast(sum(n_equal) over (partition by grp order by v) - n_equal as bigint) as n_below,
      row_number() over (partition by grp order by v) as dense_rank from f)
    select grp, v, n_equal, n_below, n_below + 1 as min_rank, n_below + (n_equal + 1) / 2.0::double as avg_rank, dense_rank from g""",
)
def rank_forms(spark, sf):
    items = views.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("grp"), F.col("l_extendedprice").alias("v"))
    return vl.rank_values(items, ["grp"], "v")


# ---------------------------------------------------------------- sequences

_SEQ = with_views("seqs")


@query(
    "gc_content",
    _SEQ + " select doc_id, round(len(regexp_replace(seq, '[^GCgc]', '', 'g')) / len(seq)::double * 100, 6) as ftgc_pct_GC from seqs",
)
def gc_content(spark, sf):
    return views.sequences(spark, sf).select("doc_id", F.round(seqf.gc_percent(F.col("seq")), 6).alias("ftgc_pct_GC"))


_CPG = "(len(seq) - len(replace(lower(seq), 'cg', ''))) / 2"


@query("cpg", _SEQ + f" select doc_id, round({_CPG} / (len(seq) / 2.0::double) * 100, 6) as ftcpg_pct_CpG from seqs")
def cpg(spark, sf):
    return views.sequences(spark, sf).select("doc_id", F.round(seqf.cpg_percent(F.col("seq")), 6).alias("ftcpg_pct_CpG"))


@query(
    "oecpg",
    _SEQ
    + f""" select doc_id, round({_CPG} / (greatest(1, len(regexp_replace(seq, '[^Gg]', '', 'g')))::double
    * greatest(1, len(regexp_replace(seq, '[^Cc]', '', 'g')))) * len(seq), 6) as ftoecpg_rat_oeCpG from seqs""",
)
def oecpg(spark, sf):
    return views.sequences(spark, sf).select("doc_id", F.round(seqf.observed_expected_cpg(F.col("seq")), 6).alias("ftoecpg_rat_oeCpG"))


@query(
    "repeat_content",
    _SEQ + " select doc_id, round(len(regexp_replace(seq, '[^acgt]', '', 'g')) / len(seq)::double * 100, 6) as ftrep_pct_repcon from seqs",
)
def repeat_content(spark, sf):
    return views.sequences(spark, sf).select("doc_id", F.round(seqf.repeat_percent(F.col("seq")), 6).alias("ftrep_pct_repcon"))


@query(
    "region_length",
    with_views("regions") + """ select name, "end" - "start" as ftlen_abs_length, round(("end" - "start") / 103.0::double * 100, 6) as ftlen_pct_length from regions""",
)
def region_length(spark, sf):
    return views.regions(spark, sf).select(
        "name",
        seqf.length_feature(F.col("start"), F.col("end")).alias("ftlen_abs_length"),
        F.round(seqf.length_feature(F.col("start"), F.col("end"), 103), 6).alias("ftlen_pct_length"),
    )


@query(
    "kmer_freq",
    _SEQ
    + """ , w as (select doc_id, len(seq) - 2 as total, substring(up, i, 3) as kmer
      from (select doc_id, seq, upper(seq) as up, unnest(range(1, len(seq) - 1)) as i from seqs))
    select doc_id, kmer, round(count(*) / any_value(total)::double * 100, 6) as pct from w group by 1, 2""",
)
def kmer_freq(spark, sf):
    return rounded(seqf.kmer_frequency(views.sequences(spark, sf), ["doc_id"], 3), "pct")


@query(
    "kmer_table",
    _SEQ
    + " , w as (select doc_id, len(seq) as total, substring(upper(seq), i, 1) as kmer from (select doc_id, seq, unnest(range(1, len(seq) + 1)) as i from seqs)) select doc_id, "
    + ", ".join(f"round(count(*) filter (kmer = '{c}') / any_value(total)::double * 100, 6) as ftkmf_pct_k{c}" for c in "ACGTN")
    + " from w group by 1",
)
def kmer_table(spark, sf):
    return rounded(seqf.kmer_table(views.sequences(spark, sf), ["doc_id"], 1), *[f"ftkmf_pct_k{c}" for c in "ACGTN"])


@query(
    "motif_counts",
    _SEQ
    + " select doc_id, "
    + ", ".join(
        f"""len(regexp_extract_all(upper(seq), '{p}', 0)) as ftprm_abs_{n},
        round((len(seq) - len(regexp_replace(upper(seq), '{p}', '', 'g'))) / len(seq)::double * 100, 6) as ftprm_pct_{n}"""
        for n, p in seqf.CORE_PROMOTER_MOTIFS
    )
    + " from seqs",
)
def motif_counts(spark, sf):
    s = views.sequences(spark, sf)
    made = s.select("doc_id", *seqf.sequence_columns(["prm"]))
    return rounded(made, *[f"ftprm_pct_{n}" for n, _ in seqf.CORE_PROMOTER_MOTIFS])


def _pwm_sql() -> str:
    parts = []
    for i in range(6):
        arms = " ".join(f"when '{b}' then {p[i] / 100.0}::double" for b, p in seqf.DNASE_HEXAMER.items())
        parts.append(f"case substring(kmer, {i + 1}, 1) {arms} end")
    return " * ".join(parts)


@query(
    "dnase_pwm",
    _SEQ
    + f""" , w as (select doc_id, substring(up, i, 6) as kmer from (select doc_id, upper(seq) as up, unnest(range(1, len(seq) - 4)) as i from seqs)),
    p as (select doc_id, {_pwm_sql()} as p from w where not contains(kmer, 'N')),
    m as (select doc_id, median(p) as med, max(p) as top from p group by 1),
    s as (select p.doc_id, any_value(med) as med, any_value(top) as top, median(abs(p - med)) as mad from p join m on p.doc_id = m.doc_id group by 1)
    select q.doc_id, round(coalesce(med, 0), 9) as ftdnm_abs_medprob, round(coalesce(top, 0), 9) as ftdnm_abs_maxprob, round(coalesce(mad, 0), 9) as ftdnm_abs_medad
    from seqs q left join s on q.doc_id = s.doc_id""",
)
def dnase_pwm(spark, sf):
    out = seqf.dnase_motif(views.sequences(spark, sf), ["doc_id"])
    return rounded(out, "ftdnm_abs_medprob", "ftdnm_abs_maxprob", "ftdnm_abs_medad", digits=9)


@query(
    "window_sequences",
    _SEQ
    + """ , d as (select concat('doc', doc_id) as chrom, seq, len(seq) as n from seqs),
    w as (select chrom, s as "start", s + 200 as "end", substring(seq, s + 1, 200) as seq from (
      select chrom, seq, unnest(range(0, least(n - 200, (n // 200)*200 - 1) + 1, 100)) as s from d where n >= 200)
      union all select chrom, 0, n, seq from d where n < 200)
    select chrom, "start", "end", "end" - "start" as ftlen_abs_length, round(len(regexp_replace(seq, '[^GCgc]', '', 'g')) / len(seq)::double * 100, 6) as ftgc_pct_GC,
      round(len(regexp_replace(seq, '[^acgt]', '', 'g')) / len(seq)::double * 100, 6) as ftrep_pct_repcon from w""",
)
def window_sequences(spark, sf):
    """Documents as chromosomes: windows over each, their sequence attached from chunks, then features.

    Ids may repeat, so a document goes by the place it is stored at; its name comes back at the end. Those without letters are
    one empty window, which has no sequence to attach.
    """
    docs = views.placed_sequences(spark, sf).withColumnRenamed("place", "chrom")
    named = F.concat_ws("", F.lit("doc"), "doc_id").alias("name")
    whole = docs.select("chrom", named, F.lit(0).cast("bigint").alias("start"), F.col("size").alias("end"))
    windows, empty = (ft.sliding_windows(whole.filter(wanted), 200, 100) for wanted in ("end > 0", "end = 0"))
    with_seq = ft.attach_sequence(windows, ft.chunk_sequences(docs, 4096), 4096).unionByName(empty.withColumn("seq", F.lit("")))
    made = ft.sequence_features(with_seq, ["len", "gc", "rep"])
    shares = [F.coalesce(F.round(c, 6), F.lit(float("nan"))).alias(c) for c in ("ftgc_pct_GC", "ftrep_pct_repcon")]
    return made.select(F.col("source").alias("chrom"), "start", "end", "ftlen_abs_length", *shares)


# ---------------------------------------------------------------- tables


@query(
    "outer_merge",
    """select coalesce(c.k, s.k) as k, c.v as v_C, s.v as v_S, c."start" as start_C, s."start" as start_S, c."end" as end_C, s."end" as end_S,
      least(c."start", s."start") as "start", greatest(c."end", s."end") as "end"
    from (select c_nationkey as k, count(*) as v, min(c_custkey) as "start", max(c_custkey) as "end" from customer group by 1) c
    full outer join (select s_nationkey as k, count(*) as v, min(s_suppkey) as "start", max(s_suppkey) as "end" from supplier group by 1) s on c.k = s.k""",
)
def outer_merge(spark, sf):
    def per_nation(name: str, p: str, key: str) -> DataFrame:
        return views.table(spark, sf, name).groupBy(F.col(f"{p}_nationkey").alias("k")).agg(
            F.count(F.lit(1)).alias("v"), F.min(key).alias("start"), F.max(key).alias("end")
        )

    left, right = per_nation("customer", "c", "c_custkey"), per_nation("supplier", "s", "s_suppkey")
    return tb.merge_tables([left, right], ["C", "S"], ["k"], validate=False)


@query(
    "extend_values",
    """select o_orderkey, o_totalprice, v.qty, v.n from orders o left join (
      select l_orderkey, sum(l_quantity) as qty, count(*) as n from lineitem group by 1) v on o.o_orderkey = v.l_orderkey where v.n is not null""",
)
def extend_values(spark, sf):
    o = views.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    v = views.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum("l_quantity").alias("qty"), F.count(F.lit(1)).alias("n")
    )
    return tb.extend_table(o, v, ["o_orderkey"], ["qty", "n"], whole_genome=True, ignore_missing=True)


@query(
    "stack_distinct",
    with_views("regions", "rois")
    + """ , a as (select chrom, "start", "end" from regions), b as (select chrom, "start", "end" from rois)
    select case when min(src) = 0 then 'A' else 'B' end as indicator, chrom, "start", "end" from (
      select *, 0 as src from a union all select *, 1 as src from b) group by chrom, "start", "end" """,
)
def stack_distinct(spark, sf):
    a = views.regions(spark, sf).select("chrom", "start", "end", F.lit(None).cast("string").alias("note"))
    b = views.rois(spark, sf).select("chrom", "start", "end")
    return tb.stack_tables([a, b], ["A", "B"], indicator=True)


@query(
    "concat_inner",
    with_views("regions", "rois")
    + """ select chrom, "start", "end", name from regions union all select chrom, "start", "end", name from rois""",
)
def concat_inner(spark, sf):
    return tb.concat_common([views.regions(spark, sf), views.rois(spark, sf)])


@query(
    "concat_outer",
    with_views("regions", "rois")
    + """ select chrom, "start", "end", name, score from regions union all select chrom, "start", "end", name, null from rois""",
)
def concat_outer(spark, sf):
    return tb.concat_all([views.regions(spark, sf), views.rois(spark, sf)])


@query(
    "downsample_counts",
    """select l_returnflag, least(700, (select min(n) from (select count(*) as n from lineitem group by l_returnflag))) as n
    from lineitem group by 1""",
)
def downsample_counts(spark, sf):
    items = views.table(spark, sf, "lineitem").select(
        F.concat_ws("_", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("name"),
        "l_returnflag",
    )
    return vl.sample_per_class(items, "l_returnflag", "name", 700, seed=11).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query(
    "downsample_rows",
    """with n as (select concat_ws('_', l_orderkey, l_linenumber, l_partkey, l_suppkey) as name, l_returnflag from lineitem),
    r as (select *, row_number() over (partition by l_returnflag order by md5(concat('11:', name)), name) as r from n)
    select l_returnflag, name from r where r <= least(700, (select min(c) from (select count(*) as c from lineitem group by l_returnflag)))""",
)
def downsample_rows(spark, sf):
    """The chosen rows of each class."""
    items = views.table(spark, sf, "lineitem").select(F.concat_ws("_", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("name"), "l_returnflag")
    return vl.sample_per_class(items, "l_returnflag", "name", 700, seed=11)


@query(
    "complement_sample",
    with_views("regions", "sizes")
    + """ , o as (select chrom, "start", "end", max("end") over (partition by chrom order by "start", "end" rows between unbounded preceding and 1 preceding) as reach
      from (select chrom, "start", "end" from regions union all select chrom, size, size + 1 from sizes)),
    g as (select chrom, coalesce(reach, 0) as s, "start" as e from o where "start" > coalesce(reach, 0)),
    f as (select chrom, s, e, sum(e - s) over (partition by chrom order by s) - (e - s) as lo, sum(e - s) over (partition by chrom order by s) as hi from g),
    t as (select chrom, max(hi) as total from f group by 1),
    w as (select chrom, count(*) // 3 as n from regions group by 1),
    d as (select w.chrom, k, ('0x' || md5(concat('7:', w.chrom, ':', k))[1:15])::bigint % total as rank
      from (select chrom, unnest(range(n)) as k from w) w join t on w.chrom = t.chrom)
    select d.chrom, d.k, cast(f.s + d.rank - f.lo as bigint) as pos, f.s as piece_start, f.e as piece_end
    from d join f on d.chrom = f.chrom and d.rank >= f.lo and d.rank < f.hi""",
)
def complement_sample(spark, sf):
    """A third as many positions as there are regions, drawn from what no region covers."""
    r = views.regions(spark, sf)
    wanted = r.groupBy("chrom").agg(F.floor(F.count(F.lit(1)) / 3).alias("n"))
    return mt.complement_positions(iv.gaps(r, views.sizes(spark, sf)), wanted, 7)


@query(
    "map_select",
    with_views("blocks")
    + """ select blockid, tchrom, tstart, tend, qchrom, qstart, qend, qstrand from blocks
    where tchrom in ('chr1', 'chr3') and qchrom = 'q2' and tend > 100000 and tstart < 3000000""",
)
def map_select(spark, sf):
    """Blocks of two target chromosomes against one query chromosome within a span, from a stored map."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/map-{uuid.uuid4().hex}"
    sizes = views.sizes(spark, sf)
    store.write_map(views.blocks(spark, sf), path, store.map_metadata(spark, "t", "q", "md5", "", sizes, sizes, False))
    return store.read_blocks(spark, path, targets="chr[13]", chroms=(None, ["q2"]), span=(100_000, 3_000_000))


@query(
    "subset_expression",
    with_views("regions") + """ select chrom, "start", "end", name, score from regions where score > 20 and "end" - "start" < 80""",
)
def subset_expression(spark, sf):
    return tb.subset_by_expression(views.regions(spark, sf), '"score > 20 and `end` - start < 80"')


@query(
    "subset_names",
    with_views("rois", "assoc") + """ select chrom, "start", "end", name from rois where name in (select name from assoc)""",
)
def subset_names(spark, sf):
    return tb.subset_by_names(views.rois(spark, sf), views.associated(spark, sf).select("name")).select("chrom", "start", "end", "name")


@query(
    "derived_target",
    with_views("regions") + """ select name, score, cast(score / 50 > 0.5 as integer) as target from regions""",
)
def derived_target(spark, sf):
    r = views.regions(spark, sf).select("name", "score")
    out, _, _ = tb.add_target(r, expression="data.score / 50 > 0.5")
    return out.select("name", "score", F.col("target").cast("int").alias("target"))


@query(
    "sample_weights",
    with_views("rois", "assoc")
    + """ , w as (select name, sum(wt) as weight from assoc group by 1)
    select coalesce(r.name, w.name) as name, r.chrom, r."start", r."end", w.weight from rois r full outer join w on r.name = w.name""",
)
def sample_weights(spark, sf):
    w = views.associated(spark, sf).select("name", F.aggregate("weights", F.lit(0.0), lambda a, x: a + x).alias("weight"))
    return tb.add_weights(views.rois(spark, sf), w)


# ---------------------------------------------------------------- metadata


@query(
    "metadata_regions",
    with_views("regions")
    + """ select concat('/reg/', chrom) as "group", chrom, count(*) as numreg, cast(sum("end" - "start") as bigint) as covbp, 'a.bed,b.bed' as srcfile
    from regions group by chrom""",
)
def metadata_regions(spark, sf):
    from ..sources.store import region_metadata

    md = region_metadata(views.regions(spark, sf), "reg", ["a.bed", "x/b.bed"])
    return md.select("group", "chrom", "numreg", "covbp", "srcfile")


@query(
    "metadata_signal",
    with_views("track", "sizes")
    + """ select concat('/sig/', chrom) as "group", chrom, size as length, 'values' as signaltype, 'a.bg' as srcfile
    from sizes where chrom in (select chrom from track)""",
)
def metadata_signal(spark, sf):
    from ..sources.store import signal_metadata

    md = signal_metadata(views.track(spark, sf), views.sizes(spark, sf), "sig", ["a.bg"])
    return md.select("group", "chrom", "length", "signaltype", "srcfile")


@query(
    "metadata_map",
    with_views("regions", "tracks", "sizes")
    + """ select 'target' as key, 'aa1' as value union all select 'query', 'bb2' union all select 'maptype', 'complete'
    union all select 'hashtype', 'md5' union all select 'hash', 'x'
    union all select concat('aa1/', chrom), cast(size as varchar) from sizes union all select concat('bb2/', chrom), cast(size as varchar) from sizes""",
)
def metadata_map(spark, sf):
    from ..sources.store import map_metadata

    s = views.sizes(spark, sf)
    return map_metadata(spark, "aa1", "bb2", "md5", "x", s, s, minimal=False)


@query(
    "metadata_upsert",
    with_views("regions", "rois")
    + """ , n as (select chrom, count(*) as numreg from rois group by 1), o as (select chrom, count(*) as numreg from regions group by 1)
    select chrom, numreg from n union all select concat(chrom, '_old'), numreg from o""",
)
def metadata_upsert(spark, sf):
    from ..sources.store import region_metadata, upsert_metadata

    regions, rois = views.regions(spark, sf), views.rois(spark, sf)
    old = region_metadata(regions.unionByName(regions.withColumn("chrom", F.concat("chrom", F.lit("_old")))), "g", ["a.bed"])
    return upsert_metadata(old, region_metadata(rois, "g", ["b.bed"])).select("chrom", "numreg")


# ---------------------------------------------------------------- scores


def _scored(spark, sf) -> DataFrame:
    """Line items with a truth, a prediction and a score."""
    return views.table(spark, sf, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("truth"),
        (F.col("l_discount") > 0.05).cast("int").alias("pred"),
        F.col("l_extendedprice").alias("score"),
        F.col("l_quantity").alias("y"),
        (F.col("l_extendedprice") / 2000).alias("y_hat"),
        F.col("l_quantity").alias("weight"),
    )


_SCORED = """with s as (select cast(l_returnflag = 'R' as integer) as truth, cast(l_discount > 0.05 as integer) as pred,
    l_extendedprice as score, l_quantity as y, l_extendedprice / 2000 as y_hat, l_quantity as weight from lineitem)"""


@query(
    "f1_macro",
    _SCORED
    + """ select round(avg(f1), 6) as score from (select c, 2.0::double * count(*) filter (truth = c and pred = c)
    / (count(*) filter (truth = c) + count(*) filter (pred = c)) as f1 from s, (values (0), (1)) as k(c) group by c)""",
)
def f1_macro(spark, sf):
    return rounded(st.f1_macro(_scored(spark, sf), "truth", "pred"), "score")


@query("accuracy", _SCORED + " select round(sum(case when truth = pred then weight else 0 end) / sum(weight), 6) as score from s")
def accuracy(spark, sf):
    return rounded(st.accuracy(_scored(spark, sf), "truth", "pred", "weight"), "score")


@query(
    "roc_auc",
    _SCORED
    + """ , r as (select truth, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0::double as r from s)
    select round((sum(r) filter (truth = 1) - count(*) filter (truth = 1) * (count(*) filter (truth = 1) + 1) / 2.0::double)
      / (count(*) filter (truth = 1)::double * count(*) filter (truth = 0)), 6) as score from r""",
)
def roc_auc(spark, sf):
    return rounded(st.roc_auc(_scored(spark, sf), "truth", "score"), "score")


@query("mean_squared_error", _SCORED + " select round(sum(weight * (y - y_hat) * (y - y_hat)) / sum(weight), 6) as score from s")
def mean_squared_error(spark, sf):
    return rounded(st.mean_squared_error(_scored(spark, sf), "y", "y_hat", "weight"), "score")


@query(
    "r2_score",
    _SCORED + " select round(1 - sum((y - y_hat) * (y - y_hat)) / sum((y - m) * (y - m)), 6) as score from s, (select avg(y) as m from s)",
)
def r2_score(spark, sf):
    return rounded(st.r2(_scored(spark, sf), "y", "y_hat"), "score")


@query(
    "permutation_free_scores",
    """with p as (select l_suppkey as perm, avg(l_discount) as score from lineitem group by 1)
    select """
    + _r(
        "avg(score) as perm_mean", "median(score) as perm_median", "min(score) as perm_min", "stddev_pop(score) as perm_std",
        "var_pop(score) as perm_var", "max(score) as perm_max", digits=9,
    )
    + ", round(quantile_cont(score, 0.95), 9) as perm_95pct, round(quantile_cont(score, 0.05), 9) as perm_5pct from p",
)
def permutation_free_scores(spark, sf):
    scores = views.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("perm")).agg(F.avg("l_discount").alias("score"))
    out = st.permutation_summary(scores)
    return rounded(out, *out.columns, digits=9)


@query(
    "standard_scaler",
    _SCORED
    + """ , m as (select avg(y) as a, stddev_pop(y) as b, avg(score) as c, stddev_pop(score) as d from s)
    select round((y - a) / b, 6) as ft_y, round((score - c) / d, 6) as ft_score from s, m""",
)
def standard_scaler(spark, sf):
    from ..operators.modeling import fit_scaler, scale

    data = _scored(spark, sf).select(F.col("y").alias("ft_y"), F.col("score").alias("ft_score"))
    return rounded(scale(data, fit_scaler(data, ["ft_y", "ft_score"])), "ft_y", "ft_score")


# ---------------------------------------------------------------- matching


_NEAREST = (
    with_views("seqs")
    + """ , f as (select doc_id as id, lang, round(len(seq) / 1000.0::double, 6) as x, round(len(regexp_replace(seq, '[^GCgc]', '', 'g')) / len(seq)::double * 100, 6) as y,
      round(len(regexp_replace(seq, '[^acgt]', '', 'g')) / len(seq)::double * 100, 6) as z from seqs),
    p as (select c.id, t.id as target_id, greatest(abs(c.x - t.x), abs(c.y - t.y), abs(c.z - t.z)) as dist from f c, f t where c.lang <> 'en' and t.lang = 'en'),
    r as (select *, row_number() over (partition by id order by dist, target_id) as rank from p)"""
)


def _nearest_english(spark, sf, k: int):
    from ..operators.nearest import nearest_k

    s = views.sequences(spark, sf)
    points = s.select(
        F.col("doc_id").alias("id"),
        "lang",
        F.round(F.length("seq") / 1000, 6).alias("x"),
        F.round(seqf.gc_percent(F.col("seq")), 6).alias("y"),
        F.round(seqf.repeat_percent(F.col("seq")), 6).alias("z"),
    )
    # stored first: filters on the features would be pushed below the spreading of the texts and spell them again for each use
    points = cut_lineage(points)
    return rounded(nearest_k(points.filter("lang != 'en'"), points.filter("lang = 'en'"), ["x", "y", "z"], k), "dist")


@query("chebyshev_nearest", _NEAREST + " select id, target_id, round(dist, 6) as dist from r where rank = 1")
def chebyshev_nearest(spark, sf):
    """Nearest English document of each other document in (length, GC, repeats), however far."""
    return _nearest_english(spark, sf, 1).drop("rank")


@query("chebyshev_knn", _NEAREST + " select id, rank, target_id, round(dist, 6) as dist from r where rank <= 5")
def chebyshev_knn(spark, sf):
    """The five nearest English documents of each other document."""
    return _nearest_english(spark, sf, 5)
