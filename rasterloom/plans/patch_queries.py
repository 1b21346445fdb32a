"""Queries of patches in space and time, samplers, windows, and event-time windows."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import tidy
from ..operators import aggregations as ag
from ..operators import patches as pt
from ..operators.indices import NDVI
from ..sources.catalog import Catalog
from ..streaming import events as ev
from .fixtures import CAT, DEM, PX, cat, dem, pts, px, table
from .registry import add, query

_SHAPE = (64, 64)


def _weights(kind, n=12):
    """Weight of each place of a window, as a query and in SQL."""
    return lambda s, d: s.range(n).select("id", tidy(kind(F.col("id").cast("double"), n)).alias("w"))


add("win_boxcar", _weights(pt.boxcar), "select id, 1e0 w from range(12) t(id)")
add("win_hann", _weights(pt.hann), "select id, round(0.5 - 0.5 * cos(2 * pi() * id / 11e0), 6) + 0.0 w from range(12) t(id)")
add("win_tukey", _weights(pt.tukey(0.5)), "select id, round(case when id < 3 then 0.5 * (1 + cos(pi() * (id / 3e0 - 1))) when id <= 9 then 1 else 0.5 * (1 + cos(pi() * (id / 3e0 - 3))) end, 6) + 0.0 w from range(12) t(id)")
add("win_gaussian", _weights(pt.gaussian(0.5)), "select id, round(exp(-0.5 * power((id - 5.5e0) / 3, 2)), 6) + 0.0 w from range(12) t(id)")
add("win_triangular", _weights(pt.triangular(4)), "select id, round(least(1, least(id + 1, 12 - id) / 4e0), 6) + 0.0 w from range(12) t(id)")
add("win_exponential_decay", _weights(pt.exponential_decay(3.0)), "select id, round(exp(-(11 - id) / 3e0), 6) + 0.0 w from range(12) t(id)")

_A = "(select 12 * i ay, 10 * j ax from range(5) a(i), range(5) b(j))"
_P = pt.SpatialPatcher((16, 20), (12, 10), boundary="drop")
add("patch_anchors_drop", lambda s, d: _P.anchors(s, _SHAPE), f"select ay, ax from {_A}")
add("patch_anchors_all", lambda s, d: pt.SpatialPatcher((16, 20), (12, 10), boundary="pad").anchors(s, _SHAPE), "select 12 * i ay, 10 * j ax from range(6) a(i), range(7) b(j)")
add("patch_n_anchors", lambda s, d: s.createDataFrame([(_P.n_anchors(_SHAPE),)], "n long"), f"select count(*) n from {_A}")
_SPLIT = f"(select ay, ax, y - ay dy, x - ax dx, y, x, v from {_A} a join {DEM} d on y between ay and ay + 15 and x between ax and ax + 19)"
add("patch_split", lambda s, d: _P.split(dem(s, d), _SHAPE).select("ay", "ax", "dy", "dx", "v"), f"select ay, ax, dy, dx, v from {_SPLIT}")
add("patch_at", lambda s, d: _P.patch_at(dem(s, d), _SHAPE, 24, 30).select("y", "x", "v"), f"select y, x, v from {DEM} where y between 24 and 39 and x between 30 and 49")
_SHRINK = f"(select 12 * i ay, 10 * j ax, y, x, v from range(6) a(i), range(7) b(j), {DEM} d where y between 12 * i and 12 * i + 15 and x between 10 * j and 10 * j + 19)"
add("patch_split_shrink", lambda s, d: pt.SpatialPatcher((16, 20), (12, 10), boundary="shrink").split(dem(s, d), _SHAPE).select("ay", "ax", "y", "x", "v"), f"select ay, ax, y, x, v from {_SHRINK}")
_ALL = "select 12 * i ay, 10 * j ax, 12 * i + p y, 10 * j + q x from range(6) a(i), range(7) b(j), range(16) c(p), range(20) e(q)"
add("patch_split_pad", lambda s, d: pt.SpatialPatcher((16, 20), (12, 10), boundary="pad", pad_value=-7.0).split(dem(s, d), _SHAPE).select("ay", "ax", "y", "x", "v"), f"select ay, ax, g.y, g.x, coalesce(d.v, -7) v from ({_ALL}) g left join {DEM} d on d.y = g.y and d.x = g.x")
add("patch_split_reflect", lambda s, d: pt.SpatialPatcher((16, 20), (12, 10), boundary="reflect").split(dem(s, d), _SHAPE).select("ay", "ax", "y", "x", "v"), f"select ay, ax, g.y, g.x, d.v from ({_ALL}) g join {DEM} d on d.y = case when g.y > 63 then 126 - g.y else g.y end and d.x = case when g.x > 63 then 126 - g.x else g.x end")
_H = "(0.5 - 0.5 * cos(2 * pi() * {0} / {1}e0))"
_MERGE = f"select y, x, round(case when sum(w) > 0 then sum(v * w) / sum(w) else 0 end, 6) + 0.0 v from (select *, {_H.format('dy', 15)} * {_H.format('dx', 19)} w from {{0}}) group by 1, 2"
add("patch_merge_hann", lambda s, d: _merged(dem(s, d), ag.SpatialOverlapAdd()), _MERGE.format(_SPLIT))
add("patch_merge_mean", lambda s, d: _merged(dem(s, d), ag.SpatialMean()), f"select y, x, round(avg(v), 6) + 0.0 v from {_SPLIT} group by 1, 2")
add("patch_merge_max_per_patch", lambda s, d: _P.split(dem(s, d), _SHAPE).groupBy("ay", "ax").agg(F.max("v").alias("v")), f"select ay, ax, max(v) v from {_SPLIT} group by 1, 2")
add("patch_apply_to_chips", lambda s, d: _centred(_P.split(dem(s, d), _SHAPE)), f"select y, x, round(avg(v - m), 9) + 0.0 v from (select *, avg(v) over (partition by ay, ax) m from {_SPLIT}) group by 1, 2")


def _merged(df, aggregation):
    p = pt.SpatialPatcher((16, 20), (12, 10), pt.hann, aggregation)
    return p.merge(p.split(df, _SHAPE)).select("y", "x", tidy(F.col("v")).alias("v"))


def _centred(patches):
    m = patches.withColumn("v", F.col("v") - F.avg("v").over(W.partitionBy("ay", "ax")))
    return ag.SpatialMean().merge(m).select("y", "x", tidy(F.col("v"), 9).alias("v"))


_HIT = f"(select distinct id % 8 scene from {CAT} where xmin <= -40 and xmax >= -140 and ymin <= 40 and ymax >= -40 and end_time >= timestamp '1996-01-01' and start_time <= timestamp '1997-12-31')"
_FIELD = f"(select y, x, avg((nir - red) / (nir + red + 1e-10)) v from {PX} join {_HIT} using (scene) group by 1, 2)"


@query("patch_overlap_add", f"select y, x, round(case when sum(w) > 0 then sum(v * w) / sum(w) else 0 end, 6) + 0.0 v from (select y, x, v, {_H.format('(y - ay)', 15)} * {_H.format('(x - ax)', 19)} w from {_A} a join {_FIELD} d on y between ay and ay + 15 and x between ax and ax + 19) group by 1, 2")
def patch_overlap_add(spark, sf_dir):
    """Catalogue rows of a place and time, NDVI of their scenes' pixels, stitched from overlapping Hann windows."""
    import datetime as dt

    hits = Catalog(cat(spark, sf_dir)).query(bounds=(-140, -40, -40, 40), time=(dt.datetime(1996, 1, 1), dt.datetime(1997, 12, 31)))
    scenes = hits.df.select((F.col("id") % 8).alias("scene")).distinct()
    field = NDVI(out="v")(px(spark, sf_dir).join(F.broadcast(scenes), "scene")).groupBy("y", "x").agg(F.avg("v").alias("v"))
    return _merged(field, ag.SpatialOverlapAdd())


# matched sources
_two = lambda s, d: {"b": dem(s, d).where("x % 3 <> 0").withColumn("v", F.col("v") * 2)}
add("patch_matched_split", lambda s, d: pt.matched_split(_P, dem(s, d), _two(s, d), _SHAPE).select("ay", "ax", "y", "x", "v", "v_b", "valid_b"), f"select ay, ax, y, x, v, case when x % 3 <> 0 then v * 2 end v_b, x % 3 <> 0 valid_b from {_SPLIT}")
add("patch_matched_merge", lambda s, d: pt.matched_merge(pt.matched_split(_P, dem(s, d), _two(s, d), _SHAPE), {"primary": ag.SpatialMean(), "b": ag.SpatialSum()})["b"].select("y", "x", tidy(F.col("v")).alias("v")), f"select y, x, round(sum(case when x % 3 <> 0 then v * 2 else 0 end), 6) + 0.0 v from {_SPLIT} group by 1, 2")

# time
_SERIES = f"(select scene, (epoch_us(t) // 86400000000)::bigint - 9131 t, avg(nir) v from {PX} group by 1, 2)"


def _series(s, d):
    day = F.floor(F.unix_micros(F.col("t").cast("timestamp")) / 86_400_000_000) - 9131
    return px(s, d).groupBy("scene", day.alias("t")).agg(F.avg("nir").alias("v"))


_T = "select a.scene, a.t \"at\", b.t, b.t - a.t + {1} k, b.v from " + _SERIES + " a join " + _SERIES + " b on a.scene = b.scene and b.t between a.t - {1} and a.t + {2}"


def _split(s, d, before, after):
    own = _series(s, d)
    anchors = own.select("scene", F.col("t").alias("at"))
    return pt.temporal_split(own, ["scene"], before, after, F.lit(True)).join(anchors, ["scene", "at"], "left_semi")


add("time_split", lambda s, d: _split(s, d, 6, 3).select("scene", "at", "t", "k", tidy(F.col("v"), 9).alias("v")), f"select scene, \"at\", t, k, round(v, 9) + 0.0 v from ({_T.format('', 6, 3)})")
add("time_mean", lambda s, d: ag.temporal_mean(_split(s, d, 6, 3), ("scene", "k")).select("scene", "k", tidy(F.col("v"), 9).alias("v")), f"select scene, k, round(avg(v), 9) + 0.0 v from ({_T.format('', 6, 3)}) group by 1, 2")
add("time_forecast", lambda s, d: ag.temporal_forecast(_split(s, d, 6, 3).withColumn("anchor", F.struct("scene", "at")), 2).select("scene", "at", "t", tidy(F.col("v"), 9).alias("v")), f"select scene, \"at\", t, round(v, 9) + 0.0 v from (select *, row_number() over (partition by scene, \"at\" order by t desc) n from ({_T.format('', 6, 3)})) where n <= 2")
for _n, _f, _sql in (("lookback", pt.lookback(5), "4 preceding and current row"), ("lookback_horizon", pt.lookback_horizon(4, 2), "3 preceding and 2 following"), ("phase", pt.phase_window(3), "3 preceding and 3 following")):
    add(f"time_{_n}", lambda s, d, f=_f: pt.frame(_series(s, d), ["scene"], ["t"], *f, m=F.avg("v"), n=F.count("*")).select("scene", "t", tidy(F.col("m"), 9).alias("m"), "n"), f"select scene, t, round(avg(v) over w, 9) + 0.0 m, count(*) over w n from {_SERIES} window w as (partition by scene order by t rows between {_sql})")
add("time_multi_scale", lambda s, d: pt.frame(pt.frame(_series(s, d), ["scene"], ["t"], -2, 0, a=F.avg("v")), ["scene"], ["t"], -6, 0, b=F.avg("v")).select("scene", "t", tidy(F.col("a"), 4).alias("a"), tidy(F.col("b"), 4).alias("b")), f"select scene, t, round(avg(v) over (partition by scene order by t rows between 2 preceding and current row), 4) + 0.0 a, round(avg(v) over (partition by scene order by t rows between 6 preceding and current row), 4) + 0.0 b from {_SERIES}")
add("time_stencil", lambda s, d: pt.Stencil(-6, 6, 3, "both").sample(_series(s, d), ["scene"], _series(s, d)).select("scene", F.col("origin").cast("long").alias("origin"), "k", tidy(F.col("v"), 9).alias("v")), f"select a.scene, a.t origin, k::int k, round(b.v, 9) + 0.0 v from {_SERIES} a, range(5) r(k), {_SERIES} b where b.scene = a.scene and b.t = a.t - 6 + 3 * k")
add("time_stencil_origins", lambda s, d: pt.Stencil(-30, 10, 5).valid_origins(_series(s, d)).select("scene", "t"), f"with s as (select * from {_SERIES}), e as (select min(t) lo, max(t) hi from s) select scene, t from s, e where t - 30 >= lo and t + 5 <= hi")
add("time_fold", lambda s, d: ag.temporal_fold(_series(s, d), ["scene"], F.lit(0.0), lambda acc, v: acc * 0.5 + v).select("scene", tidy(F.col("v"), 9).alias("v")), f"with s as (select *, row_number() over (partition by scene order by t desc) n from {_SERIES}) select scene, round(sum(v * power(0.5e0, n - 1)), 9) + 0.0 v from s group by 1")
add("time_hierarchical", lambda s, d: ag.hierarchical(_split(s, d, 6, 3).select(F.concat_ws("/", "scene", "at").alias("anchor"), F.lit("fine").alias("scale"), "t", "v")).select("anchor", F.size(F.element_at("scales", "fine")).alias("n")), f"select scene || '/' || \"at\" anchor, count(*)::int n from ({_T.format('', 6, 3)}) group by 1")
add("time_spatio_temporal", lambda s, d: pt.spatio_temporal_product(_P.split(dem(s, d), _SHAPE).select("ay", "ax", "y", "x"), px(s, d).select("y", "x", "scene", "nir")).groupBy("ay", "ax", "scene").agg(tidy(F.avg("nir")).alias("v")), f"select ay, ax, scene, round(avg(nir), 6) + 0.0 v from {_A} a join {PX} on y between ay and ay + 15 and x between ax and ax + 19 group by 1, 2, 3")

# samplers with a seed, journal and batches
add("sample_jittered", lambda s, d: pt.JitteredStride((8, 8), 0.5, 3).anchors(s, _SHAPE, (8, 8)))
add("sample_random", lambda s, d: pt.RandomAnchors(50, 3).anchors(s, _SHAPE, (8, 8)))
add("sample_poisson", lambda s, d: pt.PoissonDisk(6.0, 3).anchors(s, _SHAPE, (8, 8)))
add("sample_stratified", lambda s, d: pt.stratified_sample(px(s, d).withColumn("c", F.col("qa") % 4), "c", {int(k): v for k, v in pt.quotas({0: 0.5, 1: 0.3, 2: 0.2}, 101).items()}, ["scene", "y", "x", "t", "qa", "nir"]).groupBy("c").agg(F.count("*").alias("n")), "select unnest([0, 1, 2])::bigint c, unnest([51, 30, 20])::bigint n")
add("sample_balanced", lambda s, d: pt.stratified_sample(px(s, d).withColumn("c", F.col("qa") % 4), "c", dict.fromkeys(range(4), 25), ["scene", "y", "x", "t", "qa", "nir"]).groupBy("c").agg(F.count("*").alias("n")), "select unnest([0, 1, 2, 3])::bigint c, 25::bigint n")
add("sample_explicit_coords", lambda s, d: pt.explicit_coords(pts(s, d), (1.0, 0.0, 0.0, 0.0, 1.0, 0.0), _SHAPE, (8, 8)), "select least(56, greatest(0, floor((user_id * 53 + event_id * 3) % 640 / 10e0)::bigint - 4)) ay, least(56, greatest(0, floor((user_id * 37 + event_id) % 640 / 10e0)::bigint - 4)) ax from events")
add("sample_along_track", lambda s, d: pt.along_track(s.createDataFrame([(0, 0.0, 0.0), (1, 3.0, 4.0), (2, 3.0, 4.0), (3, 3.0, 14.0)], "k int, px double, py double"), 2.5).select("i", tidy(F.col("px")).alias("px"), tidy(F.col("py")).alias("py")), "select i, round(case when i <= 2 then i * 1.5e0 else 3 end, 6) + 0.0 px, round(case when i <= 2 then i * 2e0 else 4 + (i * 2.5e0 - 5) end, 6) + 0.0 py from range(7) t(i)")
add("journal_pending", lambda s, d: pt.pending(table(s, d, "orders").select(F.col("o_orderkey").alias("anchor")).distinct(), table(s, d, "lineitem").select(F.col("l_orderkey").alias("anchor"), F.when(F.col("l_quantity") > 25, "ok").otherwise("failed").alias("status"), F.struct("l_shipdate", "l_quantity").alias("seq"))), "with l as (select l_orderkey, last(l_quantity order by l_shipdate, l_quantity) q from lineitem group by 1) select distinct o_orderkey anchor from orders left join l on l_orderkey = o_orderkey where coalesce(q, 0) <= 25")
add("batch_split", lambda s, d: pt.batch_ids(table(s, d, "customer").select("c_custkey", "c_nationkey"), 16, ["c_nationkey"], ["c_custkey"]), "select c_custkey, c_nationkey, (row_number() over w - 1) // 16 batch, ((row_number() over w - 1) % 16)::int slot from customer window w as (partition by c_nationkey order by c_custkey)")

# event time
add("stream_tumbling", lambda s, d: ev.tumbling(_events(s, d), "1 hour", ["kind"]).select(F.col("start").cast("timestamp_ntz").alias("start"), "kind", "n", tidy(F.col("v"), 4).alias("v")), "select time_bucket(interval 1 hour, ts) start, event_type kind, count(*) n, round(sum(value), 4) + 0.0 v from events group by 1, 2")
add("stream_sliding", lambda s, d: ev.sliding(_events(s, d), "2 hours", "1 hour", ["kind"]).select(F.col("start").cast("timestamp_ntz").alias("start"), "kind", "n"), "select time_bucket(interval 1 hour, ts) - to_hours(k::int) start, event_type kind, count(*) n from events, range(2) r(k) group by 1, 2")
add("stream_sessions", lambda s, d: ev.sessions(_events(s, d), "30 minutes", ["kind"]).select(F.col("start").cast("timestamp_ntz").alias("start"), "kind", "n"), "with g as (select event_type kind, ts, case when ts - lag(ts) over w < interval 30 minute then 0 else 1 end b from events window w as (partition by event_type order by ts)), s as (select *, sum(b) over (partition by kind order by ts rows unbounded preceding) k from g) select min(ts) start, kind, count(*) n from s group by kind, k")
add("stream_running_moments", lambda s, d: ev.running_moments(_events(s, d), ["kind"], "value").select("kind", "n", tidy(F.col("mean")).alias("mean")), "select event_type kind, count(value) n, round(avg(value), 6) + 0.0 mean from events group by 1")


def _events(s, d):
    return table(s, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"), "value")
