"""Queries of group statistics, scaling, composites, backgrounds and learning."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.numeric import tidy
from ..operators import aggregations as ag
from ..operators import background as bg
from ..operators import compositing as co
from ..operators import geom, viz
from ..operators import normalize as nz
from ..operators import radiometry as rad
from ..operators import regions as rg
from .fixtures import CUBE, DEM, GRID, PX, cube, dem, grid, px
from .registry import add, query

_Q = "quantile_cont({1}, {0})"


def _v(df, *keys, digits=6):
    return df.select(*keys, tidy(F.col("v"), digits).alias("v"))


def _stretch(lo, hi, clip=True):
    body = f"(nir - q[1]) / case when q[2] > q[1] then q[2] - q[1] else 1 end"
    return f"with q as (select scene, quantile_cont(nir, [{lo}, {hi}]) q from {PX} group by 1) select scene, y, x, round({'least(greatest(' + body + ', 0e0), 1e0)' if clip else body}, 6) + 0.0 v from {PX} join q using (scene)"


_NIR = lambda s, d: px(s, d).select("scene", "y", "x", F.col("nir").alias("v"))
_KEY = ("scene", "y", "x")
add("norm_per_band_stats", lambda s, d: nz.per_band_stats(px(s, d), ["scene"], "nir").select("scene", *[tidy(F.col(c)).alias(c) for c in ("mean", "std", "min", "max", "p1", "p99")]), f"select scene, round(avg(nir), 6) + 0.0 mean, round(stddev_pop(nir), 6) + 0.0 std, round(min(nir), 6) + 0.0 min, round(max(nir), 6) + 0.0 max, round(quantile_cont(nir, 0.01), 6) + 0.0 p1, round(quantile_cont(nir, 0.99), 6) + 0.0 p99 from {PX} group by 1")
add("norm_standard", lambda s, d: _v(nz.StandardScaler()(_NIR(s, d)), *_KEY), f"with q as (select scene, avg(nir) m, stddev_pop(nir) s from {PX} group by 1) select scene, y, x, round((nir - m) / case when s = 0 then 1 else s end, 6) + 0.0 v from {PX} join q using (scene)")
add("norm_robust", lambda s, d: _v(nz.RobustScaler()(_NIR(s, d)), *_KEY), f"with q as (select scene, quantile_cont(nir, [0.25, 0.5, 0.75]) q from {PX} group by 1) select scene, y, x, round((nir - q[2]) / (q[3] - q[1]), 6) + 0.0 v from {PX} join q using (scene)")
add("norm_min_max", lambda s, d: _v(nz.MinMaxScaler(out_range=(-1.0, 1.0))(_NIR(s, d)), *_KEY), f"with q as (select scene, min(nir) a, max(nir) b from {PX} group by 1) select scene, y, x, round((nir - a) / (b - a) * 2 - 1, 6) + 0.0 v from {PX} join q using (scene)")
add("norm_zero_one", lambda s, d: _v(nz.ZeroOne(by=())(_NIR(s, d)), *_KEY), f"with q as (select min(nir) a, max(nir) b from {PX}) select scene, y, x, round((nir - a) / (b - a), 6) + 0.0 v from {PX}, q")
add("norm_histogram_stretch", lambda s, d: _v(nz.HistogramStretch()(_NIR(s, d)), *_KEY), _stretch(0.02, 0.98))
add("norm_percentile_clip", lambda s, d: _v(nz.percentile_clip(_NIR(s, d)), *_KEY), _stretch(0.01, 0.99))
add("rad_percentile_clip", lambda s, d: _v(rad.PercentileClip("v")(_NIR(s, d)), *_KEY), _stretch(0.02, 0.98))
add("rad_dos1", lambda s, d: _v(rad.DOS1("v")(_NIR(s, d)), *_KEY), f"with q as (select scene, quantile_cont(nir, 0.01) q from {PX} group by 1) select scene, y, x, round(greatest(nir - q, 0e0), 6) + 0.0 v from {PX} join q using (scene)")
add("rad_simple_correction", lambda s, d: _v(rad.SimpleAtmosphericCorrection("dos1", band="v", dark_percentile=5.0)(_NIR(s, d)), *_KEY), f"with q as (select scene, quantile_cont(nir, 0.05) q from {PX} group by 1) select scene, y, x, round(greatest(nir - q, 0e0), 6) + 0.0 v from {PX} join q using (scene)")
add("viz_stretch_uint8", lambda s, d: viz.StretchToUint8()(_NIR(s, d)).select(*_KEY, "byte"), f"with q as (select scene, quantile_cont(nir, [0.02, 0.98]) q from {PX} group by 1) select scene, y, x, floor(least(greatest((nir - q[1]) / case when q[2] > q[1] then q[2] - q[1] else 1 end, 0e0), 1e0) * 255)::int byte from {PX} join q using (scene)")
add(
    "norm_histogram_match",
    lambda s, d: _v(nz.histogram_match(_NIR(s, d).where("scene = 1").withColumn("k", F.lit(0)), px(s, d).where("scene = 2").select(F.lit(0).alias("k"), F.col("nir").alias("v")), ["k"]).drop("v").withColumnRenamed("matched", "v"), *_KEY),
    f"""with s as (select nir v, cume_dist() over (order by nir) q from {PX} where scene = 1), r as (select distinct nir v, cume_dist() over (order by nir) q from {PX} where scene = 2),
    t as (select distinct s.v, s.q, (select max(r.q) from r where r.q <= s.q) qa, (select min(r.q) from r where r.q >= s.q) qb from (select distinct v, q from s) s),
    u as (select t.v, case when qa is null then b.v when qb is null or qa = qb then a.v else a.v + (b.v - a.v) * (t.q - qa) / (qb - qa) end m from t left join r a on a.q = qa left join r b on b.q = qb)
    select scene, y, x, round(m, 6) + 0.0 v from {PX} p join u on p.nir = u.v where scene = 1""",
)

# composites
_CELL = "group by y, x"
add("comp_median", lambda s, d: co.median_composite(px(s, d), "nir").select("y", "x", tidy(F.col("v")).alias("v"), "n"), f"select y, x, round(median(nir), 6) + 0.0 v, count(nir) n from {PX} {_CELL}")
add("comp_max_ndvi", lambda s, d: co.max_ndvi_composite(px(s, d), ["red", "nir"], order=("t",)).select("y", "x", (F.col("red") + 0.0).alias("red"), "nir", tidy(F.col("ndvi")).alias("ndvi"), F.col("t").cast("timestamp_ntz").alias("t")), f"select y, x, red + 0.0 red, nir, round((nir - red) / (nir + red + 1e-10), 6) + 0.0 ndvi, t from (select *, row_number() over (partition by y, x order by (nir - red) / (nir + red + 1e-10) desc, t, red, nir) n from {PX}) where n = 1")
add("comp_cloud_free", lambda s, d: co.cloud_free_composite(px(s, d), F.col("qa").bitwiseAND(24) == 0, "nir", min_valid=1).select("y", "x", F.when(F.isnan("v"), None).otherwise(tidy(F.col("v"))).alias("v"), "n"), f"select y, x, round(avg(nir) filter ((qa & 24) = 0), 6) + 0.0 v, count(nir) filter ((qa & 24) = 0) n from {PX} {_CELL}")
_SCORE = "(0.3e0 / (1 + abs(swir)) + 0.4e0 / (1 + abs(dayofyear(t) - 180)) + 0.2e0 * red / (select max(red) from PXV) + 0.1e0 * (1 - least(greatest(green, 0e0), 1e0)))"
add("comp_best_available", lambda s, d: co.bap_composite(px(s, d), ["nir"], view=F.col("swir"), day=F.dayofyear("t"), target=180, cloud_distance=F.col("red"), opacity=F.col("green")).groupBy("y", "x").agg(tidy(F.max("score")).alias("score")), f"with PXV as {PX} select y, x, round(max({_SCORE}), 6) + 0.0 score from PXV {_CELL}")
add("comp_min_cloud", lambda s, d: co.min_cloud_composite(px(s, d).withColumn("clear", F.col("qa").bitwiseAND(24) == 0), "clear", "nir").select("y", "x", tidy(F.col("v")).alias("v"), "n"), f"with f as (select scene, avg(case when (qa & 24) <> 0 then 1e0 else 0e0 end) f from {PX} group by 1) select y, x, round(nir, 6) + 0.0 v, n from (select *, row_number() over (partition by y, x order by (qa & 24) <> 0, f, scene, nir) r, count(*) filter ((qa & 24) = 0) over (partition by y, x) n from {PX} join f using (scene)) where r = 1")
add("fuse_mean", lambda s, d: _v(co.blend_matched(px(s, d), v="nir"), "y", "x"), f"select y, x, round(avg(nir), 6) + 0.0 v from {PX} {_CELL}")
add("fuse_weighted", lambda s, d: _v(co.blend_matched(px(s, d), "weighted", "nir", weight=F.col("red")), "y", "x"), f"select y, x, round(sum(nir * red) / sum(red), 6) + 0.0 v from {PX} {_CELL}")
add("fuse_inverse_variance", lambda s, d: _v(co.blend_matched(px(s, d), "inverse_variance", "nir", variance=F.col("red")), "y", "x"), f"select y, x, round(sum(nir / red) / sum(1 / red), 6) + 0.0 v from {PX} {_CELL}")
for _m, _sql in (("first", "first(nir order by qa, nir)"), ("last", "last(nir order by qa, nir)"), ("mean", "avg(nir)"), ("median", "median(nir)"), ("max", "max(nir)"), ("min", "min(nir)")):
    add(f"mosaic_{_m}", lambda s, d, m=_m: _v(co.mosaic(px(s, d), m, "nir", order="qa"), "y", "x"), f"select y, x, round({_sql}, 6) + 0.0 v from {PX} {_CELL}")
add("mosaic_daily", lambda s, d: co.daily_mosaic(px(s, d), "max", "nir", order="qa").select("day", "y", "x", tidy(F.col("v")).alias("v")), f"select t::date \"day\", y, x, round(max(nir), 6) + 0.0 v from {PX} group by 1, 2, 3")

# global and per-cell aggregations over overlapping observations
_PATCH = lambda s, d: px(s, d).select("y", "x", F.col("nir").alias("v"), F.col("red").alias("weight"), (F.col("qa") % 5).alias("label"), (F.col("swir") + 0.01).alias("var"), F.col("scene").alias("anchor"))
for _n, _a, _sql in (
    ("sum", ag.SpatialSum(), "sum(nir)"),
    ("max", ag.SpatialMax(), "max(nir)"),
    ("min", ag.SpatialMin(), "min(nir)"),
    ("weighted_sum", ag.SpatialWeightedSum(), "sum(nir * red)"),
    ("mean", ag.SpatialMean(), "avg(nir)"),
    ("variance", ag.SpatialVariance(), "coalesce(case when count(*) > 1 then var_samp(nir) end, 0)"),
    ("overlap_add", ag.SpatialOverlapAdd(), "case when sum(red) > 0 then sum(nir * red) / sum(red) else 0 end"),
    ("median", ag.SpatialMedian(), "median(nir)"),
):
    add(f"agg_{_n}", lambda s, d, a=_a: _v(a.merge(_PATCH(s, d)), "y", "x"), f"select y, x, round({_sql}, 6) + 0.0 v from {PX} {_CELL}")
add("agg_inverse_variance", lambda s, d: ag.SpatialInvVarWeightedMean().merge(_PATCH(s, d)).select("y", "x", tidy(F.col("v")).alias("v"), tidy(F.col("var")).alias("var")), f"select y, x, round(sum(nir * red / (swir + 0.01e0)) / sum(red / (swir + 0.01e0)), 6) + 0.0 v, round(1 / sum(red / (swir + 0.01e0)), 6) + 0.0 var from {PX} {_CELL}")
add("agg_hard_vote", lambda s, d: ag.SpatialHardVote().merge(_PATCH(s, d)), f"select y, x, l v from (select y, x, qa % 5 l, row_number() over (partition by y, x order by count(*) desc, qa % 5) r from {PX} group by y, x, qa % 5) where r = 1")
add("agg_soft_vote", lambda s, d: ag.SpatialSoftVote().merge(_PATCH(s, d)), f"select y, x, l v from (select y, x, qa % 5 l, row_number() over (partition by y, x order by sum(nir) desc, qa % 5) r from {PX} group by y, x, qa % 5) where r = 1")
add("agg_mode", lambda s, d: ag.SpatialMode().merge(px(s, d).select("y", "x", (F.col("qa") % 3).cast("double").alias("v"))), f"select y, x, (l * 1e0) v from (select y, x, qa % 3 l, row_number() over (partition by y, x order by count(*) desc, qa % 3) r from {PX} group by y, x, qa % 3) where r = 1")
add("agg_mean_std", lambda s, d: ag.mean_std(_PATCH(s, d)).select(tidy(F.col("mean")).alias("mean"), tidy(F.col("std")).alias("std")), f"select round(avg(nir), 6) + 0.0 mean, round(stddev_samp(nir), 6) + 0.0 std from {PX}")
add("agg_min_max", lambda s, d: ag.min_max(_PATCH(s, d).withColumn("v", F.when((F.col("anchor") == 3) & (F.col("y") == 5), F.lit(float("nan"))).otherwise(F.col("v")))), f"select min(nir) min, max(nir) max from {PX} where scene <> 3")
add("agg_by_index", lambda s, d: ag.SpatialByIndex().merge(px(s, d).select(F.col("scene").alias("anchor"), "y", "x", F.col("nir").alias("v"), F.struct("qa", "nir").alias("o")), "o"), f"select scene anchor, y, x, last(nir order by qa, nir) v from {PX} group by 1, 2, 3")
add("agg_two_pass", lambda s, d: _v(ag.two_pass(_PATCH(s, d), {"m": F.avg("v"), "s": F.stddev_pop("v")}, lambda v, m, sd: (v - m) / sd, ag.SpatialMean()), "y", "x"), f"with q as (select avg(nir) m, stddev_pop(nir) s from {PX}) select y, x, round(avg((nir - m) / s), 6) + 0.0 v from {PX}, q group by 1, 2")
add("agg_uncovered_cells", lambda s, d: _v(ag.SpatialSum().merge(_PATCH(s, d).where("v > 0.9"), geom.full_grid(s, (64, 64))), "y", "x"), f"select g.y, g.x, round(coalesce(p.v, 0), 6) + 0.0 v from {DEM} g left join (select y, x, sum(nir) v from {PX} where nir > 0.9 group by 1, 2) p using (y, x)")
add("agg_approx_quantile", lambda s, d: ag.SpatialApproxQuantile(0.5).merge(_PATCH(s, d)))
add("agg_approx_cardinality", lambda s, d: ag.SpatialApproxCardinality().merge(_PATCH(s, d), by=("anchor",)))
add("agg_approx_mode", lambda s, d: ag.SpatialApproxMode(4).merge(px(s, d).select("scene", (F.col("qa") % 7).cast("double").alias("v")), by=("scene",)).select("scene", F.size("v").alias("n")))
add("agg_streaming_histogram", lambda s, d: ag.SpatialStreamingHistogram(16).merge(_PATCH(s, d), by=("anchor",)).select("anchor", F.size("v").alias("bins")))
add("agg_reservoir", lambda s, d: ag.SpatialReservoir(100, 7).reduce(_PATCH(s, d).select("y", "x", "v").distinct(), "y", "x", "v"))
add("agg_hll_merge", lambda s, d: ag.hll_merge(px(s, d), ["scene"], "qa"))
add("agg_learned", lambda s, d: ag.SpatialLearned(_per_scene, "scene long, m double").merge(px(s, d).select("scene", "nir")).select("scene", tidy(F.col("m")).alias("m")), f"select scene, round(avg(nir), 6) + 0.0 m from {PX} group by 1")


def _per_scene(pdf):
    return pdf.groupby("scene", as_index=False)["nir"].mean().rename(columns={"nir": "m"})


# outliers
_MAD = f"with c as (select median(v) c from {GRID}), s as (select 1.4826e0 * median(abs(v - c)) s from {GRID}, c)"


def _outliers(s, d, method="mad"):
    from ..operators.restore import outlier_mask

    return outlier_mask(grid(s, d), method).select("y", "x", "outlier")


add("restore_outlier_mad", _outliers, f"{_MAD} select y, x, abs(v - c) > 3 * s outlier from {GRID}, c, s")
add("restore_outlier_zscore", lambda s, d: _outliers(s, d, "zscore"), f"with c as (select avg(v) c, stddev_pop(v) s from {GRID}) select y, x, abs(v - c) > 3 * s outlier from {GRID}, c")


def _replaced(s, d):
    from ..operators.restore import replace_outliers

    return _v(replace_outliers(grid(s, d), "zscore"), "y", "x")


add("restore_replace_outliers", _replaced, f"with c as (select avg(v) c, stddev_pop(v) s from {GRID}), m as (select median(v) m from {GRID}, c where not abs(v - c) > 3 * s) select y, x, round(case when abs(v - c) > 3 * s then m else v end, 6) + 0.0 v from {GRID}, c, m")

# measures
add("measure_entropy", lambda s, d: rg.shannon_entropy(dem(s, d)).select(tidy(F.col("entropy")).alias("entropy")), f"with n as (select v, count(*) n from {DEM} group by 1), p as (select n / sum(n) over () p from n) select round(-sum(p * log2(p)), 6) + 0.0 entropy from p")
_LAB = f"(select y // 8 * 8 + x // 8 + 1 label, y, x, v from {DEM})"
_lab = lambda s, d: dem(s, d).select((F.floor(F.col("y") / 8) * 8 + F.floor(F.col("x") / 8) + 1).alias("label"), "y", "x", "v")
add("measure_region_props", lambda s, d: rg.region_props(_lab(s, d).drop("v"), dem(s, d)).select("label", "area", "min_y", "min_x", "max_y", "max_x", *[tidy(F.col(c)).alias(c) for c in ("cy", "cx", "myy", "mxx", "mean_intensity", "max_intensity")]), f"select label, count(*) area, min(y) min_y, min(x) min_x, max(y) + 1 max_y, max(x) + 1 max_x, round(avg(y), 6) + 0.0 cy, round(avg(x), 6) + 0.0 cx, round(var_pop(y), 6) + 0.0 myy, round(var_pop(x), 6) + 0.0 mxx, round(avg(v), 6) + 0.0 mean_intensity, round(max(v), 6) + 0.0 max_intensity from {_LAB} group by 1")
add("plume_column_stats", lambda s, d: rg.plume_column_stats(_lab(s, d).drop("v").where("label <= 3"), dem(s, d)).select("label", *[tidy(F.col(c), 5).alias(c) for c in ("mean_in", "mean_out", "std_out", "contrast", "zscore")]), f"with l as {_LAB}, k as (select distinct label from l where label <= 3), j as (select k.label, avg(v) filter (l.label = k.label) a, avg(v) filter (l.label <> k.label) b, stddev_pop(v) filter (l.label <> k.label) s from l, k group by 1) select label, round(a, 5) + 0.0 mean_in, round(b, 5) + 0.0 mean_out, round(s, 5) + 0.0 std_out, round(a - b, 5) + 0.0 contrast, round((a - b) / s, 5) + 0.0 zscore from j")
_OTSU = f"""with e as (select min(v) lo, max(v) hi from {DEM}), h as (select least(255, floor((v - lo) / (hi - lo) * 256)) k, count(*) n, first(lo) lo, first(hi) hi from {DEM}, e group by 1), c as (select *, lo + (k + 0.5) * (hi - lo) / 256 c from h),
w as (select k, c, sum(n) over a w0, sum(n * c) over a s0, coalesce(sum(n) over b, 0) w1, coalesce(sum(n * c) over b, 0) s1 from c window a as (order by k), b as (order by k rows between 1 following and unbounded following))
select round(c, 6) + 0.0 threshold from w where w1 > 0 order by round(w0 * w1 * power(s0 / w0 - s1 / w1, 2), 9) desc, k limit 1"""
add("plume_otsu", lambda s, d: rg.otsu_threshold(dem(s, d)).select(tidy(F.col("threshold")).alias("threshold")), _OTSU)
add("plume_threshold_percentile", lambda s, d: rg.resolve_threshold(dem(s, d), "percentile:95").select(tidy(F.col("threshold")).alias("threshold")), f"select round(quantile_cont(v, 0.95), 6) + 0.0 threshold from {DEM}")
add("plume_wind_cone", lambda s, d: dem(s, d).select("y", "x", rg.wind_cone((10.0, 10.0), (2.0, 1.0), 30.0, 40.0).alias("mask")), f"select y, x, ((x - 9.5e0) * 2 + (y - 9.5e0)) / sqrt(5e0) >= 0 and sqrt(power(x - 9.5e0, 2) + power(y - 9.5e0, 2)) <= 40 and ((x - 9.5e0) * 2 + (y - 9.5e0)) / sqrt(5e0) >= sqrt(power(x - 9.5e0, 2) + power(y - 9.5e0, 2)) * cos(radians(30)) mask from {DEM}")
add("plume_column_to_mass", lambda s, d: dem(s, d).select("y", "x", tidy(rg.convert_column_units(F.col("v") * 1e6), 6).alias("v")), f"select y, x, round(v * 1e6 * (1e-6 / 0.024465e0 * 0.01604e0), 6) + 0.0 v from {DEM}")
_BIG = "v > 80 and y between 5 and 40 and x between 7 and 30"
add("plume_length", lambda s, d: rg.plume_length(dem(s, d).where(_BIG)).select(tidy(F.col("length")).alias("length")), f"with c as (select y, x from {DEM} where {_BIG}) select round(max(sqrt(power(a.y - b.y, 2) + power(a.x - b.x, 2))), 6) + 0.0 length from c a, c b")
add("plume_ime", lambda s, d: rg.ime_estimate(dem(s, d), F.expr(_BIG), 3.0, 4.0).select(*[tidy(F.col(c), 4).alias(c) for c in ("ime", "length", "flux")]), f"with c as (select y, x, v from {DEM} where {_BIG}), l as (select max(sqrt(power(a.y - b.y, 2) + power(a.x - b.x, 2))) * 2 length from c a, c b), i as (select sum(v * 4) ime from c) select round(ime, 4) + 0.0 ime, round(length, 4) + 0.0 length, round(ime * 3 / length, 4) + 0.0 flux from i, l")
add("plume_cross_section", lambda s, d: rg.cross_sectional_flux(dem(s, d), F.lit(True), (5.0, 5.0), (3.0, 4.0), 4, 7.0).select("transect", tidy(F.col("flux"), 5).alias("flux")), f"select k::int transect, round(sum(v) * 5, 5) + 0.0 flux from {DEM}, range(1, 5) t(k) where abs(((x - 4.5e0) * 3 + (y - 4.5e0) * 4) / 5e0 - k * 7) <= 0.5e0 group by 1")
add("plume_sbmp", lambda s, d: _v(rg.sbmp(px(s, d).where("scene = 0").groupBy("y", "x").agg(F.avg("swir").alias("a"), F.avg("swir2").alias("b")), "a", "b"), "y", "x"), f"with g as (select y, x, avg(swir) a, avg(swir2) b from {PX} where scene = 0 group by 1, 2) select y, x, round((b - a) / (b + a + 1e-10), 6) + 0.0 v from g")
add("plume_sbmp_reference", lambda s, d: _v(rg.sbmp(*(lambda g: (g(0), "a", "b", g(1)))(lambda k: px(s, d).where(F.col("scene") == k).groupBy("y", "x").agg((F.avg("swir") + 1).alias("a"), (F.avg("swir2") + 1).alias("b")))), "y", "x"), f"with g as (select scene, y, x, avg(swir) + 1 a, avg(swir2) + 1 b from {PX} where scene < 2 group by all) select p.y, p.x, round(ln((p.b + 1e-10) / (p.a + 1e-10)) - ln((q.b + 1e-10) / (q.a + 1e-10)), 6) + 0.0 v from g p join g q using (y, x) where p.scene = 0 and q.scene = 1")

# backgrounds and matched filters
_T = np.array([1.0 + 0.5 * np.sin(b) for b in range(64)])
_arr = lambda s, d: bg.to_arrays(cube(s, d), ["pixel", "label"])
_COV = f"(select a.band i, b.band j, covar_samp(a.v, b.v) c, count(*) n from {CUBE} a join {CUBE} b using (pixel) group by 1, 2)"


def _matrix(spark, cov):
    rows = [(i, j, float(cov[i, j])) for i in range(len(cov)) for j in range(len(cov))]
    return spark.createDataFrame(rows, "i long, j long, c double").select("i", "j", tidy(F.col("c")).alias("c"))


@query("mf_mean_cov", f"select i, j, round(c, 6) + 0.0 c from {_COV}")
def mf_mean_cov(spark, sf_dir):
    return _matrix(spark, bg.mean_cov(_arr(spark, sf_dir), 64)[1])


def _shrunk(method):
    def run(spark, sf_dir):
        _, cov, n = bg.mean_cov(_arr(spark, sf_dir), 64)
        return _matrix(spark, bg.shrink_covariance(cov, n, method))

    return run


for _m, _sql in (("oas", "least(1, ((1 - 2 / 64e0) * q + t * t) / ((n + 1) * (q - t * t / 64)))"), ("ledoit_wolf", "least(1, (q + t * t / 64) / n / (q - t * t / 64))")):
    add(f"mf_shrink_{_m}", _shrunk(_m), f"with c as {_COV}, s as (select sum(c) filter (i = j) t, sum(c * c) q, max(n) n from c), r as (select t, {_sql} r from s) select i, j, round((1 - r) * c + case when i = j then r * t / 64 else 0 end, 6) + 0.0 c from c, r")


@query("mf_lowrank_cov")
def mf_lowrank_cov(spark, sf_dir):
    return _matrix(spark, bg.lowrank_covariance(bg.mean_cov(_arr(spark, sf_dir), 64)[1], 10))


add("mf_mean", lambda s, d: bg.estimate_mean(cube(s, d), ["band"]).select("band", tidy(F.col("mean")).alias("m")), f"select band, round(avg(v), 6) + 0.0 m from {CUBE} group by 1")
add("mf_median", lambda s, d: bg.estimate_mean(cube(s, d), ["band"], method="median").select("band", tidy(F.col("mean")).alias("m")), f"select band, round(median(v), 6) + 0.0 m from {CUBE} group by 1")
add("mf_trimmed_mean", lambda s, d: bg.estimate_mean(cube(s, d), ["band"], method="trimmed", trim=0.1).select("band", tidy(F.col("mean")).alias("m")), f"select band, round(avg(v), 6) + 0.0 m from (select *, row_number() over (partition by band order by v) r, count(*) over (partition by band) n from {CUBE}) where r > floor(n * 0.1) and r <= n - floor(n * 0.1) group by 1")
add("mf_huber_mean", lambda s, d: bg.huber_mean(cube(s, d), ["band"]).select("band", tidy(F.col("mean")).alias("m")))


def _score_sql():
    w, offset, _ = bg.filter_weights(np.full(64, 0.01), np.diag(np.arange(1.0, 65.0)), _T)
    case = " ".join(f"when {b} then {float(k)!r}::double" for b, k in enumerate(w))
    return f"select pixel, round(sum(v * case band {case} end) - {offset!r}::double, 6) + 0.0 score from {CUBE} group by 1"


@query("mf_score", _score_sql())
def mf_score(spark, sf_dir):
    scored = _arr(spark, sf_dir).withColumn("score", bg.apply_filter(F.col("bands"), np.full(64, 0.01), np.diag(np.arange(1.0, 65.0)), _T))
    return scored.select("pixel", tidy(F.col("score")).alias("score"))


add("mf_matched_filter", lambda s, d: bg.MatchedFilter(_T)(_arr(s, d)).select("pixel", tidy(F.col("score")).alias("score")))
add("mf_cluster_filter", lambda s, d: bg.cluster_filter(_arr(s, d), _T).select("pixel", "label", tidy(F.col("score")).alias("score")))
add("mf_pca_scores", lambda s, d: _arr(s, d).select("pixel", F.transform(bg.project(F.col("bands"), *bg.pca(_arr(s, d), 64, 2)), lambda v: F.round(v, 6)).alias("scores")))
