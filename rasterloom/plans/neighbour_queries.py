"""Queries of neighbourhoods, masks, regions, grids against points, and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import tidy
from ..operators import augment, geom, masks, restore, viz
from ..operators import neighbours as nb
from ..operators import regions as rg
from .fixtures import DEM, GRID, PTS, PX, dem, grid, pts, px
from .registry import add, query

_HIGH = "v > 60"
_mask = lambda s, d: dem(s, d).select("y", "x", F.expr(_HIGH).alias("v"))
_M = f"(select y, x, {_HIGH} v from {DEM})"


def _dilated(m: str, shape: str = "abs(b.y - a.y) <= 1 and abs(b.x - a.x) <= 1") -> str:
    return f"(select a.y, a.x, bool_or(b.v) v from {m} a join {m} b on {shape} group by 1, 2)"


def _eroded(m: str) -> str:
    return f"(select a.y, a.x, count(*) filter (b.v) = 9 v from {m} a join {m} b on b.y between a.y - 1 and a.y + 1 and b.x between a.x - 1 and a.x + 1 group by 1, 2)"


_D = _dilated(_M, "b.y between a.y - 1 and a.y + 1 and b.x between a.x - 1 and a.x + 1")
add("mask_dilate", lambda s, d: nb.dilate(_mask(s, d)), f"select * from {_D}")
add("mask_erode", lambda s, d: nb.erode(_mask(s, d)), f"select * from {_eroded(_M)}")
add("mask_open", lambda s, d: nb.opened(_mask(s, d)), f"with e as {_eroded(_M)} select a.y, a.x, bool_or(b.v) v from e a join e b on b.y between a.y - 1 and a.y + 1 and b.x between a.x - 1 and a.x + 1 group by 1, 2")
add("mask_close", lambda s, d: nb.closed(_mask(s, d)), f"with e as {_D} select a.y, a.x, count(*) filter (b.v) = 9 v from e a join e b on b.y between a.y - 1 and a.y + 1 and b.x between a.x - 1 and a.x + 1 group by 1, 2")
_FAR = "b.y between a.y - 2 and a.y + 2 and b.x between a.x - 2 and a.x + 2 and (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) <= 6.25"
add("mask_buffer", lambda s, d: nb.buffer(_mask(s, d), 2.5), f"select a.y, a.x, bool_or(b.v) v from {_M} a join {_M} b on {_FAR} group by 1, 2")
add("mask_distance_outside", lambda s, d: nb.within_distance(_mask(s, d), 2.5, inside=False), f"select a.y, a.x, not bool_or(b.v) v from {_M} a join {_M} b on {_FAR} group by 1, 2")
_named = lambda s, d, e: dem(s, d).select("y", "x", F.expr(e).alias("mask"))
add("mask_invert", lambda s, d: masks.InvertMask()(_named(s, d, _HIGH)), f"select y, x, not v mask from {_M}")
for _op, _sql in (("or", "v > 60 or x > 30 or y > 50"), ("and", "v > 60 and x > 30 and y > 50"), ("xor", "((v > 60)::int + (x > 30)::int + (y > 50)::int) % 2 = 1")):
    add(f"mask_combine_{_op}", lambda s, d, o=_op: masks.CombineMasks(o)([_named(s, d, e) for e in ("v > 60", "x > 30", "y > 50")]), f"select y, x, {_sql} mask from {DEM}")
add("mask_altitude", lambda s, d: masks.AltitudeMask(dem(s, d), 20, 50)(dem(s, d)), f"select y, x, v between 20 and 50 mask from {DEM}")
add("mask_apply", lambda s, d: masks.ApplyMask(F.expr(_HIGH), -1.0)(dem(s, d)), f"select y, x, case when v > 60 then -1e0 else v end v from {DEM}")
add("mask_apply_keep_box", lambda s, d: masks.ApplyMask(masks.BBoxMask((10.0, 12.0, 30.0, 40.0)), -1.0, invert=True)(dem(s, d)), f"select y, x, case when x + 0.5 between 10 and 30 and y + 0.5 between 12 and 40 then v else -1e0 end v from {DEM}")
add("mask_box_outside", lambda s, d: masks.BBoxMask((600.0, 3700.0, 800.0, 3900.0), (10.0, 0.0, 500.0, 0.0, -10.0, 4000.0), inside=False)(dem(s, d)), f"select y, x, not (x * 10 + 505 between 600 and 800 and 3995 - y * 10 between 3700 and 3900) mask from {DEM}")
add("mask_distance", lambda s, d: masks.DistanceMask(20.0, (10.0, 8.0))(_named(s, d, "v > 90")), f"with m as (select y, x, v > 90 v from {DEM}) select a.y, a.x, bool_or(b.v) mask from m a join m b on b.y between a.y - 2 and a.y + 2 and b.x between a.x - 2 and a.x + 2 and power((a.y - b.y) * 10, 2) + power((a.x - b.x) * 8, 2) <= 400 group by 1, 2")
# blocks of 5 x 5, a third of them with holes, and single cells, which go; the rest is closed
_DIRTY = "(y % 16 < 5 and x % 16 < 5 and not (y % 16 = 2 and x % 16 = 2 and y % 32 < 16)) or (y % 16 = 10 and x % 16 = 10)"
add("mask_clean", lambda s, d: masks.CleanMask((64, 64), 10, 3, 1)(_named(s, d, _DIRTY)), f"with m as (select y, x, y % 16 < 5 and x % 16 < 5 v from {DEM}), d as {_dilated('m', 'b.y between a.y - 1 and a.y + 1 and b.x between a.x - 1 and a.x + 1')} select a.y, a.x, count(*) filter (b.v) = 9 mask from d a join d b on b.y between a.y - 1 and a.y + 1 and b.x between a.x - 1 and a.x + 1 group by 1, 2")

_GRAD = f"""(select y, x, v, case when lag(v) over r is null then lead(v) over r - v when lead(v) over r is null then v - lag(v) over r else (lead(v) over r - lag(v) over r) / 2 end gy,
 case when lag(v) over c is null then lead(v) over c - v when lead(v) over c is null then v - lag(v) over c else (lead(v) over c - lag(v) over c) / 2 end gx from {DEM} window r as (partition by x order by y), c as (partition by y order by x))"""
add("mask_slope_degrees", lambda s, d: nb.slope_degrees(dem(s, d)).select("y", "x", tidy(F.col("slope")).alias("slope")), f"select y, x, round(degrees(atan(sqrt(gx * gx + gy * gy))), 6) + 0.0 slope from {_GRAD}")
add("mask_slope", lambda s, d: nb.slope_mask(dem(s, d), low=70.0, high=85.0), f"select y, x, degrees(atan(sqrt(gx * gx + gy * gy))) between 70 and 85 mask from {_GRAD}")
_LIGHT = "(sin(radians(45)) * sin(pi() / 2 - atan(sqrt(gx * gx + gy * gy))) + cos(radians(45)) * cos(pi() / 2 - atan(sqrt(gx * gx + gy * gy))) * cos(radians(450 - 315) - atan2(-gx, gy)))"
add("viz_hillshade", lambda s, d: viz.hillshade(dem(s, d)), f"select y, x, floor(least(greatest({_LIGHT}, 0), 1) * 255)::int shade from {_GRAD}")

_HOLES = "(y * 7 + x * 11) % 13 = 0"
_gaps = lambda s, d: dem(s, d).withColumn("v", F.when(F.expr(_HOLES), F.lit(float("nan"))).otherwise(F.col("v")))
add("restore_gap_fill_idw", lambda s, d: restore.gap_fill_idw(_gaps(s, d), radius=2).select("y", "x", tidy(F.col("v")).alias("v")), f"with o as (select * from {DEM} where not {_HOLES}), g as (select y, x from {DEM} where {_HOLES}) select y, x, v + 0.0 v from o union all select g.y, g.x, round(sum(o.v / ((o.y - g.y) * (o.y - g.y) + (o.x - g.x) * (o.x - g.x))) / sum(1e0 / ((o.y - g.y) * (o.y - g.y) + (o.x - g.x) * (o.x - g.x))), 6) + 0.0 from g join o on o.y between g.y - 2 and g.y + 2 and o.x between g.x - 2 and g.x + 2 and (o.y - g.y) * (o.y - g.y) + (o.x - g.x) * (o.x - g.x) <= 4 group by 1, 2")
add("restore_gap_fill_nearest", lambda s, d: restore.gap_fill_nearest(_gaps(s, d), max_distance=2).select("y", "x", tidy(F.col("v")).alias("v")), f"with o as (select * from {DEM} where not {_HOLES}), g as (select y, x from {DEM} where {_HOLES}) select y, x, v + 0.0 v from o union all select g.y, g.x, first(o.v order by (o.y - g.y) * (o.y - g.y) + (o.x - g.x) * (o.x - g.x), o.y - g.y, o.x - g.x) + 0.0 from g join o on o.y between g.y - 2 and g.y + 2 and o.x between g.x - 2 and g.x + 2 and (o.y - g.y) * (o.y - g.y) + (o.x - g.x) * (o.x - g.x) <= 4 group by 1, 2")
_GAPS = f"(select y, x, case when not ({_HOLES}) then v end v from {DEM})"
_no_nan = lambda df, digits=6: df.select("y", "x", F.when(~F.isnan("v"), tidy(F.col("v"), digits)).alias("v"))


def _window(of: str, radius: int, columns: str, pad: str = "least(63, greatest(0, {0}))") -> str:
    """Cells a of a field with those of their padded windows, b at (i, j)."""
    places = f"cross join range(-{radius}, {radius + 1}) p(i) cross join range(-{radius}, {radius + 1}) q(j)"
    return f"(select a.y, a.x, a.v, {columns} from {of} a {places} join {of} b on b.y = {pad.format('a.y + i')} and b.x = {pad.format('a.x + j')} group by 1, 2, 3)"


add("restore_median", lambda s, d: _no_nan(restore.median_denoise(_gaps(s, d), 3)), f"with g as {_GAPS}, f as (select y, x, coalesce(v, (select median(v) from g)) v from g) select w.y, w.x, case when g.v is not null then round(m, 6) + 0.0 end v from {_window('f', 1, 'median(b.v) m')} w join g on g.y = w.y and g.x = w.x")
_W = "exp(-(i * i + j * j) / 0.5e0)"
add("restore_gaussian", lambda s, d: _no_nan(restore.gaussian_denoise(_gaps(s, d), 0.5)), f"with g as {_GAPS} select y, x, case when v is not null then round(m, 6) + 0.0 end v from {_window('g', 2, f'sum(b.v * {_W}) / sum({_W}) filter (b.v is not null) m')}")
_LOCAL = _window("g", 1, "avg(b.v) m, var_pop(b.v) s")
add("restore_lee", lambda s, d: _no_nan(restore.despeckle_lee(_gaps(s, d), 3), 5), f"with g as {_GAPS} select y, x, round(m + case when s > 0 then 0.5e0 * s / (s + power(0.523e0 * m, 2)) else 0 end * (v - m), 5) + 0.0 v from {_LOCAL}")
add("restore_frost", lambda s, d: _no_nan(restore.despeckle_frost(_gaps(s, d), 3), 5), f"with g as {_GAPS}, a as (select *, case when m <> 0 then exp(-2 * sqrt(s) / abs(m)) else 1 end a from {_LOCAL}) select y, x, round(a * v + (1 - a) * m, 5) + 0.0 v from a")
add("mf_adaptive_background", lambda s, d: nb.adaptive_background(dem(s, d), 5).select("y", "x", tidy(F.col("mean"), 5).alias("m"), tidy(F.col("var"), 5).alias("s")), f"with g as {DEM} select y, x, round(m, 5) + 0.0 m, round(s * 25 / 24e0, 5) + 0.0 s from " + _window("g", 2, "avg(b.v) m, var_pop(b.v) s", "case when {0} < 0 then -1 - ({0}) when {0} > 63 then 127 - ({0}) else {0} end"))
for _how, _f in (("mean", "avg"), ("median", "median")):
    add(f"restore_destripe_{_how}", lambda s, d, h=_how: restore.destripe(grid(s, d), method=h).select("y", "x", tidy(F.col("v")).alias("v")), f"with g as {GRID}, p as (select x, {_f}(v) p from g group by 1), t as (select {_f}(p) t from p) select y, x, round(v - (p - t), 6) + 0.0 v from g join p using (x), t")

add("restore_destripe_moment_matching", lambda s, d: restore.destripe(dem(s, d), method="moment_matching", window=3).select("y", "x", tidy(F.col("v")).alias("v")), f"with d as {DEM}, p as (select x, avg(v) p from d group by 1), t as (select avg(p) t from p), g as (select y, x, v - (p - t) v from d join p using (x), t) select y, x, round(m, 6) + 0.0 v from {_window('g', 1, 'avg(b.v) m')}")

# regions
_BLOB = "(y % 16 < 5 and x % 16 < 5) or (y % 16 = 10 and x % 16 = 10)"
_LBL = f"(select y, x, case when y % 16 < 5 then y // 16 * 4 + x // 16 + 1 else 0 end label from {DEM} where {_BLOB})"
_cells = lambda s, d: dem(s, d).withColumn("m", F.expr(_BLOB))
add("region_remove_small_objects", lambda s, d: rg.remove_small_objects(_cells(s, d), F.col("m"), 10), f"select y, x, y % 16 < 5 and x % 16 < 5 mask from {DEM}")
add("region_remove_small_holes", lambda s, d: rg.remove_small_holes(_cells(s, d).withColumn("m", ~F.col("m")), F.col("m"), 3, (64, 64)), f"select y, x, not (y % 16 < 5 and x % 16 < 5) mask from {DEM}")
add("region_label", lambda s, d: rg.label_components(_cells(s, d), F.col("m"), 1).join(dem(s, d).select("y", "x"), ["y", "x"]).groupBy("label").agg(F.count("*").alias("n"), F.min("y").alias("y"), F.min("x").alias("x")), f"with l as (select y // 16 a, x // 16 b, y % 16 < 5 k, count(*) n, min(y) y, min(x) x from {DEM} where {_BLOB} group by all) select row_number() over (order by y, x)::int label, n, y, x from l")
add("plume_mask", lambda s, d: rg.plume_mask(dem(s, d).withColumn("v", F.expr(_BLOB).cast("double")), 0.5, 10), f"select y, x, y % 16 < 5 and x % 16 < 5 mask from {DEM}")
_lab = lambda s, d: dem(s, d).select("y", "x", F.expr("case when y % 16 < 3 and x % 16 < 3 then cast(y div 16 * 4 + x div 16 + 1 as long) else 0 end").alias("label"))
_L = f"(select y, x, case when y % 16 < 3 and x % 16 < 3 then y // 16 * 4 + x // 16 + 1 else 0 end label from {DEM})"
add("segment_expand_labels", lambda s, d: nb.expand_labels(_lab(s, d), 2.0), f"with l as {_L}, n as (select a.y, a.x, min(b.label) filter (b.label > 0) label from l a join l b on (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) <= 4 and b.y between a.y - 2 and a.y + 2 and b.x between a.x - 2 and a.x + 2 group by 1, 2) select y, x, coalesce(label, 0) label from n")
add("segment_boundaries", lambda s, d: nb.boundaries(_lab(s, d)), f"with l as {_L} select a.y, a.x, min(b.label) <> max(b.label) boundary from l a join l b on abs(a.y - b.y) + abs(a.x - b.x) <= 1 and b.y between a.y - 1 and a.y + 1 and b.x between a.x - 1 and a.x + 1 group by 1, 2")
add("segment_merge_instances", lambda s, d: rg.merge_nearby_instances(_pairs_of_boxes(s)).groupBy(F.col("label").cast("long").alias("label")).agg(F.count("*").alias("n")), "select k + 1 label, case when k % 2 = 0 then 120 else 50 end::bigint n from range(4) t(k)")


def _pairs_of_boxes(spark):
    # instances 1 and 2 overlap, 3 is alone; 4 and 5 overlap, 6 is alone
    boxes = [(1, 0, 0, 10, 6), (2, 0, 3, 10, 9), (3, 40, 40, 10, 5), (4, 100, 0, 10, 6), (5, 100, 3, 10, 9), (6, 200, 200, 10, 5)]
    rows = [(k, y, x) for k, y0, x0, h, w in ((b[0], b[1], b[2], b[3], 6 if b[0] % 3 else 5) for b in boxes) for y in range(y0, y0 + h) for x in range(x0, x0 + w)]
    return spark.createDataFrame(rows, "label long, y long, x long")


@query("segment_mask_nms", "select unnest([1, 2])::int label, unnest([100, 25])::bigint n")
def segment_mask_nms(spark, sf_dir):
    masks = [("a", range(0, 10), range(0, 10)), ("b", range(1, 10), range(1, 10)), ("c", range(30, 35), range(30, 35))]
    rows = [(k, y, x) for k, ys, xs in masks for y in ys for x in xs]
    return rg.mask_nms(spark.createDataFrame(rows, "id string, y long, x long")).groupBy("label").agg(F.count("*").alias("n"))


# grids and points
_vg = lambda s, d: dem(s, d)
add("geom_crop_to", lambda s, d: geom.crop_to(dem(s, d), (64, 64), (33, 20)), f"select y - 15 y, x - 22 x, v from {DEM} where y between 15 and 47 and x between 22 and 41")
add("geom_crop_to_bounds", lambda s, d: geom.crop_to_bounds(dem(s, d), (10.0, 0.0, 500.0, 0.0, -10.0, 4000.0), (600.0, 3700.0, 800.0, 3900.0)), f"select y - 10 y, x - 10 x, v from {DEM} where y between 10 and 29 and x between 10 and 29")
add("geom_pad_constant", lambda s, d: geom.pad_to(dem(s, d), (64, 64), (67, 70), fill=-1.0), f"select g.y, g.x, coalesce(d.v, -1) v from (select y, x from range(67) a(y), range(70) b(x)) g left join {DEM} d on d.y = g.y - 1 and d.x = g.x - 3")
add("geom_pad_reflect", lambda s, d: geom.pad_to(dem(s, d), (64, 64), (68, 70), "reflect"), f"select g.y, g.x, d.v from (select y, x from range(68) a(y), range(70) b(x)) g join {DEM} d on d.y = case when g.y < 2 then 2 - g.y when g.y >= 66 then 126 - (g.y - 2) else g.y - 2 end and d.x = case when g.x < 3 then 3 - g.x when g.x >= 67 then 126 - (g.x - 3) else g.x - 3 end")
add("geom_pad_edge", lambda s, d: geom.pad_to(dem(s, d), (64, 64), (68, 70), "edge"), f"select g.y, g.x, d.v from (select y, x from range(68) a(y), range(70) b(x)) g join {DEM} d on d.y = least(63, greatest(0, g.y - 2)) and d.x = least(63, greatest(0, g.x - 3))")
add("geom_tile", lambda s, d: geom.tile(dem(s, d), (20, 20), (16, 16)).select("ty", "tx", "r", "c", "v"), f"select ty, tx, y - 16 * ty r, x - 16 * tx c, v from {DEM}, range(4) a(ty), range(4) b(tx) where y - 16 * ty between 0 and 19 and x - 16 * tx between 0 and 19")
add("geom_sliding_window", lambda s, d: geom.tile(dem(s, d), (16, 16), (8, 8), (64, 64), include_incomplete=False).groupBy("ty", "tx").agg(F.sum("v").alias("v")), f"select ty, tx, sum(v) v from {DEM}, range(7) a(ty), range(7) b(tx) where y - 8 * ty between 0 and 15 and x - 8 * tx between 0 and 15 group by 1, 2")
_tiles = lambda s, d: geom.tile(dem(s, d), (20, 20), (16, 16)).withColumn("k", F.col("ty") * 10 + F.col("tx")).withColumn("v", F.col("v") + F.col("k"))
_TILES = f"(select y, x, y - 16 * ty r, x - 16 * tx c, ty * 10 + tx k, v + ty * 10 + tx v from {DEM}, range(4) a(ty), range(4) b(tx) where y - 16 * ty between 0 and 19 and x - 16 * tx between 0 and 19)"
_RAMP = "least(1, least({0} + 1, 20 - {0}) / 16e0)"
for _b, _sql in (("average", "avg(v)"), ("feather", f"sum(v * {_RAMP.format('r')} * {_RAMP.format('c')}) / sum({_RAMP.format('r')} * {_RAMP.format('c')})"), ("max", "max(v)"), ("first", "first(v order by k)")):
    add(f"geom_stitch_{_b}", lambda s, d, b=_b: geom.stitch(_tiles(s, d), (20, 20), b).select("y", "x", tidy(F.col("v")).alias("v")), f"select y, x, round({_sql}, 6) + 0.0 v from {_TILES} group by 1, 2")
add("geom_spatial_pool", lambda s, d: geom.spatial_pool(dem(s, d), 4).select("y", "x", tidy(F.col("v")).alias("v")), f"select y // 4 y, x // 4 x, round(avg(v), 6) + 0.0 v from {DEM} group by 1, 2")
add("geom_per_band_reduce", lambda s, d: geom.per_band_reduce(px(s, d), "mean", ("scene",), "nir").select("scene", tidy(F.col("v")).alias("v")), f"select scene, round(avg(nir), 6) + 0.0 v from {PX} group by 1")
add("geom_georeference", lambda s, d: geom.georeference(dem(s, d), dem(s, d).select("y", "x", F.col("x").alias("row"), (F.col("y") + 1).alias("col"))), f"select g.y, g.x, d.v from {DEM} g left join {DEM} d on d.y = g.x and d.x = g.y + 1")
add("geom_antimeridian", lambda s, d: geom.antimeridian_split(dem(s, d).withColumn("lon", F.when(F.col("x") < 40, 140.0 + F.col("x")).otherwise(-180.0 + F.col("x") - 40))).groupBy("part").agg(F.min("x").alias("lo"), F.max("x").alias("hi")), "select 0 part, 40::bigint lo, 63::bigint hi union all select 1, 0, 39")
add("geom_segment_stitch", lambda s, d: geom.segment_stitch(dem(s, d).where("y < 40 and not (y >= 10 and y < 20)").select((F.floor(F.col("y") / 10) + 1).alias("k"), (F.col("y") % 10).alias("y"), "x", "v"), 10, 4, -9.0), f"select y, x, case when y between 10 and 19 then -9 else v end v from {DEM} where y < 40")
add("coreg_raster_to_points", lambda s, d: geom.raster_to_points(pts(s, d), dem(s, d)).select("id", "v"), f"select id, v from {PTS} join {DEM} on y = floor(py) and x = floor(px)")
_BI = f"(select id, sum(v * (1 - abs(py - 0.5e0 - y)) * (1 - abs(px - 0.5e0 - x))) v from {PTS} join {DEM} on abs(py - 0.5e0 - y) < 1 and abs(px - 0.5e0 - x) < 1 where px >= 0.5 and py >= 0.5 and px <= 63.5 and py <= 63.5 group by 1)"
add("coreg_bilinear", lambda s, d: geom.raster_to_points(pts(s, d).where("px >= 0.5 and py >= 0.5 and px <= 63.5 and py <= 63.5"), dem(s, d), method="bilinear").select("id", tidy(F.col("v")).alias("v")), f"select id, round(v, 6) + 0.0 v from {_BI}")
for _st, _sql in (("mean", "avg(value)"), ("median", "median(value)"), ("sum", "sum(value)"), ("count", "count(value)::double"), ("max", "max(value)"), ("min", "min(value)")):
    _none = "0" if _st in ("sum", "count") else "null"
    add(f"coreg_points_to_raster_{_st}", lambda s, d, st=_st: geom.points_to_raster(pts(s, d), (64, 64), st).select("y", "x", F.when(F.isnan("v"), None).otherwise(tidy(F.col("v"))).alias("v")), f"select g.y, g.x, coalesce(round(p.v, 6) + 0.0, {_none}) v from {DEM} g left join (select floor(py)::bigint y, floor(px)::bigint x, {_sql} v from {PTS} group by 1, 2) p using (y, x)")
_FROM_CENTRE = "power((x + 0.5e0) - px, 2) + power((y + 0.5e0) - py, 2)"
add("coreg_idw", lambda s, d: geom.points_to_raster_idw(pts(s, d), (64, 64), 3, 2.0, 1.0).select("y", "x", tidy(F.col("v")).alias("v")), f"select y, x, round(sum(value / greatest(dd, 1e-12)) / sum(1 / greatest(dd, 1e-12)), 6) + 0.0 v from (select y, x, value, {_FROM_CENTRE} dd, row_number() over (partition by y, x order by sqrt({_FROM_CENTRE}), id) r from {PTS}, range(64) a(y), range(64) b(x) where px between x - 8 and x + 9 and py between y - 8 and y + 9) where r <= 3 group by 1, 2")
_BOXES = "(select id, px - 1.3e0 xmin, px + 1.3e0 xmax, py - 1.1e0 ymin, py + 1.1e0 ymax, value from " + PTS + ")"
_bx = lambda s, d: pts(s, d).select("id", (F.col("px") - 1.3).alias("xmin"), (F.col("px") + 1.3).alias("xmax"), (F.col("py") - 1.1).alias("ymin"), (F.col("py") + 1.1).alias("ymax"), "value")
for _ag, _sql in (("mean", "avg(value)"), ("sum", "sum(value)"), ("max", "max(value)"), ("count", "count(value)::double"), ("first", "first(value order by id)"), ("last", "last(value order by id)")):
    add(f"coreg_vector_{_ag}", lambda s, d, a=_ag: geom.vector_to_raster(_bx(s, d), (64, 64), a).select("y", "x", F.when(F.isnan("v"), None).otherwise(tidy(F.col("v"))).alias("v")), f"select g.y, g.x, coalesce(round(p.v, 6) + 0.0, {'0' if _ag == 'count' else 'null'}) v from {DEM} g left join (select y, x, {_sql} v from {DEM} d join {_BOXES} b on x + 0.5e0 between xmin and xmax and y + 0.5e0 between ymin and ymax group by 1, 2) p using (y, x)")


@query("mask_polygon", f"select y, x, x + 0.5e0 + y + 0.5e0 > 40.2 and x + 0.5e0 < 50.2 and y + 0.5e0 < 50.2 mask from {DEM}")
def mask_polygon(spark, sf_dir):
    from ..functions import wkb

    return geom.polygon_mask(dem(spark, sf_dir), wkb.polygon([(50.2, -10.0), (50.2, 50.2), (-10.0, 50.2)]))


add("geom_resample_nearest", lambda s, d: geom.resample(dem(s, d), (64, 64), (32, 16), "nearest"), f"select y // 2 y, x // 4 x, v from {DEM} where y % 2 = 1 and x % 4 = 2")
add("geom_reproject_nearest", lambda s, d: geom.reproject(dem(s, d), (1.0, 0.0, 0.0, 0.0, 1.0, 0.0), (2.0, 0.0, 10.0, 0.0, 2.0, 10.0), (20, 20)).select("y", "x", "v"), f"select (y - 11) // 2 y, (x - 11) // 2 x, v from {DEM} where y between 11 and 49 and x between 11 and 49 and y % 2 = 1 and x % 2 = 1")
add("geom_bowtie", lambda s, d: geom.bowtie_correction(dem(s, d), (64, 64), 30.0), f"select g.y, g.x, d.v from {DEM} g left join {DEM} d on d.y = g.y and d.x = round_even(31.5e0 + (g.x - 31.5e0) * cos(radians((g.x - 31.5e0) / 31.5e0 * 30)), 0)::bigint")
add("geom_profile_line", lambda s, d: geom.profile_line(dem(s, d), (3.0, 5.0), (3.0, 25.0)).select("k", tidy(F.col("v")).alias("v")), f"select x - 5 k, v + 0.0 v from {DEM} where y = 3 and x between 5 and 25")
add("viz_annotate_points", lambda s, d: viz.annotate_points(dem(s, d).select("y", "x", F.lit(0.0).alias("r"), F.lit(0.0).alias("g"), F.lit(0.0).alias("b")), pts(s, d), 0).select("y", "x", "r"), f"with p as (select distinct floor(px) px, floor(py) py from {PTS}) select y, x, case when exists (select 1 from p where x = px and y = py) then 1e0 else 0e0 end r from {DEM}")
add("viz_blend", lambda s, d: viz.blend_rgba(*(dem(s, d).select("y", "x", (F.col("v") / k).alias("r"), F.lit(0.5).alias("g"), F.lit(0.25).alias("b"), F.lit(0.8).alias("a")) for k in (100.0, 200.0)), keys=("y", "x"), mode="screen").select("y", "x", tidy(F.col("r")).alias("r"), tidy(F.col("a")).alias("a")), f"select y, x, round(v / 100 * (1 - 0.48e0) + (1 - (1 - v / 100) * (1 - v / 200)) * 0.48e0, 6) + 0.0 r, round(0.48e0 + 0.8e0 * (1 - 0.48e0), 6) + 0.0 a from {DEM}")
add("viz_ensure_rgba", lambda s, d: viz.ensure_rgba(dem(s, d), ("y", "x")).select("y", "x", "r", "a"), f"select y, x, v r, 255 a from {DEM}")
add("feature_peak_local_max", lambda s, d: nb.peak_local_max(dem(s, d), 2, 60.0).select("y", "x", tidy(F.col("score")).alias("score")), f"with g as {DEM} select a.y, a.x, round(first(a.v), 6) + 0.0 score from g a join g b on b.y between a.y - 2 and a.y + 2 and b.x between a.x - 2 and a.x + 2 group by 1, 2 having first(a.v) = max(b.v) and count(*) = 25 and first(a.v) > 60")

# augmentation is seeded by hashes, which SQL engines do not share
_scenes = lambda s, d: dem(s, d).join(s.range(3).withColumnRenamed("id", "scene"))
add("aug_flip", lambda s, d: augment.random_flip(_scenes(s, d), (64, 64), seed=3))
add("aug_rotate90", lambda s, d: augment.random_rotate90(_scenes(s, d), (64, 64), seed=3))
add("aug_crop", lambda s, d: augment.random_crop(_scenes(s, d), (64, 64), (16, 16), seed=3))
add("aug_shift", lambda s, d: augment.random_shift(_scenes(s, d), (64, 64), 3, 0.0, seed=3))
add("aug_brightness", lambda s, d: augment.brightness_jitter(_scenes(s, d), seed=3))
add("aug_contrast", lambda s, d: augment.contrast_jitter(_scenes(s, d), seed=3))
add("aug_noise", lambda s, d: augment.gaussian_noise(_scenes(s, d), seed=3))
add("aug_speckle", lambda s, d: augment.speckle_noise(_scenes(s, d), seed=3))
add("aug_band_dropout", lambda s, d: augment.band_dropout(_scenes(s, d).withColumn("band", F.col("x") % 4), 0.5, seed=3))
add("aug_band_jitter", lambda s, d: augment.band_jitter(_scenes(s, d).withColumn("band", F.col("x") % 4), [[0, 1, 2]], seed=3))
add("aug_sun_angle", lambda s, d: augment.sun_angle_jitter(_scenes(s, d), 40.0, seed=3))
add("aug_haze", lambda s, d: augment.atmospheric_haze(_scenes(s, d).withColumn("band", F.col("x") % 4), [450.0, 550.0, 650.0, 850.0], seed=3))
add("aug_cut_mix", lambda s, d: augment.cut_mix(_scenes(s, d), _scenes(s, d).withColumnRenamed("scene", "donor").withColumn("v", F.col("v") + 100), (64, 64), 1.0, seed=3))
