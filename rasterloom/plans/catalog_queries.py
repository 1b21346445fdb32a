"""Queries of the catalogue, matchups and item sources."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import boxes
from ..functions.numeric import tidy
from ..operators import joins
from ..operators import matchup as mu
from ..sources import items, slices
from ..sources.catalog import Catalog
from .fixtures import CAT, CAT_B, PTS, PX, cat, cat_b, pts, px, table
from .registry import add, query

_AOI, _T = (-140.0, -40.0, -40.0, 40.0), (dt.datetime(1996, 1, 1), dt.datetime(1997, 12, 31))
_HIT = "xmin <= -40 and xmax >= -140 and ymin <= 40 and ymax >= -40"
_NEAR_ZERO = "xmin <= 20 and xmax >= -20 and ymin <= 20 and ymax >= -20"
_WHEN = "end_time >= timestamp '1996-01-01' and start_time <= timestamp '1997-12-31'"
_ROW = "filepath, xmin, ymin, xmax, ymax, start_time, end_time"


def _row(df):
    return df.select(*_ROW.split(", "))


add("cat_query_bbox", lambda s, d: _row(Catalog(cat(s, d)).query(bounds=_AOI).df), f"select {_ROW} from {CAT} where {_HIT}")
add("cat_query_time", lambda s, d: _row(Catalog(cat(s, d)).query(time=_T).df), f"select {_ROW} from {CAT} where {_WHEN}")
add("cat_query_bbox_time", lambda s, d: _row(Catalog(cat(s, d)).query(bounds=_AOI, time=_T).df), f"select {_ROW} from {CAT} where {_HIT} and {_WHEN}")
add("cat_query_all", lambda s, d: _row(Catalog(cat(s, d)).query().df), f"select {_ROW} from {CAT}")
add("cat_query_slice", lambda s, d: _row(Catalog(cat(s, d)).query(slices.GeoSlice(_AOI, _T, (1.0, 1.0))).df), f"select {_ROW} from {CAT} where {_HIT} and {_WHEN}")
add("cat_where", lambda s, d: _row(Catalog(cat(s, d)).where("status = 'F' and xmax - xmin > 2").df), f"select {_ROW} from {CAT} where status = 'F' and xmax - xmin > 2")
add("cat_total_bounds", lambda s, d: Catalog(cat(s, d)).total_bounds(), f"select min(xmin) xmin, min(ymin) ymin, max(xmax) xmax, max(ymax) ymax from {CAT}")
add("cat_temporal_extent", lambda s, d: Catalog(cat(s, d)).temporal_extent(), f"select min(start_time) start_time, max(end_time) end_time from {CAT}")
add("cat_stats", lambda s, d: Catalog(cat(s, d)).stats(), f"select count(*) n, min(xmin) xmin, min(ymin) ymin, max(xmax) xmax, max(ymax) ymax, min(start_time) start_time, max(end_time) end_time from {CAT}")
add("cat_count", lambda s, d: Catalog(cat(s, d)).query(bounds=_AOI).df.agg(F.count("*").alias("n")), f"select count(*) n from {CAT} where {_HIT}")
add("cat_row", lambda s, d: _row(Catalog(cat(s, d)).row(17)), f"select {_ROW} from {CAT} order by filepath, start_time limit 1 offset 17")
add("cat_union", lambda s, d: Catalog(cat(s, d)).union(Catalog(cat_b(s, d).drop("status"))).df.select("filepath", "status", "xmin"), f"select filepath, status, xmin from {CAT} union all select filepath, null, xmin from {CAT_B}")
add("cat_slices", lambda s, d: Catalog(cat(s, d)).slices((0.5, 0.3)).select("filepath", "height", "width"), f"select filepath, round_even((ymax - ymin) / 0.3e0, 0)::bigint height, round_even((xmax - xmin) / 0.5e0, 0)::bigint width from {CAT}")

_BOTH = f"select a.filepath, b.filepath _right_filepath, greatest(a.xmin, b.xmin) xmin, greatest(a.ymin, b.ymin) ymin, least(a.xmax, b.xmax) xmax, least(a.ymax, b.ymax) ymax, greatest(a.start_time, b.start_time) start_time, least(a.end_time, b.end_time) end_time from {CAT} a join {CAT_B} b on a.xmin <= b.xmax and a.xmax >= b.xmin and a.ymin <= b.ymax and a.ymax >= b.ymin"
_PAIR = ("filepath", "_right_filepath", "xmin", "ymin", "xmax", "ymax", "start_time", "end_time")
add("cat_intersect", lambda s, d: Catalog(cat(s, d)).intersect(Catalog(cat_b(s, d))).df.select(*_PAIR), f"select * from ({_BOTH} and a.start_time <= b.end_time and a.end_time >= b.start_time) where xmin < xmax and ymin < ymax")
add("cat_intersect_touching", lambda s, d: Catalog(cat(s, d)).intersect(Catalog(cat_b(s, d)), drop_touching=False).df.select(*_PAIR), f"{_BOTH} and a.start_time <= b.end_time and a.end_time >= b.start_time")
add("cat_intersect_spatial_only", lambda s, d: Catalog(cat(s, d).drop("id", "status")).intersect(Catalog(cat_b(s, d).drop("id", "status")), spatial_only=True).df.select(*_PAIR[:6]), f"select filepath, _right_filepath, xmin, ymin, xmax, ymax from ({_BOTH}) where xmin < xmax and ymin < ymax")
add("cat_written_and_opened", lambda s, d: _round_trip(s, d), f"select filepath, xmin, ymax, start_time, year(start_time)::int \"year\" from {CAT} where {_HIT}")


def _round_trip(spark, sf_dir):
    from ..checkpoints import scratch
    from ..sources.catalog import open_catalog

    path = scratch(spark, "catalog")
    Catalog(cat(spark, sf_dir)).write(path, partition_by=["year"])
    return open_catalog(spark, path, strict=True).query(bounds=_AOI).df.select("filepath", "xmin", "ymax", "start_time", "year")


add("grid_divide_evenly", lambda s, d: cat(s, d).select("filepath", F.coalesce(slices.divided_evenly(F.col("xmax") - F.col("xmin"), F.lit(0.75)), F.lit(-1)).alias("n")), f"select filepath, case when abs(round_even((xmax - xmin) / 0.75e0, 0) * 0.75e0 - (xmax - xmin)) <= 1e-3 then round_even((xmax - xmin) / 0.75e0, 0)::bigint else -1 end n from {CAT}")
add(
    "grid_is_aligned",
    lambda s, d: cat(s, d).select("filepath", slices.is_grid_aligned({"crs": F.lit("a"), "rx": F.lit(0.75), "ry": F.lit(0.75), "x0": F.col("xmin"), "y0": F.col("ymin")}, {"crs": F.lit("a"), "rx": F.lit(0.75), "ry": F.lit(0.75), "x0": F.lit(0.0), "y0": F.lit(0.0)}).alias("v")),
    f"select filepath, abs((xmin / 0.75e0 - round_even(xmin / 0.75e0, 0)) * 0.75e0) <= 1e-3 and abs((ymin / 0.75e0 - round_even(ymin / 0.75e0, 0)) * 0.75e0) <= 1e-3 v from {CAT}",
)
add("box_iou", lambda s, d: cat(s, d).select("filepath", tidy(boxes.iou(boxes.box(), tuple(F.lit(k) for k in (-20.0, -20.0, 20.0, 20.0)))).alias("v")), f"select filepath, round(case when {_NEAR_ZERO} then greatest(least(xmax, 20) - greatest(xmin, -20), 0) * greatest(least(ymax, 20) - greatest(ymin, -20), 0) else 0 end / ((xmax - xmin) * (ymax - ymin) + 1600 - case when {_NEAR_ZERO} then greatest(least(xmax, 20) - greatest(xmin, -20), 0) * greatest(least(ymax, 20) - greatest(ymin, -20), 0) else 0 end), 6) + 0.0 v from {CAT}")
add("geo_mercator", lambda s, d: cat(s, d).select("filepath", *[tidy(c, 3).alias(n) for c, n in zip(boxes.to_mercator(F.col("xmin"), F.col("ymin")), "xy", strict=True)]), f"select filepath, round(radians(xmin) * 6378137, 3) + 0.0 x, round(ln(tan(pi() / 4 + radians(ymin) / 2)) * 6378137, 3) + 0.0 y from {CAT}")
add("geo_mercator_back", lambda s, d: cat(s, d).select("filepath", *[tidy(c).alias(n) for c, n in zip(boxes.from_mercator(*boxes.to_mercator(F.col("xmin"), F.col("ymin"))), "xy", strict=True)]), f"select filepath, xmin + 0.0 x, ymin + 0.0 y from {CAT}")
add("geo_affine", lambda s, d: cat(s, d).select("filepath", *[tidy(c).alias(n) for c, n in zip(boxes.inverse((10.0, 0.0, 500.0, 0.0, -10.0, 4000.0), F.col("xmin"), F.col("ymin")), ("c", "r"), strict=True)]), f"select filepath, round((xmin - 500) / 10e0, 6) + 0.0 c, round((ymin - 4000) / -10e0, 6) + 0.0 r from {CAT}")
add("catalog_hilbert_key", lambda s, d: cat(s, d).select("filepath", boxes.curve_key(F.col("xmin"), F.col("ymin")).alias("key")))

_MID = "(epoch_us({0}.start_time) + epoch_us({0}.end_time)) / 2e0 / 1e6"
_CAND = f"select p.id pid, s.id sid, {_MID.format('s')} - {_MID.format('p')} off, p.xmin pxmin, p.ymin pymin, p.xmax pxmax, p.ymax pymax, s.* from {CAT} p join {CAT_B} s on p.xmin <= s.xmax and p.xmax >= s.xmin and p.ymin <= s.ymax and p.ymax >= s.ymin"
_NEAR = f"select * from (select *, row_number() over (partition by pid order by abs(off), sid) n from ({_CAND}) where abs(off) <= 20000000) where n = 1"


def _pairs(df):
    return df.select(F.col("member_ids")[0].alias("p"), F.col("member_ids")[1].alias("s"), tidy(F.col("time_offset_sec")[1]).alias("off"))


def _match(spatial, temporal):
    return lambda s, d: _pairs(mu.matchup(cat(s, d), {"b": cat_b(s, d)}, spatial=spatial, temporal=temporal))


_OUT = "select pid p, sid s, round(off, 6) + 0.0 off from"
add("match_nearest", _match(mu.Intersects(), mu.NearestInTime(2e7)), f"{_OUT} ({_NEAR})")
add("match_nearest_contains", _match(mu.Contains(), mu.NearestInTime(2e7)), f"{_OUT} ({_NEAR}) where pxmin <= xmin and pymin <= ymin and pxmax >= xmax and pymax >= ymax")
add("match_window", _match(mu.Intersects(), mu.WithinWindow(-1e7, 5e6)), f"{_OUT} ({_CAND}) where off between -10000000 and 5000000")
add("match_synchronous", _match(mu.Intersects(), mu.Synchronous(86400.0)), f"{_OUT} (select pid, sid, off from ({_CAND.replace('select p.id pid', 'select p.start_time pst, p.end_time pet, p.id pid')}) where pst - interval 1 day <= end_time and pet + interval 1 day >= start_time)")
_IOU = "(greatest(least(pxmax, xmax) - greatest(pxmin, xmin), 0) * greatest(least(pymax, ymax) - greatest(pymin, ymin), 0))"
add("match_iou", _match(mu.IouAtLeast(0.25), mu.WithinWindow(-3e7, 3e7)), f"{_OUT} ({_CAND}) where off between -30000000 and 30000000 and {_IOU} / ((pxmax - pxmin) * (pymax - pymin) + (xmax - xmin) * (ymax - ymin) - {_IOU}) >= 0.25e0")
add("match_centroid", _match(mu.CentroidWithin(0.0), mu.WithinWindow(-3e7, 3e7)), f"{_OUT} ({_CAND}) where off between -30000000 and 30000000 and (xmin + xmax) / 2 > pxmin and (xmin + xmax) / 2 < pxmax and (ymin + ymax) / 2 > pymin and (ymin + ymax) / 2 < pymax")


def _roles(s, d):
    b = cat_b(s, d)
    return {"x": b.where("id % 2 = 0"), "y": b.where("id % 2 = 1")}


def _wide(df):
    """Boxes six degrees larger on each side, so that both roles match somewhere in the smallest tables too."""
    return df.withColumns({c: F.col(c) + (6.0 if c in ("xmax", "ymax") else -6.0) for c in boxes.BOX})


def _two(join):
    return lambda s, d: mu.matchup(_wide(cat(s, d)), _roles(s, d), spatial=mu.Intersects(), temporal=mu.NearestInTime(2e7), join=join).select(F.col("member_ids")[0].alias("p"), F.array_join(F.col("member_ids").cast("array<string>"), ",").alias("ids"))


_WIDE = _CAND.replace(f"from {CAT} p", f"from (select * replace (xmin - 6 as xmin, ymin - 6 as ymin, xmax + 6 as xmax, ymax + 6 as ymax) from {CAT}) p")
_ROLE = "(select pid, sid from (select *, row_number() over (partition by pid order by abs(off), sid) n from (" + _WIDE + ") where abs(off) <= 20000000 and sid % 2 = {0}) where n = 1)"
add("match_all_roles", _two("all"), f"select x.pid p, x.pid || ',' || x.sid || ',' || y.sid ids from {_ROLE.format(0)} x join {_ROLE.format(1)} y using (pid)")
add("match_any_role", _two("any"), f"select coalesce(x.pid, y.pid) p, concat_ws(',', coalesce(x.pid, y.pid), x.sid, y.sid) ids from {_ROLE.format(0)} x full join {_ROLE.format(1)} y using (pid)")


def _places(spark, sf_dir):
    """Points of which the bundles carry no more than is read."""
    return pts(spark, sf_dir).select("id", "px", "py")


add("join_radius", lambda s, d: joins.radius_join(_places(s, d), _places(s, d), 0.5, shown=tidy).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), F.col("distance").alias("dist")), f"select a.id a, b.id b, round(sqrt(power(a.px - b.px, 2) + power(a.py - b.py, 2)), 6) + 0.0 dist from {PTS} a join {PTS} b on sqrt(power(a.px - b.px, 2) + power(a.py - b.py, 2)) <= 0.5e0")
# in SQL, all of the four nearest are known to lie within 8
add("join_knn", lambda s, d: joins.knn_join(pts(s, d), pts(s, d), 4, 0.5).select(F.col("l.id").alias("a"), "rank", tidy(F.col("distance")).alias("dist")), f"select a, \"rank\", round(dist, 6) + 0.0 dist from (select a.id a, sqrt(power(a.px - b.px, 2) + power(a.py - b.py, 2)) dist, row_number() over (partition by a.id order by sqrt(power(a.px - b.px, 2) + power(a.py - b.py, 2)), b.id)::int \"rank\" from {PTS} a join {PTS} b on b.px between a.px - 8 and a.px + 8 and b.py between a.py - 8 and a.py + 8) where \"rank\" <= 4")


@query("join_asof", f"with b as (select kind, ts + interval 1 minute ts, value v from {PTS}) select a.id, case when epoch_us(a.ts) - epoch_us(b.ts) <= 3600000000 then round(b.v, 6) + 0.0 end v from {PTS} a asof left join b on a.kind = b.kind and a.ts >= b.ts")
def join_asof(spark, sf_dir):
    """Each event with the latest of its kind that is a minute old at least and an hour at most beyond that."""
    p = pts(spark, sf_dir)
    older = p.select("kind", (F.col("ts") + F.make_dt_interval(mins=F.lit(1))).alias("ts"), "value")
    return joins.asof_join(p.select("id", "kind", "ts"), older, ["kind"], "ts", ["value"], 3600.0).select("id", tidy(F.col("right_value")).alias("v"))


_HAV = "2 * 6371e0 * asin(sqrt(least(power(sin(radians(py - 30) / 2), 2) + cos(radians(30)) * cos(radians(py)) * power(sin(radians(px - 20) / 2), 2), 1)))"
add("join_spherical_cap", lambda s, d: pts(s, d).select("id", boxes.haversine(F.lit(20.0), F.lit(30.0), F.col("px"), F.col("py")).alias("km")).where("km <= 1500").select("id", tidy(F.col("km"), 3).alias("km")), f"select id, round({_HAV}, 3) + 0.0 km from {PTS} where {_HAV} <= 1500")

_ITEM = "'{\"id\":\"s' || o_orderkey || '\",\"bbox\":[' || o_orderkey % 100 || ',1,' || o_orderkey % 100 + 2 || ',3],\"properties\":{\"datetime\":\"2024-01-0' || 1 + o_orderkey % 9 || 'T00:00:00Z\",\"cloud\":' || o_orderkey % 10 || '},\"assets\":{\"data\":{\"href\":\"s3://b/' || o_orderkey || '.tif\"},\"qa\":{\"href\":\"q' || o_orderkey || '\"}}}'"


def _items(spark, sf_dir):
    key = F.col("o_orderkey")
    txt = lambda c: c.cast("string")
    return table(spark, sf_dir, "orders").select(F.concat(F.lit('{"id":"s'), txt(key), F.lit('","bbox":['), txt(key % 100), F.lit(",1,"), txt(key % 100 + 2), F.lit(',3],"properties":{"datetime":"2024-01-0'), txt(key % 9 + 1), F.lit('T00:00:00Z","cloud":'), txt(key % 10), F.lit('},"assets":{"data":{"href":"s3://b/'), txt(key), F.lit('.tif"},"qa":{"href":"q'), txt(key), F.lit('"}}}')).alias("item"))


add("items_from_stac", lambda s, d: items.from_stac_items(_items(s, d), properties=["cloud"]).df, "select 's' || o_orderkey id, 's3://b/' || o_orderkey || '.tif' filepath, (o_orderkey % 100)::double xmin, 1e0 ymin, (o_orderkey % 100 + 2)::double xmax, 3e0 ymax, timestamp '2024-01-01' + to_days(cast(o_orderkey % 9 as integer)) start_time, timestamp '2024-01-01' + to_days(cast(o_orderkey % 9 as integer)) end_time, (o_orderkey % 10)::varchar cloud from orders")
add("items_all_assets", lambda s, d: items.from_stac_items(_items(s, d), asset_key="*").df.select("id", "filepath"), "select 's' || o_orderkey id, unnest(['s3://b/' || o_orderkey || '.tif', 'q' || o_orderkey]) filepath from orders")
add("items_asset_key", lambda s, d: items.from_stac_items(_items(s, d)).df.select("id", items.asset_key_from_url(F.col("filepath")).alias("key")), "select 's' || o_orderkey id, o_orderkey::varchar key from orders")
add("items_to_stac", lambda s, d: items.to_stac_items(Catalog(cat(s, d)), collection="c").select(F.get_json_object("item", "$.id").alias("id"), F.get_json_object("item", "$.bbox[2]").cast("double").alias("xmax"), F.get_json_object("item", "$.assets.data.href").alias("href")), f"select filepath id, xmax, filepath href from {CAT}")
add("items_to_stac_collection", lambda s, d: items.to_stac_collection(Catalog(cat(s, d)), collection="c").select(*[F.get_json_object("collection", f"$.extent.spatial.bbox[0][{k}]").cast("double").alias(n) for k, n in enumerate(boxes.BOX)]), f"select min(xmin) xmin, min(ymin) ymin, max(xmax) xmax, max(ymax) ymax from {CAT}")
add("items_staged_path", lambda s, d: cat(s, d).select("filepath", items.staged_path(F.col("filepath"), "/cache").alias("path")), f"select filepath, '/cache/' || sha256(filepath) || '.tif' path from {CAT}")
add("items_rfc3339", lambda s, d: cat(s, d).select("filepath", items.to_rfc3339(F.col("start_time")).alias("t")), f"select filepath, strftime(start_time, '%Y-%m-%dT%H:%M:%SZ') t from {CAT}")


@query("items_umm", "select o_orderkey id, (o_orderkey % 50)::double xmin, 0e0 ymin, (o_orderkey % 50 + 5)::double xmax, 4e0 ymax, timestamp '2024-01-01' start_time, timestamp '2024-01-02' end_time, (o_orderkey % 100)::double cloud from orders")
def items_umm(spark, sf_dir):
    key = F.col("o_orderkey")
    p = lambda x, y: F.struct(x.cast("double").alias("Longitude"), F.lit(y).cast("double").alias("Latitude"))
    west, east = key % 50, key % 50 + 5
    polygon = F.array(F.struct(F.struct(F.array(p(west, 0), p(east, 0), p(east, 4), p(west, 0)).alias("Points")).alias("Boundary")))
    domain = F.struct(F.struct(F.struct(polygon.alias("GPolygons")).alias("Geometry")).alias("HorizontalSpatialDomain"))
    when = F.struct(F.struct(F.lit("2024-01-01T00:00:00Z").alias("BeginningDateTime"), F.lit("2024-01-02T00:00:00Z").alias("EndingDateTime")).alias("RangeDateTime"))
    extra = F.array(F.struct(F.lit("CLOUD_COVERAGE").alias("Name"), F.array((key % 100).cast("string")).alias("Values")))
    umm = F.to_json(F.struct(domain.alias("SpatialExtent"), when.alias("TemporalExtent"), extra.alias("AdditionalAttributes")))
    df = table(spark, sf_dir, "orders").select(key.alias("id"), umm.alias("umm"))
    u = F.col("umm")
    return df.select("id", *items.granule_box(u), *items.granule_interval(u), items.extract_cloud_cover(u).alias("cloud"))


@query("items_source_rows", "select o_orderkey id, 'b' || o_orderkey filepath, '{\"k\":\"1\"}' properties from orders")
def items_source_rows(spark, sf_dir):
    key = F.col("o_orderkey").cast("string")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), *[F.lit(0.0).alias(c) for c in boxes.BOX], F.col("o_orderdate").alias("start_time"), F.col("o_orderdate").alias("end_time"), F.create_map(F.lit("a"), F.concat(F.lit("a"), key), F.lit("data"), F.concat(F.lit("b"), key)).alias("assets"), F.create_map(F.lit("k"), F.lit("1")).alias("properties"), F.create_map(F.lit("p"), F.lit("2")).alias("provenance"))
    return items.source_row_to_catalog(rows, "data").select("id", "filepath", "properties")


@query("bundle_ingest", "select 'q1' query_id, 't' tag, count(*) n_returned, count(*) n_items, 'q1' stamped from customer")
def bundle_ingest(spark, sf_dir):
    rows = cat_b(spark, sf_dir).select(F.col("id").cast("string").alias("id"), *boxes.BOX, "start_time", "end_time", F.create_map(F.lit("data"), F.col("filepath")).alias("assets"), F.create_map(F.lit("k"), F.lit("v")).alias("properties"), F.create_map(F.lit("via"), F.lit("x")).alias("provenance"))
    b = items.Bundle(items.source_row_to_catalog(rows).limit(0)).ingest(rows, query_id="q1", source="s", collection="c", tag="t")
    log = b.queries.select("query_id", "tag", "n_returned")
    return log.join(b.items.agg(F.count("*").alias("n_items"), F.max(F.get_json_object("provenance", "$.query_id")).alias("stamped")))


# files of the scenes: mean nir and red of each cell, and the scene's number, which the files' names don't tell
_CELLS = f"(select scene, y, x, avg(nir) n, avg(red) r from {PX} group by 1, 2, 3)"


def _rasters(spark, sf_dir):
    from ..checkpoints import scratch
    from ..sources import geotiff

    path = scratch(spark, "rasters")
    cells = px(spark, sf_dir).groupBy("scene", "y", "x").agg(F.avg("nir").alias("n"), F.avg("red").alias("r"))
    bands = F.explode(F.array(*[F.struct(F.lit(k).alias("band"), F.col(c).cast("double").alias("v")) for k, c in ((1, "n"), (2, "r"), (3, "scene"))]))
    geotiff.write(cells.select("scene", "y", "x", bands.alias("b")).select("scene", "b.band", "y", "x", "b.v"), path, (64, 64), by=["scene"], transform=(10.0, 0.0, 500.0, 0.0, -10.0, 4000.0), epsg=32630, tile=16)
    return path


def _by_scene(pixels):
    wide = pixels.where("not isnan(v)").groupBy("filepath", "y", "x").agg(*[F.max(F.when(F.col("band") == k, F.col("v"))).alias(c) for k, c in ((1, "n"), (2, "r"), (3, "scene"))])
    return wide.select(F.col("scene").cast("long").alias("scene"), "y", "x", tidy(F.col("n")).alias("n"), tidy(F.col("r")).alias("r"))


_AS_READ = "scene, y, x, round(n, 6) + 0.0 n, round(r, 6) + 0.0 r"


@query("raster_read_bounds", f"select {_AS_READ} from {_CELLS} where x between 10 and 29 and y between 10 and 29")
def raster_read_bounds(spark, sf_dir):
    from ..sources import geotiff

    return _by_scene(geotiff.read(spark, _rasters(spark, sf_dir), bounds=(600.0, 3700.0, 800.0, 3900.0)))


@query("raster_read_window", f"select {_AS_READ} from {_CELLS} where x between 40 and 63 and y between 5 and 36")
def raster_read_window(spark, sf_dir):
    from ..sources import geotiff

    return _by_scene(geotiff.read(spark, _rasters(spark, sf_dir), window=(5, 40, 32, 99)))


@query("raster_read_tile", f"select {_AS_READ} from {_CELLS} where x between 32 and 63 and y between 0 and 31")
def raster_read_tile(spark, sf_dir):
    from ..sources import geotiff

    return _by_scene(geotiff.read_tile(spark, _rasters(spark, sf_dir), 0, 1, (32, 32)))


@query("raster_catalog", "select count(distinct l_suppkey % 8) n, 500e0 xmin, 3360e0 ymin, 1140e0 xmax, 4000e0 ymax, 3::bigint bands from lineitem")
def raster_catalog(spark, sf_dir):
    from ..sources import geotiff

    rows = geotiff.build_catalog(spark, _rasters(spark, sf_dir)).df
    return rows.agg(F.count("*").alias("n"), *[F.max(c).alias(c) for c in (*boxes.BOX, "bands")])


@query("raster_load_from_catalog", f"select {_AS_READ} from {_CELLS} where x between 0 and 9 and y between 20 and 44")
def raster_load_from_catalog(spark, sf_dir):
    from ..sources import geotiff

    found = geotiff.build_catalog(spark, _rasters(spark, sf_dir))
    return _by_scene(geotiff.load(found, bounds=(500.0, 3550.0, 600.0, 3800.0)))
