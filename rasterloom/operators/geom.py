"""Grids against grids and points: crop, pad, tile, stitch, resample, rasterise, extract."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import wkb
from ..functions.boxes import forward, inverse
from ..functions.numeric import valid
from .joins import knn_join
from .patches import triangular

NAN = float("nan")


def center_offsets(current: tuple[int, int], target: tuple[int, int]) -> tuple[int, int]:
    return (current[0] - target[0]) // 2, (current[1] - target[1]) // 2


def is_north_up(transform) -> bool:
    return transform[1] == 0 and transform[3] == 0


def full_grid(spark, shape: tuple[int, int]) -> DataFrame:
    return spark.range(shape[0] * shape[1]).select(F.floor(F.col("id") / shape[1]).alias("y"), (F.col("id") % shape[1]).alias("x"))


def crop(df: DataFrame, row: int, col: int, height: int, width: int) -> DataFrame:
    """The window's rows, renumbered from 0."""
    inside = df.where(F.col("y").between(row, row + height - 1) & F.col("x").between(col, col + width - 1))
    return inside.withColumn("y", F.col("y") - row).withColumn("x", F.col("x") - col)


def crop_to(df: DataFrame, shape: tuple[int, int], to: tuple[int, int], anchor: str = "center") -> DataFrame:
    if to[0] > shape[0] or to[1] > shape[1]:
        raise ValueError("the target is larger than the input")
    r, c = center_offsets(shape, to) if anchor == "center" else (0, 0)
    return crop(df, r, c, *to)


def crop_to_bounds(df: DataFrame, transform, bounds) -> DataFrame:
    """Offsets and lengths are rounded to whole pixels."""
    a, _, c, _, e, f = transform
    x0, y0, x1, y1 = bounds
    return crop(df, round((y1 - f) / e), round((x0 - c) / a), round((y0 - y1) / e), round((x1 - x0) / a))


def pad_to(df: DataFrame, shape: tuple[int, int], to: tuple[int, int], mode: str = "constant", fill: float = NAN, v: str = "v") -> DataFrame:
    """Centred in a larger grid (an odd pixel goes to the bottom and right): constant, reflect or edge."""
    h, w = shape
    top, left = (max(to[k] - shape[k], 0) // 2 for k in (0, 1))
    big = full_grid(df.sparkSession, (max(to[0], h), max(to[1], w)))
    place = {"constant": lambda p, n: p, "edge": lambda p, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), p)), "reflect": lambda p, n: F.when(p < 0, -p).when(p >= n, 2 * (n - 1) - p).otherwise(p)}[mode]
    big = big.withColumn("_y", place(F.col("y") - top, h)).withColumn("_x", place(F.col("x") - left, w))
    own = df.select(F.col("y").alias("_y"), F.col("x").alias("_x"), F.col(v).alias("v"))
    out = big.join(own, ["_y", "_x"], "left")
    return out.select("y", "x", F.coalesce("v", F.lit(fill)).alias("v") if mode == "constant" else "v")


def tile(df: DataFrame, size: tuple[int, int], stride: tuple[int, int] | None = None, shape: tuple[int, int] | None = None, include_incomplete: bool = True) -> DataFrame:
    """Rows of each tile they are in (ty, tx, and their place r, c in it); with overlaps a row is in several."""
    s = stride or size
    out = df
    for k, (p, t, r) in enumerate((("y", "ty", "r"), ("x", "tx", "c"))):
        lo = F.greatest(F.lit(0), F.ceil((F.col(p) - (size[k] - 1)) / s[k]))
        out = out.withColumn(t, F.explode(F.when(F.floor(F.col(p) / s[k]) >= lo, F.sequence(lo, F.floor(F.col(p) / s[k])))))
        if not include_incomplete:
            out = out.where(F.col(t) * s[k] + size[k] <= shape[k])
        out = out.withColumn(r, F.col(p) - F.col(t) * s[k])
    return out


def stitch(tiles: DataFrame, size: tuple[int, int], blend: str = "average", feather: int = 16, fill: float = NAN, order: str = "k") -> DataFrame:
    """(y, x, v) of tile rows (k, r, c, y, x, v): average, feather, max or first valid value."""
    w = triangular(feather)
    weight = w(F.col("r").cast("double"), size[0]) * w(F.col("c").cast("double"), size[1])
    x = valid(F.col("v"))
    some = F.when(x.isNotNull(), F.struct(order, x.alias("x")))
    out = {"average": F.avg(x), "feather": F.sum(x * weight) / F.sum(F.when(x.isNotNull(), weight)), "max": F.max(x), "first": F.min(some)["x"]}[blend]
    return tiles.groupBy("y", "x").agg(F.coalesce(out, F.lit(fill)).alias("v"))


def spatial_pool(df: DataFrame, factor: int = 2, reduce: str = "mean", by=(), v: str = "v") -> DataFrame:
    """Blocks of factor x factor."""
    how = {"mean": F.avg, "max": F.max, "min": F.min, "sum": F.sum}[reduce]
    return df.groupBy(*by, F.floor(F.col("y") / factor).alias("y"), F.floor(F.col("x") / factor).alias("x")).agg(how(v).alias("v"))


def per_band_reduce(df: DataFrame, reduce: str = "mean", by=("band",), v: str = "v") -> DataFrame:
    how = {"mean": F.avg, "max": F.max, "min": F.min, "sum": F.sum, "std": F.stddev_pop}[reduce]
    return df.groupBy(*by).agg(how(v).alias("v"))


def georeference(df: DataFrame, glt: DataFrame, keys=("y", "x")) -> DataFrame:
    """A lookup table (y, x, row, col) of output cells to input pixels; cells without one are null."""
    own = df.select(F.col("y").alias("row"), F.col("x").alias("col"), "v")
    return glt.join(own, ["row", "col"], "left").select(*keys, "v")


def sample_grid(points: DataFrame, grid: DataFrame, row: Column, col: Column, method: str = "nearest", keep=("id",)) -> DataFrame:
    """Values at fractional pixel places: nearest is the pixel that holds the point, bilinear weighs the four around (by pixel centres); outside is NaN."""
    if method == "nearest":
        p = points.select(*keep, F.floor(row).alias("y"), F.floor(col).alias("x"))
        return p.join(grid.select("y", "x", "v"), ["y", "x"], "left").select(*keep, F.coalesce("v", F.lit(NAN)).alias("v"))
    r, c = row - 0.5, col - 0.5
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    p = points.select(*keep, r.alias("_r"), c.alias("_c"), F.explode(around).alias("o"))
    y, x = F.floor("_r") + F.col("o.i"), F.floor("_c") + F.col("o.j")
    w = (1 - F.abs(F.col("_r") - y)) * (1 - F.abs(F.col("_c") - x))
    p = p.select(*keep, y.alias("y"), x.alias("x"), w.alias("w")).where("w > 0")
    both = p.join(grid.select("y", "x", "v"), ["y", "x"], "left").groupBy(*keep).agg(F.sum(F.col("w") * F.coalesce("v", F.lit(NAN))).alias("v"))
    return both


def raster_to_points(points: DataFrame, grid: DataFrame, transform=(1.0, 0.0, 0.0, 0.0, 1.0, 0.0), method: str = "nearest", x: str = "px", y: str = "py", keep=("id",)) -> DataFrame:
    col, row = inverse(transform, F.col(x), F.col(y))
    return sample_grid(points, grid, row, col, method, keep)


def points_to_raster(points: DataFrame, shape: tuple[int, int], stat: str = "mean", transform=(1.0, 0.0, 0.0, 0.0, 1.0, 0.0), v: str = "value", x: str = "px", y: str = "py") -> DataFrame:
    """Binned mean, median, sum, count, max or min for every cell; the far edge belongs to the last bin; empty cells NaN, for count and sum 0."""
    col, row = inverse(transform, F.col(x), F.col(y))
    edge = lambda p, n: F.when(p == n, n - 1).otherwise(F.floor(p))
    how = {"mean": F.avg, "median": F.median, "sum": F.sum, "count": F.count, "max": F.max, "min": F.min}[stat](F.col(v))
    binned = points.groupBy(edge(row, shape[0]).cast("long").alias("y"), edge(col, shape[1]).cast("long").alias("x")).agg(how.cast("double").alias("v"))
    return full_grid(points.sparkSession, shape).join(binned, ["y", "x"], "left").select("y", "x", F.coalesce("v", F.lit(0.0 if stat in ("count", "sum") else NAN)).alias("v"))


def idw(neighbours: DataFrame, by: list[str], power: float = 2.0, v: str = "v") -> DataFrame:
    """Mean weighted by 1 / max(distance ** power, 1e-12)."""
    w = 1 / F.greatest(F.pow("distance", F.lit(power)), F.lit(1e-12))
    return neighbours.groupBy(*by).agg((F.sum(w * F.col(v)) / F.sum(w)).alias("v"))


def points_to_raster_idw(points: DataFrame, shape: tuple[int, int], k: int = 8, power: float = 2.0, radius: float = 4.0, v: str = "value") -> DataFrame:
    """Each cell's centre from its k nearest points."""
    cells = full_grid(points.sparkSession, shape).select((F.col("y") * shape[1] + F.col("x")).alias("id"), (F.col("x") + 0.5).alias("px"), (F.col("y") + 0.5).alias("py"))
    near = knn_join(cells, points, k, radius).select(F.col("l.id").alias("id"), "distance", F.col(f"r.{v}").alias("v"))
    return idw(near, ["id"], power).select(F.floor(F.col("id") / shape[1]).alias("y"), (F.col("id") % shape[1]).alias("x"), "v")


def vector_to_raster(features: DataFrame, shape: tuple[int, int], agg: str = "mean", v: str = "value", order: str = "id") -> DataFrame:
    """Boxes (xmin ..) in pixels burnt where they hold a cell's centre: mean, sum, max, min, count, first or last by order."""
    span = lambda lo, hi, n: F.sequence(F.greatest(F.lit(0), F.ceil(F.col(lo) - 0.5)).cast("long"), F.least(F.lit(n - 1), F.floor(F.col(hi) - 0.5)).cast("long"))
    fits = (F.ceil(F.col("xmin") - 0.5) <= F.floor(F.col("xmax") - 0.5)) & (F.ceil(F.col("ymin") - 0.5) <= F.floor(F.col("ymax") - 0.5)) & (F.col("xmax") >= 0.5) & (F.col("ymax") >= 0.5) & (F.col("xmin") <= shape[1] - 0.5) & (F.col("ymin") <= shape[0] - 0.5)
    cells = features.where(fits).withColumn("y", F.explode(span("ymin", "ymax", shape[0]))).withColumn("x", F.explode(span("xmin", "xmax", shape[1])))
    c = F.col(v)
    how = {"mean": F.avg(c), "sum": F.sum(c), "max": F.max(c), "min": F.min(c), "count": F.count(c).cast("double"), "first": F.min_by(c, order), "last": F.max_by(c, order)}[agg]
    return full_grid(features.sparkSession, shape).join(cells.groupBy("y", "x").agg(how.alias("v")), ["y", "x"], "left").select("y", "x", F.coalesce("v", F.lit(0.0 if agg == "count" else NAN)).alias("v"))


def polygon_mask(cells: DataFrame, polygon: bytes, transform=(1.0, 0.0, 0.0, 0.0, 1.0, 0.0), inside: bool = True) -> DataFrame:
    """Whether a cell's centre is in a polygon (well-known binary; a parameter, so its size is the plan's)."""
    def run(batches):
        import pyarrow as pa

        rings = wkb.decode(polygon)
        for b in batches:
            m = wkb.inside(rings, b.column("_x").to_numpy(), b.column("_y").to_numpy())
            yield pa.RecordBatch.from_arrays([b.column("y"), b.column("x"), pa.array(m if inside else ~m)], ["y", "x", "mask"])

    px, py = forward(transform, F.col("x") + 0.5, F.col("y") + 0.5)
    return cells.select("y", "x", px.cast("double").alias("_x"), py.cast("double").alias("_y")).mapInArrow(run, f"y {dict(cells.dtypes)['y']}, x {dict(cells.dtypes)['x']}, mask boolean")


def resample(grid: DataFrame, shape: tuple[int, int], to: tuple[int, int], method: str = "bilinear") -> DataFrame:
    """To another shape over the same extent: nearest or bilinear at the new pixels' centres, edges repeated."""
    cells = full_grid(grid.sparkSession, to)
    clamp = lambda p, n: F.greatest(F.lit(0.5), F.least(F.lit(n - 0.5), p))
    r, c = clamp((F.col("y") + 0.5) * shape[0] / to[0], shape[0]), clamp((F.col("x") + 0.5) * shape[1] / to[1], shape[1])
    pts = cells.select((F.col("y") * to[1] + F.col("x")).alias("id"), r.alias("_row"), c.alias("_col"))
    out = sample_grid(pts, grid, F.col("_row"), F.col("_col"), method)
    return out.select(F.floor(F.col("id") / to[1]).alias("y"), (F.col("id") % to[1]).alias("x"), "v")


def reproject(grid: DataFrame, src_transform, dst_transform, to: tuple[int, int], project=None, method: str = "nearest") -> DataFrame:
    """Each destination pixel's centre, by `project` (x, y columns to source coordinates), sampled in the source."""
    cells = full_grid(grid.sparkSession, to)
    x, y = forward(dst_transform, F.col("x") + 0.5, F.col("y") + 0.5)
    if project:
        x, y = project(x, y)
    col, row = inverse(src_transform, x, y)
    pts = cells.select((F.col("y") * to[1] + F.col("x")).alias("id"), row.alias("_row"), col.alias("_col"))
    out = sample_grid(pts, grid, F.col("_row"), F.col("_col"), method)
    return out.select(F.floor(F.col("id") / to[1]).alias("y"), (F.col("id") % to[1]).alias("x"), "v")


def antimeridian_split(df: DataFrame, lon: str = "lon", tolerance: float = 90.0) -> DataFrame:
    """A part number (0, 1) for each column: columns are split at the one jump of longitude beyond the tolerance, parts ordered by mean longitude."""
    w = W.partitionBy("y").orderBy("x")
    jump = df.withColumn("_d", F.abs(F.col(lon) - F.lag(lon).over(w))).groupBy("x").agg(F.max("_d").alias("_d")).where(F.col("_d") > tolerance)
    cut = jump.agg(F.min("x").alias("_cut"), F.count("*").alias("_n")).withColumn("_cut", F.when(F.col("_n") > 1, F.raise_error(F.lit("more than one jump")).cast("long")).otherwise(F.col("_cut")))
    rows = df.join(F.broadcast(cut.select("_cut"))).withColumn("_side", F.coalesce((F.col("x") >= F.col("_cut")).cast("int"), F.lit(0)))
    mean = rows.groupBy("_side").agg(F.avg(lon).alias("_m"))
    rank = mean.withColumn("part", F.row_number().over(W.orderBy("_m")) - 1).select("_side", "part")
    return rows.join(F.broadcast(rank), "_side").drop("_side", "_cut")


def bowtie_correction(grid: DataFrame, shape: tuple[int, int], scan_angle_deg: float) -> DataFrame:
    """Nearest source column centre + (column - centre) cos(angle), the angle linear over the scan."""
    centre = (shape[1] - 1) / 2
    cells = full_grid(grid.sparkSession, shape)
    angle = F.radians((F.col("x") - centre) / max(centre, 1) * scan_angle_deg)
    src = F.rint(centre + (F.col("x") - centre) * F.cos(angle)).cast("long")
    return cells.withColumn("_x", src).join(grid.select("y", F.col("x").alias("_x"), "v"), ["y", "_x"], "left").select("y", "x", "v")


def segment_stitch(segments: DataFrame, height: int, count: int, fill: float = NAN) -> DataFrame:
    """Segments (k, y, x, v) below each other by number, from 0 or 1; missing ones are fill."""
    base = segments.agg(F.min("k").alias("_b"))
    rows = segments.join(F.broadcast(base)).withColumn("_k", F.col("k") - F.when(F.col("_b") >= 1, 1).otherwise(0))
    return rows.select((F.col("_k") * height + F.col("y")).alias("y"), "x", "v").unionByName(_missing(segments, height, count, fill))


def _missing(segments: DataFrame, height: int, count: int, fill: float) -> DataFrame:
    spark = segments.sparkSession
    there = segments.agg(F.collect_set("k").alias("ks"), F.max("x").alias("w"))
    gaps = spark.range(count).join(F.broadcast(there)).withColumn("k", F.col("id") + F.when(F.array_min("ks") >= 1, 1).otherwise(0)).where(~F.array_contains("ks", F.col("k")))
    return gaps.select(F.col("id"), F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("r"), "w").select((F.col("id") * height + F.col("r")).alias("y"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("w").cast("long"))).alias("x"), F.lit(fill).alias("v"))


def parallax_source(x: Column, y: Column, height: float, satellite=(0.0, 42164137.0), radius: float = 6378137.0) -> tuple[Column, Column]:
    """Longitude and latitude (degrees) at which the ray from a geostationary satellite through a point lifted to `height` meets the sphere."""
    lon0, dist = math.radians(satellite[0]), satellite[1]
    lon, lat, r = F.radians(x), F.radians(y), radius + height
    p = (r * F.cos(lat) * F.cos(lon - lon0), r * F.cos(lat) * F.sin(lon - lon0), r * F.sin(lat))
    d = (p[0] - dist, p[1], p[2])
    a = d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
    b, c = 2 * dist * d[0], dist * dist - radius * radius
    t = (-b - F.sqrt(F.when(b * b - 4 * a * c >= 0, b * b - 4 * a * c))) / (2 * a)
    q = (dist + t * d[0], t * d[1], t * d[2])
    return F.degrees(F.atan2(q[1], q[0])) + satellite[0], F.degrees(F.asin(q[2] / radius))


def profile_line(grid: DataFrame, start: tuple[float, float], end: tuple[float, float]) -> DataFrame:
    """(k, v): bilinear samples a pixel apart from start to end (row, column)."""
    n = int(math.ceil(math.hypot(end[0] - start[0], end[1] - start[1]))) + 1
    spark = grid.sparkSession
    f = F.col("id") / float(max(n - 1, 1))
    pts = spark.range(n).select("id", (start[0] + f * (end[0] - start[0]) + 0.5).alias("_r"), (start[1] + f * (end[1] - start[1]) + 0.5).alias("_c"))
    return sample_grid(pts, grid, F.col("_r"), F.col("_c"), "bilinear").withColumnRenamed("id", "k")
