"""Connected regions: labels, their measures, plumes and instances."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..checkpoints import stash
from ..functions.numeric import percentile, valid
from .components import components
from .neighbours import offsets
from .numbering import numbered

#: Cells of a scene's row in a cell's number.
_WIDE = 1 << 31
FOUR = ((0, 1), (1, 0))
EIGHT = ((0, 1), (1, 0), (1, 1), (1, -1))


def label_components(df: DataFrame, mask: Column, connectivity: int = 1, min_area: int = 1) -> DataFrame:
    """(y, x, label) of the cells under the mask: regions of at least min_area cells, numbered from 1 by their first cell in row order.

    connectivity 1 joins four neighbours, 2 eight.
    """
    cells = df.where(mask).select((F.col("y") * _WIDE + F.col("x")).alias("id"), "y", "x")
    cells = stash(cells, "cells")
    near = offsets(cells, list(FOUR if connectivity == 1 else EIGHT), "id").select("y", "x", F.col("v").alias("b"))
    links = cells.join(near, ["y", "x"]).select(F.col("id").alias("a"), "b")
    comp = components(links)
    rows = cells.join(comp, cells.id == comp.node, "left").select("y", "x", F.coalesce("component", "id").alias("root"))
    size = rows.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") >= min_area)
    number = numbered(size.select("root"), ["root"]).withColumn("label", F.col("label").cast("int"))
    return rows.join(number, "root").select("y", "x", "label")


def remove_small_objects(df: DataFrame, mask: Column, min_size: int) -> DataFrame:
    """(y, x, mask): four-connected objects of fewer cells go."""
    kept = label_components(df, mask, 1, min_size).select("y", "x", F.lit(True).alias("_k"))
    return df.select("y", "x").join(kept, ["y", "x"], "left").select("y", "x", F.coalesce("_k", F.lit(False)).alias("mask"))


def remove_small_holes(df: DataFrame, mask: Column, area: int, shape: tuple[int, int]) -> DataFrame:
    """(y, x, mask): holes of at most `area` cells that do not touch the border are filled."""
    labels = label_components(df, ~mask, 1)
    edge = (F.col("y") == 0) | (F.col("x") == 0) | (F.col("y") == shape[0] - 1) | (F.col("x") == shape[1] - 1)
    fill = labels.groupBy("label").agg(F.count("*").alias("n"), F.bool_or(edge).alias("edge")).where((F.col("n") <= area) & ~F.col("edge")).select("label")
    holes = labels.join(fill, "label", "left_semi").select("y", "x", F.lit(True).alias("_h"))
    return df.select("y", "x", mask.alias("_m")).join(holes, ["y", "x"], "left").select("y", "x", (F.col("_m") | F.coalesce("_h", F.lit(False))).alias("mask"))


def region_props(labels: DataFrame, intensity: DataFrame | None = None, by=()) -> DataFrame:
    """Area, box (half-open), centroid, second moments, orientation, axis lengths and, with `intensity` (y, x, v), its mean, min and max."""
    rows = labels if intensity is None else labels.join(intensity.select("y", "x", "v"), ["y", "x"])
    y, x = F.col("y").cast("double"), F.col("x").cast("double")
    more = [] if intensity is None else [F.avg("v").alias("mean_intensity"), F.min("v").alias("min_intensity"), F.max("v").alias("max_intensity")]
    out = rows.groupBy(*by, "label").agg(F.count("*").alias("area"), F.min("y").alias("min_y"), F.min("x").alias("min_x"), (F.max("y") + 1).alias("max_y"), (F.max("x") + 1).alias("max_x"), F.avg(y).alias("cy"), F.avg(x).alias("cx"), F.var_pop(y).alias("myy"), F.var_pop(x).alias("mxx"), F.covar_pop(y, x).alias("mxy"), *more)
    a, b, c = F.col("mxx") + 1 / 12, F.col("mxy"), F.col("myy") + 1 / 12
    root = F.sqrt(4 * b * b + (a - c) * (a - c))
    return out.withColumns({"major": 4 * F.sqrt((a + c + root) / 2), "minor": 4 * F.sqrt(F.greatest((a + c - root) / 2, F.lit(0.0))), "orientation": 0.5 * F.atan2(2 * b, c - a)})


def shannon_entropy(df: DataFrame, v: str = "v", base: float = 2.0) -> DataFrame:
    """One row: -sum p log p over the values' shares."""
    n = df.groupBy(v).agg(F.count("*").alias("n"))
    share = n.join(F.broadcast(n.agg(F.sum("n").alias("all")))).select((F.col("n") / F.col("all")).alias("p"))
    return share.agg((-F.sum(F.col("p") * F.log("p")) / math.log(base)).alias("entropy"))


# thresholds and plumes ----------------------------------------------------------------------------------------------------


def otsu_threshold(df: DataFrame, v: str = "v", bins: int = 256) -> DataFrame:
    """One row `threshold`: the centre of the first of the best of `bins` equal bins; a constant is its own threshold."""
    x = valid(F.col(v))
    ends = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    rows = df.select(x.alias("v")).where("v is not null").join(F.broadcast(ends))
    k = F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0) * bins))
    hist = rows.groupBy(k.alias("k"), "lo", "hi").agg(F.count("*").alias("n"))
    centre = F.col("lo") + (F.col("k") + 0.5) * (F.col("hi") - F.col("lo")) / bins
    up, rest = W.orderBy("k").rowsBetween(W.unboundedPreceding, 0), W.orderBy("k").rowsBetween(1, W.unboundedFollowing)
    h = hist.withColumn("c", centre).withColumns({"w0": F.sum("n").over(up), "s0": F.sum(F.col("n") * F.col("c")).over(up), "w1": F.coalesce(F.sum("n").over(rest), F.lit(0)), "s1": F.coalesce(F.sum(F.col("n") * F.col("c")).over(rest), F.lit(0.0))})
    between = F.when(F.col("w1") > 0, F.col("w0") * F.col("w1") * F.pow(F.col("s0") / F.col("w0") - F.col("s1") / F.col("w1"), F.lit(2))).otherwise(F.lit(-1.0))
    best = h.withColumn("b", between).agg(F.min_by("c", F.struct(-F.round("b", 9), "k")).alias("t"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return best.select(F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("t")).alias("threshold"))


def resolve_threshold(df: DataFrame, threshold, v: str = "v") -> DataFrame:
    """One row: a number, "otsu" or "percentile:p"."""
    if threshold == "otsu":
        return otsu_threshold(df, v)
    if isinstance(threshold, str):
        kind, _, p = threshold.partition(":")
        if kind != "percentile":
            raise ValueError("threshold is a number, otsu or percentile:p")
        return df.agg(percentile(F.col(v), float(p) / 100).alias("threshold"))
    return df.sparkSession.createDataFrame([(float(threshold),)], "threshold double")


def plume_labels(df: DataFrame, threshold="otsu", min_area: int = 50, connectivity: int = 8, v: str = "v") -> DataFrame:
    """(y, x, label) above the threshold, without regions of fewer than min_area cells."""
    over = df.join(F.broadcast(resolve_threshold(df, threshold, v)))
    return label_components(over, F.col(v) > F.col("threshold"), 1 if connectivity == 4 else 2, min_area)


def plume_mask(df: DataFrame, threshold="otsu", min_area: int = 50, connectivity: int = 8, v: str = "v") -> DataFrame:
    found = plume_labels(df, threshold, min_area, connectivity, v).select("y", "x", F.lit(True).alias("_p"))
    return df.select("y", "x").join(found, ["y", "x"], "left").select("y", "x", F.coalesce("_p", F.lit(False)).alias("mask"))


def pixel_centres(affine) -> tuple[Column, Column]:
    a, b, c, d, e, f = affine
    x, y = F.col("x") + 0.5, F.col("y") + 0.5
    return a * x + b * y + c, d * x + e * y + f


def wind_cone(source: tuple[float, float], wind: tuple[float, float], half_angle: float = 30.0, far: float = 5000.0, affine=(1.0, 0.0, 0.0, 0.0, 1.0, 0.0)) -> Column:
    """Whether a cell's centre lies downwind of the source, within an angle and a distance."""
    px, py = pixel_centres(affine)
    dx, dy = px - source[0], py - source[1]
    speed = math.hypot(*wind)
    along, d = (dx * wind[0] + dy * wind[1]) / speed, F.hypot(dx, dy)
    return (along >= 0) & (d <= far) & (along >= d * math.cos(math.radians(half_angle)))


# Kg and m3 of a mole.
MOLAR_KG = {"CH4": 0.01604, "CO2": 0.04401}
MOLAR_M3 = 0.024465


def convert_column_units(v: Column, gas: str = "CH4", units_in: str = "ppm_m", units_out: str = "kg_m2") -> Column:
    """Between ppm_m, mol_m2 and kg_m2."""
    to_mol = {"ppm_m": 1e-6 / MOLAR_M3, "mol_m2": 1.0, "kg_m2": 1 / MOLAR_KG[gas]}
    return v * F.lit(to_mol[units_in] / to_mol[units_out])


def _hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Corners of the convex hull, by two monotone chains."""
    points = sorted(set(points))
    if len(points) < 3:
        return points

    def chain(ps):
        out: list[tuple[float, float]] = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return chain(points) + chain(points[::-1])


def plume_length(cells: DataFrame, pixel: float = 1.0) -> DataFrame:
    """One row `length`: the largest distance between cells of the mask; of one cell the root of its area.

    The farthest cells are corners of the convex hull.  Of the rows' ends each partition leaves its hull's corners, of
    which a field of n cells a side has some n ** (2/3) at most, and these are compared.
    """

    def run(batches):
        import pyarrow as pa

        corners: list[tuple[float, float]] = []
        for b in batches:
            y, lo, hi = (b.column(c).to_pylist() for c in ("y", "lo", "hi"))
            corners = _hull([*corners, *zip(y, lo, strict=True), *zip(y, hi, strict=True)])
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in corners], pa.float64()), pa.array([p[1] for p in corners], pa.float64())], ["y", "x"])

    ends = cells.groupBy("y").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).select(*[F.col(c).cast("double").alias(c) for c in ("y", "lo", "hi")])
    corners = ends.mapInArrow(run, "y double, x double")
    corners = corners.coalesce(1).select("y", F.col("x").alias("lo"), F.col("x").alias("hi")).mapInArrow(run, "y double, x double")
    all_ = corners.agg(F.collect_list(F.struct("y", "x")).alias("e"))
    far = all_.select(F.array_max(F.transform("e", lambda a: F.array_max(F.transform("e", lambda b: F.hypot(a["y"] - b["y"], a["x"] - b["x"]))))).alias("d"))
    return far.select((F.coalesce("d", F.lit(0.0)) * pixel).alias("length")).select(F.when(F.col("length") > 0, F.col("length")).otherwise(F.lit(pixel)).alias("length"))


def ime_estimate(df: DataFrame, mask: Column, wind_speed: float, pixel_area: float = 1.0, uncertainty: float = 0.3, v: str = "v") -> DataFrame:
    """One row: ime (sum of enhancement x area), length, flux = ime * wind / length, and its uncertainty."""
    cells = df.where(mask)
    ime = cells.agg(F.coalesce(F.sum(valid(F.col(v)) * pixel_area), F.lit(0.0)).alias("ime"))
    both = ime.join(F.broadcast(plume_length(cells, math.sqrt(pixel_area))))
    return both.select("ime", "length", (F.col("ime") * wind_speed / F.col("length")).alias("flux"), (F.col("ime") * wind_speed / F.col("length") * uncertainty).alias("flux_uncertainty"))


def cross_sectional_flux(df: DataFrame, mask: Column, source: tuple[float, float], wind: tuple[float, float], transects: int = 5, spacing: float = 100.0, pixel_area: float = 1.0, affine=(1.0, 0.0, 0.0, 0.0, 1.0, 0.0), v: str = "v") -> DataFrame:
    """(transect, flux): for transects at spacing, 2 spacing .. downwind, sum of v * wind * pixel width over cells within half a pixel."""
    px, py = pixel_centres(affine)
    speed, width = math.hypot(*wind), math.sqrt(pixel_area)
    along = ((px - source[0]) * wind[0] + (py - source[1]) * wind[1]) / speed
    k = F.explode(F.sequence(F.lit(1), F.lit(transects)))
    rows = df.where(mask).select(along.alias("a"), valid(F.col(v)).alias("v"), k.alias("transect")).where(F.abs(F.col("a") - F.col("transect") * spacing) <= width / 2)
    return rows.groupBy("transect").agg((F.sum("v") * speed * width).alias("flux"))


def plume_column_stats(labels: DataFrame, df: DataFrame, v: str = "v") -> DataFrame:
    """For each label the mean inside, mean and deviation of all other cells, contrast and z-score; from sums, so cells are not paired."""
    rows = df.select("y", "x", valid(F.col(v)).alias("v")).join(labels, ["y", "x"], "left")
    whole = rows.agg(F.count("v").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    one = rows.where("label is not null").groupBy("label").agg(F.count("v").alias("k"), F.sum("v").alias("a"), F.sum(F.col("v") * F.col("v")).alias("b"))
    n = F.col("n") - F.col("k")
    mean = (F.col("s") - F.col("a")) / n
    std = F.sqrt(F.greatest((F.col("q") - F.col("b")) / n - mean * mean, F.lit(0.0)))
    inside = F.col("a") / F.col("k")
    return one.join(F.broadcast(whole)).select("label", inside.alias("mean_in"), mean.alias("mean_out"), std.alias("std_out"), (inside - mean).alias("contrast"), F.try_divide(inside - mean, std).alias("zscore"))


def sbmp(df: DataFrame, swir1: str, swir2: str, reference: DataFrame | None = None, eps: float = 1e-10) -> DataFrame:
    """ln((swir2 + eps) / (swir1 + eps)) minus the reference scene's, or without one the normalised difference."""
    a, b = F.col(swir1), F.col(swir2)
    if reference is None:
        return df.select("y", "x", ((b - a) / (b + a + eps)).alias("v"))
    ratio = F.log((b + eps) / (a + eps))
    return df.select("y", "x", ratio.alias("_a")).join(reference.select("y", "x", ratio.alias("_b")), ["y", "x"]).select("y", "x", (F.col("_a") - F.col("_b")).alias("v"))


# instances ------------------------------------------------------------------------------------------------------------------


def merge_nearby_instances(labels: DataFrame, distance: float = 40.0, low: float = 0.01, high: float = 0.65) -> DataFrame:
    """Labels whose boxes are nearer than a distance and overlap with low < IoU < high become one, numbered in label order."""
    box = labels.groupBy("label").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"))
    from .joins import box_join

    flat = box.select("label", F.col("x0").cast("double").alias("xmin"), F.col("y0").cast("double").alias("ymin"), F.col("x1").cast("double").alias("xmax"), F.col("y1").cast("double").alias("ymax"))
    from ..functions import boxes as bx

    pairs = box_join(flat, flat, cell=32.0).where("l.label < r.label")
    iou = bx.iou(bx.box("l."), bx.box("r."))
    links = pairs.where((iou > low) & (iou < high)).select(F.col("l.label").alias("a"), F.col("r.label").alias("b"))
    comp = components(links)
    root = box.select("label").join(comp, box.label == comp.node, "left").select("label", F.coalesce("component", "label").alias("root"))
    number = numbered(root.select("root").distinct(), ["root"], "merged")
    return labels.join(root.join(number, "root").select("label", "merged"), "label").select("y", "x", F.col("merged").alias("label"))


def mask_nms(masks: DataFrame, scores: DataFrame | None = None, threshold: float = 0.1) -> DataFrame:
    """Greedy suppression of masks (id, y, x) by score (or area, largest first, ties by id); survivors' cells (y, x, label), the better one first.

    Overlaps are counted by joining masks on their cells; the greedy choice is a fold over the pairs that overlap too much.
    """
    area = masks.groupBy("id").agg(F.count("*").alias("area"))
    rank = (area if scores is None else area.join(scores, "id")).select("id", "area", (F.col("area").cast("double") if scores is None else F.col("score")).alias("s"))
    rank = stash(numbered(rank, [F.desc("s"), F.col("id")], "rank"), "rank")
    a = masks.join(rank, "id").select("y", "x", F.col("rank").alias("ra"), F.col("area").alias("na"))
    b = masks.join(rank, "id").select("y", "x", F.col("rank").alias("rb"), F.col("area").alias("nb"))
    hits = a.join(b, ["y", "x"]).where("ra < rb").groupBy("ra", "rb", "na", "nb").agg(F.count("*").alias("n")).where(F.col("n") / (F.col("na") + F.col("nb") - F.col("n")) > threshold).select("ra", "rb")
    hits = stash(hits, "hits")
    # a mask is out if a survivor hits it; in rounds: those that nobody undecided hits survive
    out, kept, left = None, None, rank.select("rank")
    while True:
        attacked = hits.join(left.withColumnRenamed("rank", "ra"), "ra").join(left.withColumnRenamed("rank", "rb"), "rb").select(F.col("rb").alias("rank")).distinct()
        safe = stash(left.join(attacked, "rank", "left_anti"), "safe")
        kept = safe if kept is None else kept.unionAll(safe)
        gone = hits.join(safe.withColumnRenamed("rank", "ra"), "ra").select(F.col("rb").alias("rank"))
        left = stash(left.join(safe, "rank", "left_anti").join(gone, "rank", "left_anti"), "left")
        if left.isEmpty():
            break
    number = numbered(kept.select("rank"), ["rank"]).withColumn("label", F.col("label").cast("int"))
    cells = masks.join(rank, "id").join(number, "rank")
    return cells.groupBy("y", "x").agg(F.min("label").alias("label"))
