"""Composites over time and fusion of sources, per cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clip, valid
from .indices import ndvi

CELL = ("y", "x")


def median_composite(df: DataFrame, v: str = "v", by=CELL, nan_policy: str = "ignore") -> DataFrame:
    """(by, v, n): median of the frames' valid values and their number; "propagate": NaN if any is."""
    x = valid(F.col(v))
    m = F.median(x)
    out = F.when(F.count(x) < F.count("*"), F.lit(float("nan"))).otherwise(m) if nan_policy == "propagate" else F.coalesce(m, F.lit(float("nan")))
    return df.groupBy(*by).agg(out.alias("v"), F.count(x).alias("n"))


def max_ndvi_composite(df: DataFrame, bands: list[str], red: str = "red", nir: str = "nir", order=("t",), by=CELL) -> DataFrame:
    """The bands of the frame with the largest NDVI; of equal ones the first by `order`; invalid ones come last."""
    score = ndvi(F.col(nir), F.col(red))
    key = F.struct(F.coalesce(-valid(score), F.lit(float("inf"))).alias("s"), *order, *bands)
    best = df.groupBy(*by).agg(F.min_by(F.struct(*bands, score.alias("ndvi"), *[F.col(o).alias(f"_{o}") for o in order]), key).alias("_b"))
    return best.select(*by, *[F.col(f"_b.{b}") for b in bands], F.col("_b.ndvi"), *[F.col(f"_b._{o}").alias(o) for o in order])


def cloud_free_composite(df: DataFrame, clear: Column, v: str = "v", by=CELL, min_valid: int = 1) -> DataFrame:
    """Mean of the clear valid frames, NaN where there are fewer than min_valid."""
    x = F.when(clear, valid(F.col(v)))
    return df.groupBy(*by).agg(F.when(F.count(x) >= min_valid, F.avg(x)).otherwise(F.lit(float("nan"))).alias("v"), F.count(x).alias("n"))


def bap_composite(df: DataFrame, bands: list[str], *, view: Column, day: Column, target: int, cloud_distance: Column, opacity: Column, weights=(0.3, 0.4, 0.2, 0.1), order=("t",), by=CELL) -> DataFrame:
    """The best pixel by a score of view angle, day of year, distance to clouds (over the largest) and opacity; the first of equal ones."""
    top = df.agg(F.max(cloud_distance).alias("_top"))
    rows = df.withColumn("_cd", cloud_distance).join(F.broadcast(top))
    w = weights
    score = w[0] / (1 + F.abs(view)) + w[1] / (1 + F.abs(day - target)) + w[2] * F.coalesce(F.try_divide(F.col("_cd"), F.col("_top")), F.lit(0.0)) + w[3] * (1 - clip(opacity, 0.0, 1.0))
    rows = rows.withColumn("_s", score)
    best = rows.groupBy(*by).agg(F.min_by(F.struct(*bands, F.col("_s").alias("score")), F.struct(-F.col("_s"), *order, *bands)).alias("_b"))
    return best.select(*by, *[F.col(f"_b.{b}") for b in bands], F.col("_b.score"))


def min_cloud_composite(df: DataFrame, clear: str, v: str = "v", scene: str = "scene", by=CELL) -> DataFrame:
    """The clear value of the scene with the fewest clouds; where all are cloudy that of the clearest scene. Of equal scenes the first."""
    # rows are first counted by cell, scene and cloud in fixed-size buffers; only these few are ordered
    c = F.col("_c")
    rows = df.groupBy(*by, scene, (~F.col(clear)).alias("_c")).agg(F.when(F.count(v) == F.count("*"), F.min(v)).alias("_v"), F.count("*").alias("_n"))
    share = rows.groupBy(scene).agg(F.try_divide(F.sum(F.when(c, F.col("_n")).otherwise(0)), F.sum(F.when(c.isNotNull(), F.col("_n")))).alias("_f"))
    key = F.struct(c, "_f", scene, "_v")
    return rows.join(share, scene).groupBy(*by).agg(F.min_by("_v", key).alias("v"), F.sum(F.when(~c, F.col("_n")).otherwise(0)).alias("n"))


def blend_matched(df: DataFrame, method: str = "mean", v: str = "v", weight: Column | None = None, variance: Column | None = None, by=CELL, nan_policy: str = "ignore") -> DataFrame:
    """Over sources: mean, weighted (weight) or inverse_variance (variance); NaN where the weights sum to 0 or less."""
    x = valid(F.col(v))
    w = {"mean": F.lit(1.0), "weighted": weight, "inverse_variance": 1 / variance if variance is not None else None}[method]
    den = F.sum(F.when(x.isNotNull(), w))
    out = F.when(den > 0, F.sum(x * w) / den).otherwise(F.lit(float("nan")))
    if nan_policy == "propagate":
        out = F.when(F.count(x) < F.count("*"), F.lit(float("nan"))).otherwise(out)
    return df.groupBy(*by).agg(out.alias("v"))


def mosaic(df: DataFrame, method: str = "first", v: str = "v", order: str = "k", by=CELL, fill: float | None = None) -> DataFrame:
    """Aligned tiles on a common grid: first or last by `order`, mean, median, max or min of valid values; fill where there is none."""
    x = valid(F.col(v)) if fill is None or fill != fill else F.when(F.col(v) != fill, valid(F.col(v)))
    some = F.when(x.isNotNull(), F.struct(order, x.alias("x")))
    out = {"first": F.min(some)["x"], "last": F.max(some)["x"], "mean": F.avg(x), "median": F.median(x), "max": F.max(x), "min": F.min(x)}[method]
    return df.groupBy(*by).agg(F.coalesce(out, F.lit(float("nan") if fill is None else fill)).alias("v"))


def daily_mosaic(df: DataFrame, method: str = "first", v: str = "v", t: str = "t", order: str = "k", by=CELL) -> DataFrame:
    """One mosaic for each day."""
    return mosaic(df.withColumn("day", F.to_date(t)), method, v, order, ("day", *by))
