"""Scaling by fixed numbers or by statistics of each group (scene, band)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.numeric import clip, percentile, valid
from .core import Operator, expression

NAN = float("nan")


def per_band_stats(df: DataFrame, by: list[str], v: str = "v", percentiles=(1.0, 99.0)) -> DataFrame:
    """(by, mean, std, min, max, p<q>...) without NaN; std is of the population."""
    x = valid(F.col(v))
    return df.groupBy(*by).agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), *[percentile(F.col(v), q / 100).alias(f"p{q:g}") for q in percentiles])


def standard_scale(v, mean, std):
    """(v - mean) / std, a std of 0 counting as 1."""
    std = std if isinstance(std, Column) else F.lit(std)
    return (v - mean) / F.when(std == 0, 1.0).otherwise(std)


def robust_scale(v, median, iqr):
    """(v - median) / iqr, an iqr of 0 counting as 1."""
    return standard_scale(v, median, iqr)


def minmax_scale(v, vmin, vmax, out_range=(0.0, 1.0)):
    """To out_range without clipping; a flat input is divided by 1."""
    lo, hi = out_range
    if not hi > lo:
        raise ValueError("out_range must rise")
    vmin, vmax = (x if isinstance(x, Column) else F.lit(float(x)) for x in (vmin, vmax))
    return (v - vmin) / F.when(vmax == vmin, 1.0).otherwise(vmax - vmin) * F.lit(hi - lo) + F.lit(lo)


def log_scale(v, base=10.0, eps=1e-6):
    """log_base(max(v, 0) + eps)"""
    return F.log(F.greatest(v, F.lit(0.0)) + F.lit(eps)) / F.lit(math.log(base))


def asinh_scale(v, a=1.0):
    """asinh(v / a)"""
    return F.asinh(v / F.lit(a))


def power_scale(v, gamma=0.5):
    """max(v, 0) ** gamma"""
    return F.pow(F.greatest(v, F.lit(0.0)), F.lit(gamma))


LogScale = expression("LogScale", log_scale, v="nir", base=10.0)
AsinhScale = expression("AsinhScale", asinh_scale, v="nir", a=1.0)
PowerScale = expression("PowerScale", power_scale, v="nir", gamma=0.5)
Normalize = expression("Normalize", lambda v, mean=0.0, std=1.0: standard_scale(v, F.lit(mean), std), v="nir", mean=0.0, std=1.0)


class _Scaler(Operator):
    """Statistics of each group by one aggregation, joined back; the aggregate has a row for each group."""

    stats: dict = {}

    def __init__(self, v: str = "v", by=("scene",), out: str | None = None, **params):
        super().__init__(v=v, by=list(by), out=out or v, **params)

    def aggregates(self, v: Column) -> dict[str, Column]:
        raise NotImplementedError

    def scaled(self, v: Column) -> Column:
        raise NotImplementedError

    def fit(self, df: DataFrame) -> DataFrame:
        return df.groupBy(*self.params["by"]).agg(*[c.alias(k) for k, c in self.aggregates(F.col(self.params["v"])).items()])

    def transform(self, df: DataFrame, fitted: DataFrame) -> DataFrame:
        by = self.params["by"]
        both = df.join(fitted, by) if by else df.join(F.broadcast(fitted))
        return both.withColumn(self.params["out"], self.scaled(F.col(self.params["v"]))).drop(*[c for c in fitted.columns if c not in by])

    def apply(self, df: DataFrame) -> DataFrame:
        return self.transform(df, self.fit(df))


class StandardScaler(_Scaler):
    def aggregates(self, v):
        return {"_mean": F.avg(valid(v)), "_std": F.stddev_pop(valid(v))}

    def scaled(self, v):
        return standard_scale(v, F.col("_mean"), F.col("_std"))


class RobustScaler(_Scaler):
    def aggregates(self, v):
        return {"_q": F.percentile(valid(v), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))}

    def scaled(self, v):
        q = F.col("_q")
        return robust_scale(v, q[1], q[2] - q[0])


class MinMaxScaler(_Scaler):
    def __init__(self, v: str = "v", by=("scene",), out: str | None = None, out_range=(0.0, 1.0)):
        super().__init__(v, by, out, out_range=out_range)

    def aggregates(self, v):
        return {"_min": F.min(valid(v)), "_max": F.max(valid(v))}

    def scaled(self, v):
        return minmax_scale(v, F.col("_min"), F.col("_max"), self.params["out_range"])


class ZeroOne(MinMaxScaler):
    pass


class HistogramStretch(_Scaler):
    """Percentile stretch, then into out_range."""

    def __init__(self, v: str = "v", by=("scene",), out: str | None = None, out_range=(0.0, 1.0), lower: float = 2.0, upper: float = 98.0):
        super().__init__(v, by, out, out_range=out_range, lower=lower, upper=upper)

    def aggregates(self, v):
        return {"_q": F.percentile(valid(v), F.array(F.lit(self.params["lower"] / 100), F.lit(self.params["upper"] / 100)))}

    def scaled(self, v):
        q, (lo, hi) = F.col("_q"), self.params["out_range"]
        span = F.when(q[1] > q[0], q[1] - q[0]).otherwise(F.lit(1.0))
        return clip((v - q[0]) / span, 0.0, 1.0) * F.lit(hi - lo) + F.lit(lo)


def percentile_clip(df: DataFrame, v: str = "v", by=("scene",), lower: float = 1.0, upper: float = 99.0) -> DataFrame:
    return HistogramStretch(v, by, lower=lower, upper=upper)(df)


def histogram_match(source: DataFrame, reference: DataFrame, by: list[str], v: str = "v") -> DataFrame:
    """Values of `source` mapped to the reference's at the same quantile, by group; between two of its quantiles linearly.

    Quantile of a value: share of rows up to it.  The reference's distinct values of a group are found by a
    window over the union of both, so no pairs are made.
    """
    def quantiles(df):
        n = df.groupBy(*by, v).agg(F.count("*").alias("c"))
        w = W.partitionBy(*by)
        return n.select(*by, v, (F.sum("c").over(w.orderBy(v)) / F.sum("c").over(w)).alias("q"))

    s = quantiles(source).select(*by, F.col(v).alias("_s"), "q", F.lit(None).cast("double").alias("_r"))
    r = quantiles(reference).select(*by, F.lit(None).cast("double").alias("_s"), "q", F.col(v).alias("_r"))
    # both frames begin at the first row: one that ends at the last would be read anew for every row
    back = W.partitionBy(*by).orderBy("q", F.col("_r").isNull()).rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy(*by).orderBy(F.desc("q"), F.col("_r").isNull().desc()).rowsBetween(W.unboundedPreceding, 0)
    point = F.when(F.col("_r").isNotNull(), F.struct("q", "_r"))
    both = s.unionByName(r).select("*", F.last(point, ignorenulls=True).over(back).alias("_a"), F.last(point, ignorenulls=True).over(ahead).alias("_b"))
    a, b = F.col("_a"), F.col("_b")
    between = F.when(a.isNull(), b["_r"]).when(b.isNull() | (a["q"] == b["q"]), a["_r"]).otherwise(a["_r"] + (b["_r"] - a["_r"]) * (F.col("q") - a["q"]) / (b["q"] - a["q"]))
    lut = both.where("_s is not null").select(*by, F.col("_s").alias(v), between.alias("matched"))
    return source.join(lut, [*by, v])


def clahe_kernel(image, kernel: int = 8, clip_limit: float = 0.01, bins: int = 256):
    """Contrast-limited adaptive equalisation of a 2-D array: clipped tile histograms, blended bilinearly."""
    import numpy as np

    x = np.asarray(image, float)
    ok = np.isfinite(x)
    lo, hi = x[ok].min(), x[ok].max()
    q = np.clip(((x - lo) / (hi - lo if hi > lo else 1) * (bins - 1)), 0, bins - 1)
    q = np.where(ok, q, 0).astype(int)
    h, w = x.shape
    ny, nx = -(-h // kernel), -(-w // kernel)
    maps = np.zeros((ny, nx, bins))
    for i in range(ny):
        for j in range(nx):
            tile = np.s_[i * kernel : (i + 1) * kernel, j * kernel : (j + 1) * kernel]
            c = np.bincount(q[tile][ok[tile]], minlength=bins).astype(float)
            top = max(1.0, clip_limit * c.sum())
            c = np.minimum(c, top) + np.maximum(c - top, 0).sum() / bins
            maps[i, j] = np.cumsum(c) / max(c.sum(), 1)
    y, z = (np.arange(h) + 0.5) / kernel - 0.5, (np.arange(w) + 0.5) / kernel - 0.5
    i0, j0 = np.clip(np.floor(y).astype(int), 0, ny - 1), np.clip(np.floor(z).astype(int), 0, nx - 1)
    i1, j1 = np.minimum(i0 + 1, ny - 1), np.minimum(j0 + 1, nx - 1)
    fy, fz = np.clip(y - i0, 0, 1)[:, None], np.clip(z - j0, 0, 1)[None]
    at = lambda i, j: maps[i[:, None], j[None], q]
    out = (at(i0, j0) * (1 - fz) + at(i0, j1) * fz) * (1 - fy) + (at(i1, j0) * (1 - fz) + at(i1, j1) * fz) * fy
    return np.where(ok, out, np.nan)
