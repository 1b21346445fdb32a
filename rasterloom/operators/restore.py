"""Restoring grids: outliers, gaps, stripes and speckle (see also neighbours)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import valid
from .neighbours import (  # noqa: F401
    adaptive_background,
    despeckle_frost,
    despeckle_lee,
    destripe,
    gap_fill_idw,
    gap_fill_nearest,
    gaussian_denoise,
    median_denoise,
)

#: Of a normal distribution's deviation to its median absolute deviation.
MAD_SCALE = 1.4826


def outlier_mask(df: DataFrame, method: str = "mad", k: float = 3.0, v: str = "v") -> DataFrame:
    """`outlier`: |v - centre| > k * scale, by median and MAD or by mean and population deviation; with no scale whatever differs."""
    x = valid(F.col(v))
    if method == "mad":
        centre = df.agg(F.median(x).alias("_c"))
        stats = df.join(F.broadcast(centre)).agg(F.first("_c").alias("_c"), (F.median(F.abs(x - F.col("_c"))) * MAD_SCALE).alias("_s"))
    elif method == "zscore":
        stats = df.agg(F.avg(x).alias("_c"), F.stddev_pop(x).alias("_s"))
    else:
        raise ValueError("method is mad or zscore")
    far = F.when(F.col("_s") == 0, x != F.col("_c")).otherwise(F.abs(x - F.col("_c")) > k * F.col("_s"))
    return df.join(F.broadcast(stats)).withColumn("outlier", F.coalesce(far, F.lit(False))).drop("_c", "_s")


def replace_outliers(df: DataFrame, method: str = "mad", k: float = 3.0, fill: str = "median", v: str = "v", by=()) -> DataFrame:
    """Outliers become the others' median, NaN or the nearest other cell's value."""
    marked = outlier_mask(df, method, k, v)
    if fill == "median":
        m = marked.where("not outlier").agg(F.median(valid(F.col(v))).alias("_m"))
        return marked.join(F.broadcast(m)).withColumn(v, F.when(F.col("outlier"), F.col("_m")).otherwise(F.col(v))).drop("_m", "outlier")
    gone = marked.withColumn(v, F.when(F.col("outlier"), F.lit(float("nan"))).otherwise(F.col(v))).drop("outlier")
    return gone if fill == "nan" else gap_fill_nearest(gone, v, by)


def saturation_flag(v, threshold: float = 1.0):
    """v >= threshold."""
    return v >= F.lit(threshold)
