"""Augmentations of pixel tables: seeded by hashes, so the same seed gives the same rows however these are dealt out."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.numeric import normal, uniform
from .numbering import numbered


def between(low: float, high: float, seed: int, *keys: str) -> Column:
    return F.lit(low) + (high - low) * uniform(seed, *keys)


def random_flip(df: DataFrame, shape, horizontal: float = 0.5, vertical: float = 0.5, seed: int = 0, scene: str = "scene") -> DataFrame:
    h, v = uniform(seed, scene) < horizontal, uniform(seed + 1, scene) < vertical
    return df.withColumn("x", F.when(h, shape[1] - 1 - F.col("x")).otherwise(F.col("x"))).withColumn("y", F.when(v, shape[0] - 1 - F.col("y")).otherwise(F.col("y")))


def random_rotate90(df: DataFrame, shape, p: float = 0.75, seed: int = 0, scene: str = "scene") -> DataFrame:
    """Square scenes, by 0 to 3 quarter turns."""
    n = shape[0] - 1
    k = F.when(uniform(seed, scene) < p, 1 + F.floor(uniform(seed + 1, scene) * 3)).otherwise(0)
    y, x = F.col("y"), F.col("x")
    return df.withColumns({"y": F.when(k == 1, n - x).when(k == 2, n - y).when(k == 3, x).otherwise(y), "x": F.when(k == 1, y).when(k == 2, n - x).when(k == 3, n - y).otherwise(x)})


def random_crop(df: DataFrame, shape, size, seed: int = 0, scene: str = "scene") -> DataFrame:
    y0, x0 = (F.floor(uniform(seed + k, scene) * (shape[k] - size[k] + 1)) for k in (0, 1))
    inside = df.withColumn("_y", F.col("y") - y0).withColumn("_x", F.col("x") - x0).where(F.col("_y").between(0, size[0] - 1) & F.col("_x").between(0, size[1] - 1))
    return inside.withColumns({"y": F.col("_y"), "x": F.col("_x")}).drop("_y", "_x")


def random_shift(df: DataFrame, shape, most: int, fill: float, v: str = "v", seed: int = 0, scene: str = "scene") -> DataFrame:
    """By whole pixels; uncovered cells get the fill."""
    dy, dx = (F.floor(uniform(seed + k, scene) * (2 * most + 1)) - most for k in (0, 1))
    moved = df.select(scene, (F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x"), v)
    return df.select(scene, "y", "x").join(moved, [scene, "y", "x"], "left").withColumn(v, F.coalesce(v, F.lit(fill)))


def brightness_jitter(df: DataFrame, factor=(0.9, 1.1), v: str = "v", seed: int = 0, by=("scene",)) -> DataFrame:
    return df.withColumn(v, F.col(v) * between(*factor, seed, *by))


def contrast_jitter(df: DataFrame, factor=(0.9, 1.1), v: str = "v", seed: int = 0, by=("scene",)) -> DataFrame:
    mean = F.avg(v).over(W.partitionBy(*by))
    return df.withColumn(v, mean + between(*factor, seed, *by) * (F.col(v) - mean))


def gaussian_noise(df: DataFrame, sigma: float = 0.01, v: str = "v", seed: int = 0, key=("scene", "y", "x")) -> DataFrame:
    return df.withColumn(v, F.col(v) + sigma * normal(seed, *key))


def speckle_noise(df: DataFrame, sigma: float = 0.05, v: str = "v", seed: int = 0, key=("scene", "y", "x")) -> DataFrame:
    return df.withColumn(v, F.col(v) * (1 + sigma * normal(seed, *key)))


def band_dropout(df: DataFrame, p: float = 0.1, fill: float = 0.0, v: str = "v", seed: int = 0, by=("scene", "band")) -> DataFrame:
    return df.withColumn(v, F.when(uniform(seed, *by) < p, F.lit(fill)).otherwise(F.col(v)))


def band_jitter(df: DataFrame, groups: list[list[int]], seed: int = 0, scene: str = "scene") -> DataFrame:
    """Bands of each group turned by a number of places that depends on the scene."""
    out = F.col("band")
    for g in groups:
        turn = F.floor(uniform(seed, scene, F.lit(g[0])) * len(g))
        lut = F.array(*[F.lit(b) for b in g])
        place = F.array_position(lut, F.col("band").cast("int")) - 1
        out = F.when(F.col("band").isin(g), F.get(lut, ((place + turn) % len(g)).cast("int"))).otherwise(out)
    return df.withColumn("band", out)


def sun_angle_jitter(df: DataFrame, sza: float, delta=(-5.0, 5.0), v: str = "v", seed: int = 0, scene: str = "scene") -> DataFrame:
    return df.withColumn(v, F.col(v) * F.cos(F.radians(sza + between(*delta, seed, scene))) / math.cos(math.radians(sza)))


def atmospheric_haze(df: DataFrame, wavelengths: list[float], intensity=(0.0, 0.05), v: str = "v", seed: int = 0, scene: str = "scene") -> DataFrame:
    """Plus intensity times wavelength ** -4, over the largest; in micrometres or nanometres."""
    nm = [w * 1000 if w < 100 else w for w in wavelengths]
    w = [x**-4 for x in nm]
    lut = F.array(*[F.lit(x / max(w)) for x in w])
    return df.withColumn(v, F.col(v) + between(*intensity, seed, scene) * F.get(lut, F.col("band").cast("int")))


def cut_mix(df: DataFrame, donors: DataFrame, shape, p: float = 0.5, v: str = "v", seed: int = 0, scene: str = "scene") -> DataFrame:
    """A random rectangle from a donor scene (donors have the column donor and the same cells)."""
    u = lambda k: uniform(seed + k, scene)
    y0, x0 = F.floor(u(1) * shape[0]), F.floor(u(2) * shape[1])
    inside = (u(0) < p) & F.col("y").between(y0, y0 + F.floor(u(3) * shape[0])) & F.col("x").between(x0, x0 + F.floor(u(4) * shape[1]))
    each = numbered(donors.select("donor").distinct(), ["donor"], "_k")
    n = each.agg(F.max("_k").alias("_n"))
    pick = df.select(scene).distinct().join(F.broadcast(n)).withColumn("_k", F.floor(uniform(seed + 5, scene) * F.col("_n")).cast("long") + 1)
    pick = pick.join(each, "_k").select(scene, "donor")
    both = df.join(pick, scene).join(donors.select("donor", "y", "x", F.col(v).alias("_d")), ["donor", "y", "x"], "left")
    return both.withColumn(v, F.when(inside & F.col("_d").isNotNull(), F.col("_d")).otherwise(F.col(v))).drop("_d", "donor")
