"""Display: composites, byte stretches, colour tables, shading and overlays."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clip, valid
from .core import PIXEL, Operator
from .neighbours import gradients
from .normalize import _Scaler


def composite(df: DataFrame, red: str, green: str, blue: str, keys=PIXEL) -> DataFrame:
    """Three bands as r, g, b."""
    return df.select(*keys, F.col(red).alias("r"), F.col(green).alias("g"), F.col(blue).alias("b"))


class Composite(Operator):
    def __init__(self, red: str, green: str, blue: str, keys=PIXEL):
        super().__init__(red=red, green=green, blue=blue, keys=keys)

    def apply(self, df: DataFrame) -> DataFrame:
        return composite(df, **self.params)


class TrueColor(Composite):
    def __init__(self, red: str = "red", green: str = "green", blue: str = "blue"):
        super().__init__(red, green, blue)


class FalseColor(Composite):
    def __init__(self, nir: str = "nir", red: str = "red", green: str = "green"):
        super().__init__(nir, red, green)


class SWIRComposite(Composite):
    def __init__(self, swir2: str = "swir2", nir: str = "nir", red: str = "red"):
        super().__init__(swir2, nir, red)


class StretchToUint8(_Scaler):
    """Percentile stretch to 0..255, truncated; NaN is 0."""

    def __init__(self, v: str = "v", by=("scene",), out: str = "byte", lower: float = 2.0, upper: float = 98.0):
        super().__init__(v, by, out, lower=lower, upper=upper)

    def aggregates(self, v):
        return {"_q": F.percentile(valid(v), F.array(F.lit(self.params["lower"] / 100), F.lit(self.params["upper"] / 100)))}

    def scaled(self, v):
        q = F.col("_q")
        span = F.when(q[1] > q[0], q[1] - q[0]).otherwise(F.lit(1.0))
        return F.when(F.isnan(v) | v.isNull(), 0).otherwise(F.floor(clip((v - q[0]) / span, 0.0, 1.0) * 255)).cast("int")


ToDisplayRange = StretchToUint8


def gamma_correct_display(v: Column, gamma: float = 1.0, top: float | None = None) -> Column:
    """v ** (1 / gamma); integers, of which top is the type's largest, are normalised by it and truncated back."""
    if top is None:
        return F.pow(clip(v, 0.0, 1.0), F.lit(1 / gamma))
    return F.floor(F.pow(v / F.lit(top), F.lit(1 / gamma)) * F.lit(top)).cast("int")


def rgba_from_scalar(v: Column, table: list[tuple], vmin: float, vmax: float, nan_color=(0.0, 0.0, 0.0, 0.0)) -> Column:
    """Colour of a table (a bounded list of r, g, b, a) at the value's place in [vmin, vmax]."""
    lut = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in table])
    place = F.floor(clip((v - F.lit(vmin)) / F.lit((vmax - vmin) or 1.0), 0.0, 1.0) * (len(table) - 1)).cast("int")
    return F.when(F.isnan(v) | v.isNull(), F.array(*[F.lit(float(x)) for x in nan_color])).otherwise(F.element_at(lut, place + 1))


def rgba_from_categories(v: Column, mapping: dict, default=(0.0, 0.0, 0.0, 0.0)) -> Column:
    """Colour of each class; others get the default."""
    color = lambda c: F.array(*[F.lit(float(x)) for x in c])
    out = None
    for k, c in mapping.items():
        out = F.when(v == k, color(c)) if out is None else out.when(v == k, color(c))
    return out.otherwise(color(default))


def hillshade(df: DataFrame, v: str = "v", *, by=(), x_resolution: float = 1.0, y_resolution: float = 1.0, azimuth: float = 315.0, altitude: float = 45.0, z_factor: float = 1.0) -> DataFrame:
    """(by, y, x, shade): 0..255, truncated; a sun at 90 degrees or more lights everything."""
    if altitude >= 90:
        return df.select(*by, "y", "x", F.lit(255).alias("shade"))
    g = gradients(df.withColumn(v, F.col(v) * z_factor), v, by=by, dx=abs(x_resolution), dy=abs(y_resolution))
    # the slope is measured from the vertical
    slope = F.lit(math.pi / 2) - F.atan(F.hypot("gx", "gy"))
    aspect = F.atan2(-F.col("gx"), F.col("gy"))
    sun, high = math.radians(450.0 - azimuth), math.radians(altitude)
    light = F.lit(math.sin(high)) * F.sin(slope) + F.lit(math.cos(high)) * F.cos(slope) * F.cos(F.lit(sun) - aspect)
    return g.select(*by, "y", "x", F.floor(clip(light, 0.0, 1.0) * 255).cast("int").alias("shade"))


def blend_rgba(below: DataFrame, above: DataFrame, keys=PIXEL, alpha: float = 0.6, mode: str = "alpha") -> DataFrame:
    """r, g, b, a (0..1) of two layers joined on their pixels: alpha, multiply or screen."""
    p = below.select(*keys, *[F.col(c).alias(f"_0{c}") for c in "rgba"]).join(above.select(*keys, *[F.col(c).alias(f"_1{c}") for c in "rgba"]), list(keys))
    w = F.col("_1a") * alpha
    mixed = {"alpha": lambda a, b: b, "multiply": lambda a, b: a * b, "screen": lambda a, b: 1 - (1 - a) * (1 - b)}[mode]
    return p.select(*keys, *[(F.col(f"_0{c}") * (1 - w) + mixed(F.col(f"_0{c}"), F.col(f"_1{c}")) * w).alias(c) for c in "rgb"], (w + F.col("_0a") * (1 - w)).alias("a"))


def ensure_rgba(df: DataFrame, keys=PIXEL) -> DataFrame:
    """r, g, b, a of a table with v, or with r, g, b and perhaps a; a is 255 where there is none."""
    c = df.columns
    rgb = [F.col("v").alias(x) for x in "rgb"] if "v" in c and "r" not in c else [F.col(x) for x in "rgb"]
    return df.select(*keys, *rgb, F.col("a") if "a" in c else F.lit(255).alias("a"))


def annotate_points(pixels: DataFrame, points: DataFrame, radius: int = 3, color=(1.0, 1.0, 0.0)) -> DataFrame:
    """Pixels within radius of a point (px, py in pixels) in its colour; the disc's offsets are a fixed list."""
    disc = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if dx * dx + dy * dy <= radius * radius])
    hit = points.select(F.explode(disc).alias("o"), "px", "py").select((F.floor("py") + F.col("o.dy")).alias("y"), (F.floor("px") + F.col("o.dx")).alias("x")).distinct().withColumn("_hit", F.lit(True))
    both = pixels.join(hit, ["y", "x"], "left")
    return both.withColumns({c: F.when(F.col("_hit"), F.lit(k)).otherwise(F.col(c)) for c, k in zip("rgb", color, strict=True)}).drop("_hit")
