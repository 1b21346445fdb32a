"""Band selection, band mathematics and spectra."""

from __future__ import annotations

import ast
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .core import PIXEL, Operator, expression
from .indices import normalized_difference
from .radiometry import apply_srf, gaussian_srf

_BINARY = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: a.cast("double") / b, ast.Pow: lambda a, b: F.pow(a, b)}
_CALLS = {
    "abs": F.abs, "sqrt": F.sqrt, "log": F.log, "log10": F.log10, "exp": F.exp, "minimum": F.least, "maximum": F.greatest,
    "where": lambda c, a, b: F.when(c.cast("boolean"), a).otherwise(b), "clip": lambda v, a, b: F.least(F.greatest(v, a), b),
}


def evaluate_band_math(text: str, variables: dict[str, Column] | list[str]) -> Column:
    """Compiles + - * / **, signs and the functions of a fixed list over named bands into one column."""
    if not isinstance(variables, dict):
        variables = {v: F.col(v) for v in variables}

    def walk(node: ast.AST) -> Column:
        match node:
            case ast.Expression(body=body):
                return walk(body)
            case ast.Constant(value=bool()):
                pass
            case ast.Constant(value=int() | float() as v):
                return F.lit(float(v))
            case ast.Name(id=name) if name in variables:
                return variables[name]
            case ast.Name(id=name):
                raise ValueError(f"no band {name!r}")
            case ast.UnaryOp(op=ast.USub(), operand=x):
                return -walk(x)
            case ast.UnaryOp(op=ast.UAdd(), operand=x):
                return walk(x)
            case ast.BinOp(left=a, op=op, right=b) if type(op) in _BINARY:
                return _BINARY[type(op)](walk(a), walk(b))
            case ast.Call(func=ast.Name(id=name), args=args, keywords=[]) if name in _CALLS:
                return _CALLS[name](*map(walk, args))
        raise ValueError(f"not allowed in band mathematics: {ast.dump(node)[:60]}")

    return walk(ast.parse(text, mode="eval"))


def band_ratio(numerator, denominator, eps=1e-6):
    """numerator / (denominator + eps)"""
    return numerator / (denominator + F.lit(eps))


BandRatio = expression("BandRatio", band_ratio, numerator="nir", denominator="red")
SpectralND = expression("SpectralND", normalized_difference, a="nir", b="red", eps=1e-6)


class BandMath(Operator):
    def __init__(self, text: str, bands: list[str], out: str = "v"):
        super().__init__(text=text, bands=bands, out=out)

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.params["out"], evaluate_band_math(self.params["text"], self.params["bands"]))


def select_bands(df: DataFrame, bands: list[str], keys=PIXEL) -> DataFrame:
    """The named bands of a wide table, in this order."""
    return df.select(*keys, *bands)


reorder_bands = select_bands


def split_bands(df: DataFrame, bands: list[str], keys=PIXEL) -> dict[str, DataFrame]:
    """A table of one value column for each band."""
    return {b: df.select(*keys, F.col(b).alias("v")) for b in bands}


def to_long(df: DataFrame, bands: list[str], keys=PIXEL) -> DataFrame:
    """Rows (keys, band, v), band by its place in the list."""
    each = F.array(*[F.col(b).cast("double") for b in bands])
    return df.select(*keys, F.posexplode(each).alias("band", "v"))


def to_wide(df: DataFrame, bands: list[str], keys=PIXEL) -> DataFrame:
    """The reverse of to_long() where keys are unique."""
    return df.groupBy(*keys).agg(*[F.max(F.when(F.col("band") == k, F.col("v"))).alias(b) for k, b in enumerate(bands)])


def stack_bands(*cubes: DataFrame, sizes: list[int]) -> DataFrame:
    """Long tables one after another, their bands numbered through; sizes are their numbers of bands."""
    out, base = None, 0
    for df, n in zip(cubes, sizes, strict=True):
        one = df.withColumn("band", F.col("band") + base)
        out = one if out is None else out.unionByName(one)
        base += n
    return out


def spectral_binning(cube: DataFrame, sources: list[float], targets: list[float], width: float, keys: list[str], method: str = "mean") -> DataFrame:
    """(keys, target, v): bands whose wavelength is at most width / 2 from the target's, by mean, median or gaussian weight."""
    rows = [(k, b, math.exp(-0.5 * ((x - c) / (width / 2)) ** 2)) for k, c in enumerate(targets) for b, x in enumerate(sources) if abs(x - c) <= width / 2]
    if empty := set(range(len(targets))) - {r[0] for r in rows}:
        raise ValueError(f"no band in the bins {sorted(empty)}")
    bins = cube.sparkSession.createDataFrame(rows, "target int, band long, w double")
    both = cube.join(F.broadcast(bins), "band").groupBy(*keys, "target")
    how = {"mean": F.avg("v"), "median": F.median("v"), "gaussian": F.sum(F.col("v") * F.col("w")) / F.sum("w")}[method]
    return both.agg(how.alias("v"))


def moving_average(cube: DataFrame, keys: list[str], window: int = 7) -> DataFrame:
    """Mean over `window` neighbouring bands; bands beyond the ends count as zero."""
    half = window // 2
    w = W.partitionBy(*keys).orderBy("band").rowsBetween(-half, window - 1 - half)
    return cube.withColumn("v", F.sum("v").over(w) / F.lit(float(window)))


def savgol_weights(window: int, order: int) -> list[float]:
    """Weights of the least-squares polynomial's value at the window's middle."""
    import numpy as np

    half = window // 2
    a = np.vander(np.arange(-half, half + 1), order + 1, increasing=True)
    return np.linalg.pinv(a)[0].tolist()


def spectral_smoothing(cube: DataFrame, keys: list[str], method: str = "savgol", window: int = 7, polyorder: int = 2) -> DataFrame:
    """savgol, gaussian or moving average along the bands; at the ends savgol and gaussian use the nearest band."""
    if method == "moving_average":
        return moving_average(cube, keys, window)
    half = window // 2
    weights = savgol_weights(window, polyorder) if method == "savgol" else [math.exp(-0.5 * (k / (window / 6)) ** 2) for k in range(-half, half + 1)]
    total = sum(weights)
    w = W.partitionBy(*keys).orderBy("band")
    ends = W.partitionBy(*keys).orderBy("band").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    first, last = F.first("v").over(ends), F.last("v").over(ends)
    at = lambda k: F.coalesce(F.lag("v", -k).over(w), first if k < 0 else last)
    return cube.withColumn("v", sum((at(k) * (x / total) for k, x in zip(range(-half, half + 1), weights, strict=True)), F.lit(0.0)))


def continuum_removal(cube: DataFrame, keys: list[str], method: str = "linear") -> DataFrame:
    """Values divided by the line between the first and last band, or by the upper convex hull; a hull of 0 counts as 1."""
    arr = F.array_sort(F.collect_list(F.struct(F.col("band").cast("double").alias("b"), "v")))
    rows = cube.groupBy(*keys).agg(arr.alias("s"))
    if method == "linear":
        first, last = F.element_at("s", 1), F.element_at("s", -1)
        line = lambda p: first["v"] + (last["v"] - first["v"]) * (p["b"] - first["b"]) / (last["b"] - first["b"])
        out = F.transform("s", lambda p: F.struct(p["b"].cast("long").alias("band"), (p["v"] / F.when(line(p) == 0, 1.0).otherwise(line(p))).alias("v")))
        return rows.select(*keys, F.explode(out).alias("p")).select(*keys, "p.band", "p.v")
    # upper hull: a point's value is the largest of all chords over it
    over = lambda p: F.array_max(F.flatten(F.transform("s", lambda a: F.transform("s", lambda c: F.when((a["b"] <= p["b"]) & (c["b"] >= p["b"]), F.when(a["b"] == c["b"], a["v"]).otherwise(a["v"] + (c["v"] - a["v"]) * (p["b"] - a["b"]) / (c["b"] - a["b"])))))))
    out = F.transform("s", lambda p: F.struct(p["b"].cast("long").alias("band"), (p["v"] / F.when(over(p) == 0, 1.0).otherwise(over(p))).alias("v")))
    return rows.select(*keys, F.explode(out).alias("p")).select(*keys, "p.band", "p.v")


__all__ = ["BandMath", "BandRatio", "SpectralND", "apply_srf", "band_ratio", "continuum_removal", "evaluate_band_math", "gaussian_srf", "moving_average", "reorder_bands", "savgol_weights", "select_bands", "spectral_binning", "spectral_smoothing", "split_bands", "stack_bands", "to_long", "to_wide"]
