"""Boolean masks of a grid as operators: made from a place, a height or a geometry, combined, cleaned and applied.

Masks are tables (by, y, x, mask); an operator that makes one takes any table with y and x.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.boxes import forward
from ..functions.numeric import valid
from . import neighbours as nb
from . import regions as rg
from .core import Operator

UNIT = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)


class BBoxMask(Operator):
    """True where a cell's centre lies in a box (xmin, ymin, xmax, ymax) of map units; with inside=False elsewhere."""

    def __init__(self, bounds, transform=UNIT, inside: bool = True, by=()):
        if len(tuple(bounds)) != 4:
            raise ValueError("bounds are xmin, ymin, xmax, ymax")
        super().__init__(bounds=tuple(bounds), transform=tuple(transform), inside=inside)
        self.by = tuple(by)

    def apply(self, df: DataFrame) -> DataFrame:
        x0, y0, x1, y1 = self.params["bounds"]
        x, y = forward(self.params["transform"], F.col("x") + 0.5, F.col("y") + 0.5)
        within = x.between(x0, x1) & y.between(y0, y1)
        return df.select(*self.by, "y", "x", (within if self.params["inside"] else ~within).alias("mask"))


class AltitudeMask(Operator):
    """True where a height (y, x, v) lies from low to high, both inclusive and either open; cells without a height are false."""

    def __init__(self, dem: DataFrame, low: float | None = None, high: float | None = None, v: str = "v", by=()):
        super().__init__(low=low, high=high, v=v)
        self.dem, self.by = dem, tuple(by)

    def apply(self, df: DataFrame) -> DataFrame:
        height = valid(F.col("_height"))
        fits = height.isNotNull()
        if self.params["low"] is not None:
            fits = fits & (height >= self.params["low"])
        if self.params["high"] is not None:
            fits = fits & (height <= self.params["high"])
        dem = self.dem.select("y", "x", F.col(self.params["v"]).alias("_height"))
        return df.select(*self.by, "y", "x").join(dem, ["y", "x"], "left").select(*self.by, "y", "x", F.coalesce(fits, F.lit(False)).alias("mask"))


class InvertMask(Operator):
    """True where the mask is false; null stays."""

    def __init__(self, mask: str = "mask"):
        super().__init__(mask=mask)

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.params["mask"], ~F.col(self.params["mask"]))


class CombineMasks(Operator):
    """Several masks of the same cells by "or", "and" or "xor", or one by "not".

    Called with a list of tables; their rows meet in one aggregation by cell, however many there are.
    """

    WAYS = {"or": F.bool_or, "and": F.bool_and, "xor": lambda m: F.count_if(m) % 2 == 1}

    def __init__(self, op: str = "or", by=(), mask: str = "mask"):
        if op.lower() not in (*self.WAYS, "not"):
            raise ValueError("op is or, and, xor or not")
        super().__init__(op=op.lower(), mask=mask)
        self.by = tuple(by)

    def __call__(self, masks: list[DataFrame]) -> DataFrame:
        return self.apply(masks)

    def apply(self, masks: list[DataFrame]) -> DataFrame:
        name, keys = self.params["mask"], [*self.by, "y", "x"]
        if not masks:
            raise ValueError("there are no masks")
        if self.params["op"] == "not":
            if len(masks) > 1:
                raise ValueError("not takes one mask")
            return InvertMask(name)(masks[0].select(*keys, name))
        rows = reduce(DataFrame.unionAll, [m.select(*keys, name) for m in masks])
        return rows.groupBy(*keys).agg(self.WAYS[self.params["op"]](F.col(name)).alias(name))


class CleanMask(Operator):
    """Objects of fewer cells go, holes of at most so many cells that do not touch the border are filled, then the mask is closed."""

    def __init__(self, shape: tuple[int, int], min_object: int = 25, max_hole: int = 25, closing: int = 1):
        if min(min_object, max_hole, closing) < 0:
            raise ValueError("sizes and iterations are not negative")
        super().__init__(shape=tuple(shape), min_object=min_object, max_hole=max_hole, closing=closing)

    def apply(self, df: DataFrame) -> DataFrame:
        p = self.params
        out = rg.remove_small_objects(df, F.col("mask"), p["min_object"])
        out = rg.remove_small_holes(out, F.col("mask"), p["max_hole"], p["shape"])
        return nb.closed(out, "mask", iterations=p["closing"]) if p["closing"] else out


class ApplyMask(Operator):
    """Values become `fill` where the mask is true (with invert: false); the mask is a column, a table or an operator that makes one.

    Cells that the mask does not know stay as they are.
    """

    def __init__(self, mask: Column | DataFrame | Operator, fill: float = float("nan"), invert: bool = False, values=("v",), by=()):
        super().__init__(fill=fill, invert=invert, values=tuple(values))
        self.mask, self.by = mask, tuple(by)

    def apply(self, df: DataFrame) -> DataFrame:
        if isinstance(self.mask, Column):
            both, hit = df, self.mask
        else:
            keys = [*self.by, "y", "x"]
            mask = self.mask(df) if isinstance(self.mask, Operator) else self.mask
            both, hit = df.join(mask.select(*keys, F.col("mask").alias("_mask")), keys, "left"), F.col("_mask")
        gone = F.coalesce(~hit if self.params["invert"] else hit, F.lit(False))
        return both.withColumns({c: F.when(gone, F.lit(self.params["fill"])).otherwise(F.col(c)) for c in self.params["values"]}).select(*df.columns)


class DistanceMask(Operator):
    """True within a distance (map units) of true cells, or with inside=False beyond it."""

    def __init__(self, distance: float, pixel_size=(1.0, 1.0), inside: bool = True, by=()):
        super().__init__(distance=distance, pixel_size=tuple(pixel_size), inside=inside)
        self.by = tuple(by)

    def apply(self, df: DataFrame) -> DataFrame:
        return nb.within_distance(df, self.params["distance"], "mask", self.by, self.params["inside"], self.params["pixel_size"])
