"""Axis-aligned boxes as four columns, affine grids, map projections and curves."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = ("xmin", "ymin", "xmax", "ymax")


def box(prefix: str = "") -> tuple[Column, ...]:
    return tuple(F.col(prefix + c) for c in BOX)


def touches(a, b) -> Column:
    """Whether two boxes have a point in common; the edge counts."""
    return (a[0] <= b[2]) & (a[2] >= b[0]) & (a[1] <= b[3]) & (a[3] >= b[1])


def contains(a, b) -> Column:
    return (a[0] <= b[0]) & (a[1] <= b[1]) & (a[2] >= b[2]) & (a[3] >= b[3])


def intersection(a, b) -> tuple[Column, ...]:
    return F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3])


def area(a) -> Column:
    return F.greatest(a[2] - a[0], F.lit(0.0)) * F.greatest(a[3] - a[1], F.lit(0.0))


def iou(a, b) -> Column:
    """Area of the intersection over that of the union; where the union has none, 1 for equal boxes and else 0."""
    both = area(intersection(a, b))
    both = F.when(touches(a, b), both).otherwise(F.lit(0.0))
    union = area(a) + area(b) - both
    same = (a[0] == b[0]) & (a[1] == b[1]) & (a[2] == b[2]) & (a[3] == b[3])
    return F.when(union > 0, both / union).otherwise(same.cast("double"))


def centroid_within(a, b, buffer: float) -> Column:
    """Whether b's centre is inside a, widened by a round buffer; the boundary is outside."""
    cx, cy = (b[0] + b[2]) / 2, (b[1] + b[3]) / 2
    if buffer <= 0:
        return (cx > a[0]) & (cx < a[2]) & (cy > a[1]) & (cy < a[3])
    dx = F.greatest(a[0] - cx, cx - a[2], F.lit(0.0))
    dy = F.greatest(a[1] - cy, cy - a[3], F.lit(0.0))
    return F.hypot(dx, dy) < F.lit(buffer)


def forward(affine, col: Column, row: Column) -> tuple[Column, Column]:
    """Map coordinates of pixel coordinates; affine is (a, b, c, d, e, f)."""
    a, b, c, d, e, f = (F.lit(float(k)) for k in affine)
    return a * col + b * row + c, d * col + e * row + f


def inverse(affine, x: Column, y: Column) -> tuple[Column, Column]:
    """Pixel (column, row) coordinates of map coordinates."""
    a, b, c, d, e, f = affine
    det = a * e - b * d
    dx, dy = x - F.lit(float(c)), y - F.lit(float(f))
    return (F.lit(float(e)) * dx - F.lit(float(b)) * dy) / det, (F.lit(float(a)) * dy - F.lit(float(d)) * dx) / det


_R = 6378137.0


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """EPSG:4326 to EPSG:3857."""
    return F.radians(lon) * _R, F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * _R


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / _R), F.degrees(2 * F.atan(F.exp(y / _R)) - F.lit(math.pi / 2))


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = 6371.0) -> Column:
    """Great-circle distance, in the radius's unit."""
    p, q = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((q - p) / 2), F.lit(2)) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return 2 * radius * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def curve_key(x: Column, y: Column, bits: int = 16, bounds=(-180.0, -90.0, 180.0, 90.0)) -> Column:
    """Place of a point on a Hilbert curve of 4 ** bits cells over the bounds."""
    n = 1 << bits
    scale = lambda v, lo, hi: F.floor(F.least(F.greatest((v - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0 - 1e-12)) * n)
    start = F.struct(scale(x, bounds[0], bounds[2]).alias("x"), scale(y, bounds[1], bounds[3]).alias("y"), F.lit(0).cast("long").alias("d"))

    def step(acc, k):
        # from the largest square to the smallest: the quadrant's number, then the turn of what lies within
        s = F.call_function("shiftleft", F.lit(1).cast("long"), k)
        rx, ry = (acc["x"].bitwiseAND(s) > 0).cast("long"), (acc["y"].bitwiseAND(s) > 0).cast("long")
        flip = (ry == 0) & (rx == 1)
        px, py = F.when(flip, s - 1 - acc["x"].bitwiseAND(s - 1)).otherwise(acc["x"].bitwiseAND(s - 1)), F.when(flip, s - 1 - acc["y"].bitwiseAND(s - 1)).otherwise(acc["y"].bitwiseAND(s - 1))
        turn = ry == 0
        return F.struct(F.when(turn, py).otherwise(px).alias("x"), F.when(turn, px).otherwise(py).alias("y"), (acc["d"] * 4 + (rx * 3).bitwiseXOR(ry)).alias("d"))

    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step, lambda acc: acc["d"])
