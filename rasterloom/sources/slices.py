"""Requests for a piece of space and time, and alignment of grids."""

from __future__ import annotations

import datetime as dt
import math
import warnings
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Of a pixel; three digits.
TOLERANCE = 1e-3


class GridAlignmentWarning(UserWarning):
    """A request does not fit its grid."""


def divide_evenly(length: float, step: float, *, tol: float = TOLERANCE, label: str = "length") -> int:
    """The whole number of steps in a length; an error if that leaves more than tol."""
    q = round(length / step)
    if abs(q * step - length) > tol:
        raise ValueError(f"{label} {length} is not a multiple of {step}")
    return q


def divided_evenly(length: Column, step: Column, tol: float = TOLERANCE) -> Column:
    """The same as a column: null where it doesn't fit."""
    q = F.rint(length / step)
    return F.when(F.abs(q * step - length) <= F.lit(tol), q.cast("long"))


def is_grid_aligned(a: dict[str, Column], b: dict[str, Column], tol: float = TOLERANCE) -> Column:
    """Whether two grids (crs, rx, ry, x0, y0) have the same cells, up to whole cells of offset."""
    def residual(v, r):
        off = v / r
        return F.abs((off - F.rint(off)) * r)

    return (a["crs"] == b["crs"]) & (F.abs(a["rx"] - b["rx"]) <= tol) & (F.abs(a["ry"] - b["ry"]) <= tol) & (residual(a["x0"] - b["x0"], a["rx"]) <= tol) & (residual(a["y0"] - b["y0"], a["ry"]) <= tol)


@dataclass(frozen=True)
class GeoSlice:
    """Bounds (xmin, ymin, xmax, ymax), a closed interval, a resolution (x, y) and a CRS."""

    bounds: tuple[float, float, float, float]
    interval: tuple[dt.datetime, dt.datetime]
    resolution: tuple[float, float]
    crs: str = "EPSG:4326"
    align: str = field(default="off", compare=False)

    def __post_init__(self):
        x0, y0, x1, y1 = self.bounds
        if not (all(map(math.isfinite, self.bounds)) and x0 < x1 and y0 < y1):
            raise ValueError("bounds must be finite and rise")
        if self.interval[0] > self.interval[1]:
            raise ValueError("the interval ends before it starts")
        if min(self.resolution) <= 0:
            raise ValueError("resolution must be positive")
        if self.align not in ("off", "warn", "error", "snap"):
            raise ValueError("align is off, warn, error or snap")
        if self.align != "off" and not self._even():
            if self.align == "error":
                raise ValueError("bounds are not a whole number of pixels")
            warnings.warn("bounds are not a whole number of pixels", GridAlignmentWarning, stacklevel=3)
            if self.align == "snap":
                nx, ny = math.ceil((x1 - x0) / self.resolution[0]), math.ceil((y1 - y0) / self.resolution[1])
                object.__setattr__(self, "bounds", (x0, y1 - ny * self.resolution[1], x0 + nx * self.resolution[0], y1))

    def _even(self) -> bool:
        x0, y0, x1, y1 = self.bounds
        return all(abs(round(n / r) * r - n) <= TOLERANCE * r for n, r in ((x1 - x0, self.resolution[0]), (y1 - y0, self.resolution[1])))

    @property
    def shape(self) -> tuple[int, int]:
        """(height, width), rounded half to even."""
        x0, y0, x1, y1 = self.bounds
        return round((y1 - y0) / self.resolution[1]), round((x1 - x0) / self.resolution[0])

    @property
    def transform(self) -> tuple[float, ...]:
        """Affine from pixel (column, row) to map coordinates, north up."""
        return self.resolution[0], 0.0, self.bounds[0], 0.0, -self.resolution[1], self.bounds[3]


def slice_to_window(bounds, transform) -> tuple[float, float, float, float]:
    """(column, row, width, height) of bounds on a north-up grid."""
    a, _, c, _, e, f = transform
    x0, y0, x1, y1 = bounds
    return (x0 - c) / a, (y1 - f) / e, (x1 - x0) / a, (y0 - y1) / e


def window_to_slice(window, transform, interval, resolution, crs) -> GeoSlice:
    a, _, c, _, e, f = transform
    col, row, width, height = window
    return GeoSlice((c + a * col, f + e * (row + height), c + a * (col + width), f + e * row), interval, resolution, crs)
