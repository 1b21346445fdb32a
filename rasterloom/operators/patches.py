"""Cutting grids and series into windows and putting them together again.

A patcher is sampler x geometry x window x aggregation.  Splitting does not join anchors with pixels:
a pixel's anchors follow from its place by arithmetic, so each pixel row is replicated to its patches and nothing
is shuffled before the merge.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..checkpoints import stash
from ..functions.boxes import haversine, inverse
from ..functions.numeric import uniform
from .aggregations import Aggregation
from .neighbours import offsets


class IncompleteScanConfiguration(ValueError):
    """Windows do not end where the field ends."""


# windows: the weight of place i of n -----------------------------------------------------------------------------------


def boxcar(i: Column, n) -> Column:
    return F.lit(1.0)


def hann(i: Column, n: int) -> Column:
    """Symmetric; its ends are 0."""
    return F.lit(1.0) if n == 1 else 0.5 - 0.5 * F.cos(2 * math.pi * i / F.lit(float(n - 1)))


def tukey(alpha: float = 0.5):
    """Tapered cosine, periodic."""
    def weight(i: Column, n: int) -> Column:
        if alpha <= 0 or n <= 1:
            return F.lit(1.0)
        taper = alpha * n / 2.0
        rise = 0.5 * (1 + F.cos(math.pi * (i / F.lit(taper) - 1)))
        fall = 0.5 * (1 + F.cos(math.pi * (i / F.lit(taper) - 2.0 / alpha + 1)))
        return F.when(i < taper, rise).when(i <= n - taper, 1.0).otherwise(fall)

    return weight


def gaussian(sigma: float = 0.5):
    def weight(i: Column, n: int) -> Column:
        return F.lit(1.0) if n <= 1 else F.exp(-0.5 * F.pow((i - (n - 1) / 2.0) / max(sigma * n / 2.0, 1e-12), F.lit(2)))

    return weight


def triangular(width: int = 16):
    """A linear ramp from both ends."""
    def weight(i: Column, n: int) -> Column:
        return F.least(F.lit(1.0), F.least(i + 1, n - i) / F.lit(float(width)))

    return weight


def exponential_decay(tau: float):
    """The newest of n is 1."""
    return lambda i, n: F.exp(-(n - 1 - i) / F.lit(max(tau, 1e-12)))


# samplers ---------------------------------------------------------------------------------------------------------------


@dataclass
class RegularStride:
    """Anchors 0, step, 2 step ... on both axes; with boundary drop as long as the window fits."""

    step: tuple[int, int]
    check_full_scan: bool = False

    def last(self, length: int, size: int, step: int, drop: bool) -> int:
        if self.check_full_scan and (length - size) % step:
            raise IncompleteScanConfiguration(f"{length} - {size} is not a multiple of {step}")
        return ((length - size) // step if length >= size else 0) if drop else (length - 1) // step

    def anchors(self, spark: SparkSession, shape: tuple[int, int], size: tuple[int, int], boundary: str = "drop") -> DataFrame:
        n = [self.last(shape[k], size[k], self.step[k], boundary == "drop") + 1 for k in (0, 1)]
        return spark.range(n[0] * n[1]).select((F.floor(F.col("id") / n[1]) * self.step[0]).alias("ay"), (F.col("id") % n[1] * self.step[1]).alias("ax"))


@dataclass
class JitteredStride:
    step: tuple[int, int]
    jitter: float = 0.5
    seed: int = 0

    def anchors(self, spark, shape, size, boundary="drop"):
        base = RegularStride(self.step).anchors(spark, shape, size, boundary)
        move = lambda k, c: F.greatest(F.lit(0), F.least(F.lit(max(shape[k] - size[k], 0)), F.col(c) + F.floor((uniform(self.seed + k, "ay", "ax") * 2 - 1) * self.jitter * self.step[k])))
        return base.select(move(0, "ay").alias("ay"), move(1, "ax").alias("ax"))


@dataclass
class RandomAnchors:
    n: int
    seed: int = 0

    def anchors(self, spark, shape, size, boundary="drop"):
        top = [max(shape[k] - size[k] + 1, 1) if boundary == "drop" else shape[k] for k in (0, 1)]
        return spark.range(self.n).select(F.floor(uniform(self.seed, "id") * top[0]).alias("ay"), F.floor(uniform(self.seed + 1, "id") * top[1]).alias("ax"))


@dataclass
class PoissonDisk:
    """Anchors at least min_dist apart, so many that none more fits: every place has a random rank, and a place stays that is the first among those near it.

    In rounds: a place of the smallest rank within min_dist is kept and its neighbours go.  Places are joined by cells
    of a grid, so a round is one aggregation; the field may have any size.
    """

    min_dist: float
    seed: int = 0

    def anchors(self, spark, shape, size, boundary="drop"):
        top = [max(shape[k] - size[k] + 1, 1) for k in (0, 1)]
        r = math.ceil(self.min_dist)
        near = [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if math.hypot(dy, dx) < self.min_dist]
        left = spark.range(top[0] * top[1]).select(F.floor(F.col("id") / top[1]).alias("y"), (F.col("id") % top[1]).alias("x"), F.xxhash64(F.lit(self.seed), "id").alias("rank"), "id")
        kept = None
        while True:
            first = offsets(left.withColumn("v", F.struct("rank", "id")), near).groupBy("y", "x").agg(F.min("v").alias("first"))
            won = stash(left.join(first, ["y", "x"]).where("first.id = id").select("y", "x"), "won")
            kept = won if kept is None else kept.unionAll(won)
            gone = offsets(won.withColumn("v", F.lit(1)), near).select("y", "x").distinct()
            left = stash(left.join(gone, ["y", "x"], "left_anti"), "left")
            if left.isEmpty():
                return kept.select(F.col("y").alias("ay"), F.col("x").alias("ax"))


@dataclass
class Explicit:
    places: list[tuple[int, int]] = field(default_factory=list)

    def anchors(self, spark, shape, size, boundary="drop"):
        return spark.createDataFrame(self.places, "ay long, ax long")


def explicit_coords(points: DataFrame, affine, shape, size, boundary: str = "drop", x: str = "px", y: str = "py") -> DataFrame:
    """Anchors of windows centred on map coordinates, moved inside with boundary drop; points outside are left out."""
    col, row = inverse(affine, F.col(x), F.col(y))
    at = points.select(F.floor(row).alias("_r"), F.floor(col).alias("_c")).where((F.col("_r") >= 0) & (F.col("_r") < shape[0]) & (F.col("_c") >= 0) & (F.col("_c") < shape[1]))
    a = [F.col("_r") - size[0] // 2, F.col("_c") - size[1] // 2]
    if boundary == "drop":
        a = [F.greatest(F.lit(0), F.least(F.lit(max(shape[k] - size[k], 0)), a[k])) for k in (0, 1)]
    return at.select(a[0].alias("ay"), a[1].alias("ax"))


def along_track(track: DataFrame, spacing: float, order: str = "k", x: str = "px", y: str = "py") -> DataFrame:
    """Points every `spacing` along a line of vertices; segments without length are dropped."""
    w = W.orderBy(order)
    seg = track.select(order, x, y, F.lead(x).over(w).alias("_x1"), F.lead(y).over(w).alias("_y1")).withColumn("_d", F.hypot(F.col("_x1") - F.col(x), F.col("_y1") - F.col(y))).where("_d > 0")
    seg = seg.withColumn("_to", F.sum("_d").over(w)).withColumn("_from", F.col("_to") - F.col("_d"))
    last = F.max("_to").over(W.partitionBy())
    seg = seg.withColumn("_all", last)
    lo, hi = F.ceil(F.col("_from") / spacing - 1e-9), F.when(F.col("_to") == F.col("_all"), F.floor(F.col("_to") / spacing + 1e-9)).otherwise(F.ceil(F.col("_to") / spacing - 1e-9) - 1)
    pts = seg.where(hi >= lo).withColumn("_i", F.explode(F.sequence(lo, hi)))
    s = (F.col("_i") * spacing - F.col("_from")) / F.col("_d")
    return pts.select(F.col("_i").alias("i"), (F.col(x) + s * (F.col("_x1") - F.col(x))).alias(x), (F.col(y) + s * (F.col("_y1") - F.col(y))).alias(y))


# the spatial patcher ----------------------------------------------------------------------------------------------------


@dataclass
class SpatialPatcher:
    """Windows of `size` at a stride, weighted by a window function of both axes, merged by an aggregation.

    boundary: drop (windows that fit), shrink (clipped), pad (pad_value outside), reflect (mirrored) or raise.
    """

    size: tuple[int, int]
    step: tuple[int, int]
    window: object = staticmethod(boxcar)
    aggregation: Aggregation | None = None
    boundary: str = "drop"
    pad_value: float = float("nan")

    def _range(self, axis: int, place: str, shape) -> tuple[Column, Column]:
        p, s = self.size[axis], self.step[axis]
        last = RegularStride(self.step).last(shape[axis], p, s, self.boundary == "drop")
        return F.greatest(F.lit(0), F.ceil((F.col(place) - (p - 1)) / s)), F.least(F.lit(last), F.floor(F.col(place) / s))

    def split(self, pixels: DataFrame, shape: tuple[int, int], by=()) -> DataFrame:
        """(by, ay, ax, dy, dx, y, x, v, weight) from dense pixels (by, y, x, v); anchors are numbered as ay, ax."""
        if self.boundary == "raise":
            for k in (0, 1):
                if (shape[k] - 1) // self.step[k] * self.step[k] + self.size[k] > shape[k]:
                    raise ValueError("a window reaches beyond the field")
        rows = pixels.select(*by, "y", "x", "v", F.col("y").alias("_y"), F.col("x").alias("_x"))
        if self.boundary in ("pad", "reflect"):
            rows = self._beyond(rows, shape, by)
        (y0, y1), (x0, x1) = self._range(0, "_y", shape), self._range(1, "_x", shape)
        rows = rows.where((y1 >= y0) & (x1 >= x0))
        rows = rows.withColumn("_i", F.explode(F.sequence(y0, y1))).withColumn("_j", F.explode(F.sequence(x0, x1)))
        rows = rows.select(*by, (F.col("_i") * self.step[0]).alias("ay"), (F.col("_j") * self.step[1]).alias("ax"), F.col("_y").alias("y"), F.col("_x").alias("x"), "v")
        dy, dx = F.col("y") - F.col("ay"), F.col("x") - F.col("ax")
        h, w = self.size
        if self.boundary == "shrink":
            # a clipped window keeps the first part of the full one's weights
            rows = rows.where((F.col("y") < shape[0]) & (F.col("x") < shape[1]))
        return rows.select("*", dy.alias("dy"), dx.alias("dx"), (self.window(dy.cast("double"), h) * self.window(dx.cast("double"), w)).alias("weight"))

    def _beyond(self, rows: DataFrame, shape, by) -> DataFrame:
        """The field's rows and those of the frame that windows reach, at (_y, _x)."""
        far = [((shape[k] - 1) // self.step[k]) * self.step[k] + self.size[k] for k in (0, 1)]
        if self.boundary == "reflect":
            mirror = lambda place, n, m: F.filter(F.array(F.col(place), 2 * (n - 1) - F.col(place)), lambda p: (p == F.col(place)) | ((p >= n) & (p < m)))
            return rows.withColumn("_y", F.explode(F.array_distinct(mirror("_y", shape[0], far[0])))).withColumn("_x", F.explode(F.array_distinct(mirror("_x", shape[1], far[1]))))
        spark = rows.sparkSession
        if by:
            # the frame follows from each group by arithmetic
            axis = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
            frame = rows.select(*by).distinct().withColumn("_y", F.explode(axis(far[0]))).withColumn("_x", F.explode(axis(far[1])))
        else:
            frame = spark.range(far[0] * far[1]).select(F.floor(F.col("id") / far[1]).alias("_y"), (F.col("id") % far[1]).alias("_x"))
        frame = frame.where((F.col("_y") >= shape[0]) | (F.col("_x") >= shape[1]))
        return rows.unionByName(frame.select(*by, F.col("_y").alias("y"), F.col("_x").alias("x"), F.lit(self.pad_value).alias("v"), "_y", "_x"))

    def anchors(self, spark: SparkSession, shape) -> DataFrame:
        return RegularStride(self.step).anchors(spark, shape, self.size, self.boundary)

    def n_anchors(self, shape) -> int:
        return math.prod(RegularStride(self.step).last(shape[k], self.size[k], self.step[k], self.boundary == "drop") + 1 for k in (0, 1))

    def patch_at(self, pixels: DataFrame, shape, ay: int, ax: int, by=()) -> DataFrame:
        near = pixels.where(F.col("y").between(ay, ay + self.size[0] - 1) & F.col("x").between(ax, ax + self.size[1] - 1)) if self.boundary not in ("pad", "reflect") else pixels
        return self.split(near, shape, by).where((F.col("ay") == ay) & (F.col("ax") == ax))

    def merge(self, patches: DataFrame, domain: DataFrame | None = None, by=()) -> DataFrame:
        return self.aggregation.merge(patches, domain, (*by, "y", "x"))


def spatio_temporal_product(spatial: DataFrame, series: DataFrame, keys=("y", "x")) -> DataFrame:
    """Every spatial patch with every temporal window: patch rows joined with window rows on their pixel."""
    return spatial.join(series, list(keys))


def coupled(spatial: DataFrame, series: DataFrame, pairs: DataFrame, keys=("y", "x")) -> DataFrame:
    """Only the given pairs of spatial and temporal anchors (ay, ax, at)."""
    return spatial.join(pairs, ["ay", "ax"]).join(series, [*keys, "at"])


def matched_split(patcher: SpatialPatcher, primary: DataFrame, secondaries: dict[str, DataFrame], shape, keys=("y", "x")) -> DataFrame:
    """The primary's patch rows with each secondary's value at the same pixel; where it has none, null and valid_<name> false."""
    out = patcher.split(primary, shape)
    for name, df in secondaries.items():
        if name == "primary":
            raise ValueError("the name primary is taken")
        out = out.join(df.select(*keys, F.col("v").alias(f"v_{name}")), list(keys), "left").withColumn(f"valid_{name}", F.col(f"v_{name}").isNotNull())
    return out


def matched_merge(patches: DataFrame, aggregations: dict[str, Aggregation], domain: DataFrame | None = None) -> dict[str, DataFrame]:
    """The primary and those secondaries that have an aggregation."""
    return {name: a.merge(patches.drop("v").withColumnRenamed(f"v_{name}", "v") if name != "primary" else patches, domain) for name, a in aggregations.items()}


# journal, batches, samples --------------------------------------------------------------------------------------------------


def pending(anchors: DataFrame, journal: DataFrame, key: str = "anchor") -> DataFrame:
    """Anchors whose last journal entry (by seq) is not ok."""
    done = journal.groupBy(key).agg(F.max_by("status", "seq").alias("_s")).where("_s = 'ok'")
    return anchors.join(done, key, "left_anti")


def batch_ids(df: DataFrame, batch_size: int, by: list[str], order: list[str]) -> DataFrame:
    """Consecutive rows of each group in batches of a size: batch and slot."""
    n = F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1
    return df.withColumn("_n", n).withColumn("batch", F.floor(F.col("_n") / batch_size)).withColumn("slot", F.col("_n") % batch_size).drop("_n")


def quotas(proportions: dict, n: int) -> dict:
    """Largest remainder: floor(n p), then one more for the largest remainders, of equal ones the lower class first."""
    base = {c: math.floor(n * p) for c, p in proportions.items()}
    left = n - sum(base.values())
    for c in sorted(proportions, key=lambda c: (-(n * proportions[c] - base[c]), c))[:left]:
        base[c] += 1
    return base


#: Parts of a class of which large samples are drawn.
_PARTS = 256


def stratified_sample(df: DataFrame, label: str, wanted: dict, key: list[str], seed: int = 0) -> DataFrame:
    """As many rows of each class as wanted, by the smallest hash; all of a class that has fewer.

    No task meets all rows of a class: up to a limit that Spark sets, a task passes on no more rows of a class than the largest
    number wanted; beyond it the rows of a class are first dealt to parts, of which each passes on no more than that.
    """
    quota = F.create_map(*[x for c, n in wanted.items() for x in (F.lit(c), F.lit(n))])
    most, order = max(wanted.values(), default=0), [uniform(seed, *key), *key]
    # the comparison with a literal is what lets Spark cut ranks before the shuffle
    first = lambda rows, by: rows.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= F.lit(most))
    rows = df.where(F.col(label).isin(list(wanted)))
    if most >= int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        rows = first(rows.withColumn("_part", F.pmod(F.xxhash64(*key), F.lit(_PARTS))), [label, "_part"]).drop("_n", "_part")
    return first(rows, [label]).where(F.col("_n") <= quota[F.col(label)]).drop("_n")


def spherical_cap(points: DataFrame, lon: float, lat: float, radius_km: float, x: str = "px", y: str = "py") -> DataFrame:
    """Points within a great-circle distance."""
    return points.withColumn("distance", haversine(F.lit(lon), F.lit(lat), F.col(x), F.col(y))).where(F.col("distance") <= radius_km)


# time -----------------------------------------------------------------------------------------------------------------------


def lookback(length: int) -> tuple[int, int]:
    """Frame of the last `length` rows."""
    return -(length - 1), 0


def lookback_horizon(back: int, ahead: int) -> tuple[int, int]:
    return -(back - 1), ahead


def phase_window(width: int) -> tuple[int, int]:
    return -width, width


def temporal_split(series: DataFrame, by: list[str], before: int, after: int, anchors: Column, t: str = "t") -> DataFrame:
    """(by, at, t, k, v): for rows (by, t, v) with whole numbers t, those from at - before to at + after of each anchor `at`.

    A row is replicated to its anchors; `anchors` says of a number `at` whether it is one.
    """
    at = F.explode(F.sequence(F.col(t) - after, F.col(t) + before))
    return series.select(*by, F.col(t).alias("t"), "v", at.alias("at")).where(anchors).withColumn("k", F.col("t") - F.col("at") + before)


def frame(df: DataFrame, by: list[str], order: list[str], start: int, end: int, **aggregates: Column) -> DataFrame:
    """Aggregates over the rows from start to end around each row."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(start, end)
    return df.withColumns({k: a.over(w) for k, a in aggregates.items()})


@dataclass(frozen=True)
class Stencil:
    """Points start, start + step .. stop around an origin; closed says which ends belong to it."""

    start: float
    stop: float
    step: float
    closed: str = "left"

    def __post_init__(self):
        if self.step <= 0 or self.stop < self.start:
            raise ValueError("a stencil rises by a positive step")
        n = (self.stop - self.start) / self.step
        if abs(n - round(n)) > 1e-6:
            raise ValueError("stop - start is not a multiple of step")

    def points(self) -> list[float]:
        n = round((self.stop - self.start) / self.step)
        return [self.start + k * self.step for k in range(n + 1) if (k > 0 or self.closed in ("left", "both")) and (k < n or self.closed in ("right", "both"))]

    def valid_origins(self, df: DataFrame, t: str = "t") -> DataFrame:
        """Origins at which all the points lie between the first and the last t."""
        p = self.points()
        ends = df.agg(F.min(t).alias("_lo"), F.max(t).alias("_hi"))
        return df.join(F.broadcast(ends)).where((F.col(t) + min(p) >= F.col("_lo")) & (F.col(t) + max(p) <= F.col("_hi"))).drop("_lo", "_hi")

    def sample(self, df: DataFrame, by: list[str], origins: DataFrame, t: str = "t") -> DataFrame:
        """(by, origin, k, v): the values at the stencil's points of each origin."""
        steps = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(p)).alias("p")) for k, p in enumerate(self.points())])
        want = origins.select(*by, F.col(t).alias("origin"), F.explode(steps).alias("s")).select(*by, "origin", "s.k", (F.col("origin") + F.col("s.p")).alias("_at"))
        return want.join(df.select(*by, F.col(t).cast("double").alias("_at"), "v"), [*by, "_at"]).drop("_at")


class TimeStencil(Stencil):
    """A stencil in seconds from texts such as "3h", "-30min", "1d"."""

    UNITS = {"s": 1, "min": 60, "h": 3600, "d": 86400}

    @classmethod
    def of(cls, start: str, stop: str, step: str, closed: str = "left") -> "TimeStencil":
        import re

        def seconds(text: str) -> float:
            m = re.fullmatch(r"\s*([+-]?\d+(?:\.\d+)?)\s*(s|min|h|d)\s*", text)
            if not m:
                raise ValueError(f"no duration: {text!r}")
            return float(m[1]) * cls.UNITS[m[2]]

        return cls(seconds(start), seconds(stop), seconds(step), closed)
