"""Neighbourhoods on a grid: shifted copies of the rows meet in their target cells.

offsets() replicates each cell to the cells that see it, a fixed number of times, and one
aggregation by cell follows: no window over a whole scene, no join of a scene with itself.
Tables have y, x, a value column and group columns `by` (scene, band).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.numeric import valid


def square(radius: int) -> list[tuple[int, int]]:
    return [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1)]


def disc(radius: float, py: float = 1.0, px: float = 1.0) -> list[tuple[int, int]]:
    ry, rx = int(radius / py), int(radius / px)
    return [(dy, dx) for dy in range(-ry, ry + 1) for dx in range(-rx, rx + 1) if (dy * py) ** 2 + (dx * px) ** 2 <= radius * radius + 1e-9]


def offsets(df: DataFrame, shifts: list[tuple[int, int]], v: str = "v", by=()) -> DataFrame:
    """(by, y, x, dy, dx, v): each row at every cell from which it lies at (dy, dx)."""
    each = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in shifts])
    rows = df.select(*by, "y", "x", F.col(v).alias("v"), F.explode(each).alias("o"))
    return rows.select(*by, (F.col("y") - F.col("o.dy")).alias("y"), (F.col("x") - F.col("o.dx")).alias("x"), "o.dy", "o.dx", "v")


def neighbourhood(df: DataFrame, shifts: list[tuple[int, int]], v: str = "v", by=(), **aggregates: Column) -> DataFrame:
    """Aggregates over (v, dy, dx) of each cell's neighbours that exist, for the cells of df."""
    own = df.select(*by, "y", "x").distinct()
    seen = offsets(df, shifts, v, by).groupBy(*by, "y", "x").agg(*[a.alias(k) for k, a in aggregates.items()])
    return own.join(seen, [*by, "y", "x"], "left")


def dilate(df: DataFrame, v: str = "v", by=(), iterations: int = 1, structure=None) -> DataFrame:
    """Boolean dilation by a 3 x 3 (or given) structure; outside is false."""
    shifts = structure or square(1)
    for _ in range(iterations):
        df = neighbourhood(df, shifts, v, by, _m=F.max(F.col("v"))).select(*by, "y", "x", F.coalesce("_m", F.lit(False)).alias(v))
    return df


def erode(df: DataFrame, v: str = "v", by=(), iterations: int = 1, structure=None) -> DataFrame:
    """Boolean erosion; outside is false, so cells at the border go."""
    shifts = structure or square(1)
    for _ in range(iterations):
        df = neighbourhood(df, shifts, v, by, _n=F.count_if(F.col("v"))).select(*by, "y", "x", (F.coalesce("_n", F.lit(0)) == len(shifts)).alias(v))
    return df


def opened(df: DataFrame, v: str = "v", by=(), iterations: int = 1) -> DataFrame:
    return dilate(erode(df, v, by, iterations), v, by, iterations)


def closed(df: DataFrame, v: str = "v", by=(), iterations: int = 1) -> DataFrame:
    return erode(dilate(df, v, by, iterations), v, by, iterations)


def buffer(df: DataFrame, radius: float, v: str = "v", by=(), unit: str = "pixels", pixel_size=(1.0, 1.0)) -> DataFrame:
    """True within a Euclidean distance (pixels, or map units by pixel_size) of a true cell."""
    py, px = (1.0, 1.0) if unit == "pixels" else pixel_size
    return dilate(df, v, by, 1, disc(radius, py, px))


def within_distance(df: DataFrame, distance: float, v: str = "v", by=(), inside: bool = True, pixel_size=(1.0, 1.0)) -> DataFrame:
    near = buffer(df, distance, v, by, "map", pixel_size)
    return near if inside else near.withColumn(v, ~F.col(v))


def gradients(df: DataFrame, v: str = "v", by=(), dx: float = 1.0, dy: float = 1.0) -> DataFrame:
    """(by, y, x, v, gy, gx): central differences, one-sided at the ends of a row or column."""
    def slope(lines, along, step):
        w = W.partitionBy(*by, lines).orderBy(along)
        before, after, c = F.lag(v).over(w), F.lead(v).over(w), F.col(v)
        return F.when(before.isNull(), (after - c) / F.lit(step)).when(after.isNull(), (c - before) / F.lit(step)).otherwise((after - before) / F.lit(2.0 * step))

    return df.select(*by, "y", "x", v, slope("x", "y", dy).alias("gy"), slope("y", "x", dx).alias("gx"))


def slope_degrees(df: DataFrame, v: str = "v", by=(), pixel_size=(1.0, 1.0)) -> DataFrame:
    g = gradients(df, v, by, dx=abs(pixel_size[1]), dy=abs(pixel_size[0]))
    return g.select(*by, "y", "x", F.degrees(F.atan(F.hypot("gx", "gy"))).alias("slope"))


def slope_mask(df: DataFrame, v: str = "v", by=(), pixel_size=(1.0, 1.0), low: float | None = None, high: float | None = None) -> DataFrame:
    s, ok = slope_degrees(df, v, by, pixel_size), F.lit(True)
    if low is not None:
        ok = ok & (F.col("slope") >= low)
    if high is not None:
        ok = ok & (F.col("slope") <= high)
    return s.select(*by, "y", "x", ok.alias("mask"))


def gap_fill_idw(df: DataFrame, v: str = "v", by=(), power: float = 2.0, radius: int = 5) -> DataFrame:
    """NaN and null cells from finite ones within radius, weighted 1 / max(d, 1e-12) ** power; from power 64 on by the nearest."""
    shifts = [s for s in disc(radius) if s != (0, 0)]
    d = F.sqrt((F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx")).cast("double"))
    w, x = F.when(valid(F.col("v")).isNotNull(), F.pow(F.greatest(d, F.lit(1e-12)), F.lit(-power))), valid(F.col("v"))
    how = F.min_by(x, F.when(x.isNotNull(), F.struct(d, "dy", "dx"))) if power >= 64 else F.sum(w * x) / F.sum(w)
    gaps = df.where(valid(F.col(v)).isNull()).select(*by, "y", "x")
    seen = offsets(df.where(valid(F.col(v)).isNotNull()), shifts, v, by).join(gaps, [*by, "y", "x"], "left_semi").groupBy(*by, "y", "x").agg(how.alias("_fill"))
    return df.join(seen, [*by, "y", "x"], "left").withColumn(v, F.coalesce(valid(F.col(v)), F.col("_fill"), F.lit(float("nan")))).drop("_fill")


def gap_fill_nearest(df: DataFrame, v: str = "v", by=(), max_distance: int = 5) -> DataFrame:
    """Gaps from the nearest finite cell within max_distance; of equally near ones the first by row and column."""
    return gap_fill_idw(df, v, by, power=64.0, radius=max_distance)


def expand_labels(df: DataFrame, distance: float = 1.0, v: str = "label", by=()) -> DataFrame:
    """Background cells (0) take the nearest label within distance; of equally near ones the smallest."""
    d = F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx")
    near = offsets(df.where(F.col(v) != 0), disc(distance), v, by).groupBy(*by, "y", "x").agg(F.min(F.struct(d.alias("d"), "v")).alias("_n"))
    return df.join(near, [*by, "y", "x"], "left").withColumn(v, F.when(F.col(v) != 0, F.col(v)).otherwise(F.coalesce(F.col("_n.v"), F.lit(0)))).drop("_n")


def boundaries(df: DataFrame, v: str = "label", by=()) -> DataFrame:
    """Whether one of the four neighbours has another label."""
    n = neighbourhood(df, [(0, 1), (0, -1), (1, 0), (-1, 0), (0, 0)], v, by, lo=F.min("v"), hi=F.max("v"))
    return n.select(*by, "y", "x", (F.col("lo") != F.col("hi")).alias("boundary"))


def padded(df: DataFrame, radius: int, pad: str = "nearest", v: str = "v", by=()) -> DataFrame:
    """(by, y, x, v) with a frame `radius` wide: "nearest" repeats the border cells, "reflect" mirrors the field with its border cells.

    The field's box follows from each group's rows; with "reflect" it must be at least `radius` wide and high.
    """
    if pad not in ("nearest", "reflect"):
        raise ValueError("pad is nearest or reflect")
    box = df.groupBy(*by).agg(*[f(c).alias(f"_{c}{n}") for c in ("y", "x") for f, n in ((F.min, 0), (F.max, 1))])
    rows = df.select(*by, "y", "x", F.col(v).alias("v"))
    rows = rows.join(box, list(by)) if by else rows.join(F.broadcast(box))

    def places(c):
        p, lo, hi = F.col(c), F.col(f"_{c}0"), F.col(f"_{c}1")
        if pad == "nearest":
            return F.sequence(F.when(p == lo, p - radius).otherwise(p), F.when(p == hi, p + radius).otherwise(p))
        return F.filter(F.array(p, 2 * lo - 1 - p, 2 * hi + 1 - p), lambda q: (q >= lo - radius) & (q <= hi + radius))

    return rows.withColumn("y", F.explode(places("y"))).withColumn("x", F.explode(places("x"))).select(*by, "y", "x", "v")


def windowed(df: DataFrame, shifts: list[tuple[int, int]], pad: str = "nearest", v: str = "v", by=(), **aggregates: Column) -> DataFrame:
    """As neighbourhood(), with the field padded, so that all windows are whole."""
    radius = max(max(abs(dy), abs(dx)) for dy, dx in shifts)
    seen = offsets(padded(df, radius, pad, v, by) if radius else df, shifts, v if not radius else "v", by)
    seen = seen.groupBy(*by, "y", "x").agg(*[a.alias(k) for k, a in aggregates.items()])
    return df.select(*by, "y", "x").distinct().join(seen, [*by, "y", "x"])


def _moments(df: DataFrame, window: int, v: str, by) -> DataFrame:
    """Mean and population variance of the finite cells of a window, borders repeated."""
    x = valid(F.col("v"))
    return windowed(df, square(window // 2), "nearest", v, by, mean=F.avg(x), var=F.var_pop(x))


def adaptive_background(df: DataFrame, window: int = 7, pad: str = "reflect", v: str = "v", by=()) -> DataFrame:
    """Mean and sample variance (n / (n - 1), n the window's cells) of an odd window; a NaN makes its windows NaN."""
    if window < 1 or window % 2 == 0:
        raise ValueError("window is odd and positive")
    n = window * window
    m = windowed(df, square(window // 2), pad, v, by, mean=F.avg("v"), var=F.var_pop("v"))
    return m.withColumn("var", F.col("var") * (n / max(n - 1, 1)))


def _kept_nan(v: str, new: Column) -> Column:
    return F.when(F.isnan(v) | F.col(v).isNull(), F.col(v)).otherwise(new)


def despeckle_lee(df: DataFrame, window: int = 7, cu: float = 0.523, v: str = "v", by=()) -> DataFrame:
    """mean + w (v - mean), w = var / (2 (var + (cu mean)^2)), 0 where there is no variance; NaN stays."""
    both = df.join(_moments(df, window, v, by), [*by, "y", "x"])
    w = F.when(F.col("var") > 0, 0.5 * F.col("var") / (F.col("var") + F.pow(F.lit(cu) * F.col("mean"), F.lit(2)))).otherwise(F.lit(0.0))
    return both.withColumn(v, _kept_nan(v, F.col("mean") + w * (F.col(v) - F.col("mean")))).drop("mean", "var")


def despeckle_frost(df: DataFrame, window: int = 7, damping: float = 2.0, v: str = "v", by=()) -> DataFrame:
    """a v + (1 - a) mean, a = exp(-damping * deviation / |mean|), 1 where the mean is 0; NaN stays."""
    both = df.join(_moments(df, window, v, by), [*by, "y", "x"])
    cv = F.when(F.col("mean") != 0, F.sqrt("var") / F.abs("mean")).otherwise(F.lit(0.0))
    a = F.exp(-F.lit(damping) * cv)
    return both.withColumn(v, _kept_nan(v, a * F.col(v) + (1 - a) * F.col("mean"))).drop("mean", "var")


def median_denoise(df: DataFrame, size: int = 3, v: str = "v", by=()) -> DataFrame:
    """Median of the window, borders repeated and NaN taken as the median of the whole group; NaN stays."""
    whole = df.groupBy(*by).agg(F.median(valid(F.col(v))).alias("_all"))
    full = (df.join(whole, list(by)) if by else df.join(F.broadcast(whole))).select(*by, "y", "x", F.coalesce(valid(F.col(v)), F.col("_all")).alias("v"))
    n = windowed(full, square(size // 2), "nearest", "v", by, _m=F.median("v"))
    return df.join(n, [*by, "y", "x"]).withColumn(v, _kept_nan(v, F.col("_m"))).drop("_m")


def gaussian_denoise(df: DataFrame, sigma: float = 1.0, v: str = "v", by=()) -> DataFrame:
    """Gaussian mean of the finite cells within four sigma, borders repeated; NaN stays."""
    if sigma == 0:
        return df
    w = F.exp(-(F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx")) / F.lit(2 * sigma * sigma))
    x = valid(F.col("v"))
    n = windowed(df, square(int(4 * sigma + 0.5)), "nearest", v, by, _m=F.sum(w * x) / F.sum(F.when(x.isNotNull(), w)))
    return df.join(n, [*by, "y", "x"]).withColumn(v, _kept_nan(v, F.col("_m"))).drop("_m")


def destripe(df: DataFrame, v: str = "v", by=(), method: str = "mean", axis: str = "column", window: int = 21) -> DataFrame:
    """v - (profile - target): each column's (row's) mean or median against the mean or median of these; moment_matching then takes the mean of a window; NaN stays."""
    if method not in ("mean", "median", "moment_matching"):
        raise ValueError("method is mean, median or moment_matching")
    line = "x" if axis == "column" else "y"
    how = F.median if method == "median" else F.avg
    profile = df.groupBy(*by, line).agg(how(valid(F.col(v))).alias("_p"))
    target = profile.groupBy(*by).agg(how("_p").alias("_t"))
    profile = profile.join(target, list(by)) if by else profile.join(F.broadcast(target))
    out = df.join(profile, [*by, line]).withColumn(v, F.col(v) - (F.col("_p") - F.col("_t"))).drop("_p", "_t")
    if method == "moment_matching":
        out = out.join(_moments(out, window, v, by), [*by, "y", "x"]).withColumn(v, _kept_nan(v, F.col("mean"))).drop("mean", "var")
    return out


def peak_local_max(df: DataFrame, min_distance: int = 1, threshold: float | None = None, v: str = "v", by=()) -> DataFrame:
    """Cells above the threshold that are the largest of their window; all of its cells must exist."""
    n = neighbourhood(df, square(min_distance), v, by, _m=F.max("v"), _n=F.count("v"))
    both = df.join(n, [*by, "y", "x"]).where((F.col(v) == F.col("_m")) & (F.col("_n") == (2 * min_distance + 1) ** 2))
    both = both.where(F.col(v) > threshold) if threshold is not None else both
    return both.select(*by, "y", "x", F.col(v).alias("score"))
