"""Range joins by grid cells.

Both sides are replicated to the cells they reach and joined on the cell, so the plan is an equi-join.
A pair that shares several cells is kept in one of them, that of the greater lower corners, so no
distinct follows.

Where place alone decides, rows at the same place, or with the same box, are joined as one: the rule is
judged once for two places, and their pairs of rows come from the bundles of rows that the places carry.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..checkpoints import stash
from ..functions.boxes import BOX
from ..functions.numeric import micros


def _flat(df: DataFrame, name: str) -> list[Column]:
    return [F.col(c).alias(f"{name}__{c}") for c in df.columns]


def _struct(df: DataFrame, name: str) -> Column:
    return F.struct(*[F.col(f"{name}__{c}").alias(c) for c in df.columns]).alias(name)


#: Rows of one place that are joined as one, at most.
BUNDLE = 256


def _bundles(df: DataFrame, name: str, by: list[str]) -> DataFrame:
    """The columns `by`, which are not null, and `name`__rows, the other columns of up to BUNDLE rows that have them; a crowded place has several bundles."""
    others = [F.col(f"`{c}`") for c in df.columns if c not in by] or [F.lit(True).alias("_")]
    place = df.dropna(subset=by).select(*[F.col(c).alias(f"{name}__{c}") for c in by], F.struct(*others).alias("_row"))
    keys = [f"{name}__{c}" for c in by]
    dealt = place.withColumn("_k", F.floor((F.row_number().over(W.partitionBy(*keys).orderBy(*keys)) - 1) / BUNDLE))
    return dealt.groupBy(*keys, "_k").agg(F.collect_list("_row").alias(f"{name}__rows")).drop("_k")


def _unbundled(pairs: DataFrame, left: DataFrame, right: DataFrame, by: list[str], *more: Column) -> DataFrame:
    """A row, with structs l and r, for each pair of rows of two bundles."""
    out = pairs.withColumn("_l", F.explode("l__rows")).withColumn("_r", F.explode("r__rows"))
    one = lambda df, name: F.struct(*[F.col(f"{name}__{c}").alias(c) if c in by else F.col(f"_{name}.`{c}`").alias(c) for c in df.columns]).alias(name)
    return out.select(one(left, "l"), one(right, "r"), *more)


def _distance(x: str, y: str) -> Column:
    dx, dy = F.col(f"l__{x}") - F.col(f"r__{x}"), F.col(f"l__{y}") - F.col(f"r__{y}")
    return F.sqrt(dx * dx + dy * dy)


def extent(df: DataFrame) -> tuple[float, float]:
    """Mean of the longer sides of the boxes and of the intervals in days, 0 where there are none."""
    side = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"))
    length = ((micros("end_time") - micros("start_time")) / 86_400e6) if "start_time" in df.columns else F.lit(0.0)
    means = df.agg(F.avg(F.when(~F.isnan(side), side)), F.avg(length)).first()
    return tuple(max(m or 0.0, 0.0) for m in means)


def box_join(left: DataFrame, right: DataFrame, *, cell: float | None = None, days: float | None = None, start: str = "start_time", end: str = "end_time") -> DataFrame:
    """Rows of both sides whose boxes touch, as structs l and r; with `days`, whose closed intervals overlap too.

    `cell` is the grid's width in the boxes' unit, by default the sum of both sides' mean sizes; `days` the length of a time bucket.
    Without `days` rows with the same box are joined as one.
    """
    cell = cell or (extent(left)[0] + extent(right)[0]) or 1.0
    by = list(BOX)
    day = lambda c: micros(c) / 86_400e6

    def side(df, name):
        rows, flat = (df, _flat(df, name)) if days else (_bundles(df, name, by), [F.col(f"{name}__{c}") for c in (*by, "rows")])
        at = lambda c: F.col(c if days else f"{name}__{c}")
        axes = [("xmin", "xmax", cell), ("ymin", "ymax", cell)]
        spans = [(F.floor(at(a) / g), F.floor(at(b) / g)) for a, b, g in axes]
        if days:
            spans.append((F.floor(day(start) / days), F.floor(day(end) / days)))
        out = rows.select(*flat, *[a.alias(f"_{name}{k}") for k, (a, _) in enumerate(spans)], *[F.sequence(a, b).alias(f"_s{k}") for k, (a, b) in enumerate(spans)])
        for k in range(len(spans)):
            out = out.withColumn(f"_c{k}", F.explode(f"_s{k}")).drop(f"_s{k}")
        return out, len(spans)

    (a, n), (b, _) = side(left, "l"), side(right, "r")
    c = F.col
    ok = (c("l__xmin") <= c("r__xmax")) & (c("l__xmax") >= c("r__xmin")) & (c("l__ymin") <= c("r__ymax")) & (c("l__ymax") >= c("r__ymin"))
    if days:
        ok = ok & (c(f"l__{start}") <= c(f"r__{end}")) & (c(f"l__{end}") >= c(f"r__{start}"))
    for k in range(n):
        ok = ok & (c(f"_c{k}") == F.greatest(f"_l{k}", f"_r{k}"))
    met = a.join(b, [f"_c{k}" for k in range(n)]).where(ok)
    return met.select(_struct(left, "l"), _struct(right, "r")) if days else _unbundled(met, left, right, by)


def radius_join(left: DataFrame, right: DataFrame, radius: float, x: str = "px", y: str = "py", bundled: bool = True, shown: Callable[[Column], Column] = lambda d: d) -> DataFrame:
    """Points of both sides at most `radius` apart, as structs l and r with their distance, of which `shown` is given.

    Points at the same place are joined as one if `bundled`, which pays where there are many.
    """
    by = [x, y]
    a, b = (_bundles(left, "l", by), _bundles(right, "r", by)) if bundled else (left.select(*_flat(left, "l")), right.select(*_flat(right, "r")))
    cell = lambda c: F.floor(F.col(c) / radius)
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    a = a.select("*", cell(f"l__{x}").alias("_x"), cell(f"l__{y}").alias("_y"), F.explode(around).alias("_o"))
    a = a.withColumn("_cx", F.col("_x") + F.col("_o.i")).withColumn("_cy", F.col("_y") + F.col("_o.j")).drop("_x", "_y", "_o")
    b = b.select("*", cell(f"r__{x}").alias("_cx"), cell(f"r__{y}").alias("_cy"))
    d = _distance(x, y)
    met = a.join(b, ["_cx", "_cy"]).where(d <= radius)
    if not bundled:
        return met.select(_struct(left, "l"), _struct(right, "r"), shown(d).alias("distance"))
    return _unbundled(met.withColumn("distance", shown(d)), left, right, by, F.col("distance"))


#: Cells a side of the grid by which the points that a doubled radius does not settle are searched, and doublings before that.
_GRID, _DOUBLINGS = 32, 4


def _nearest(pairs: DataFrame, k: int, left_id: str, right_id: str) -> DataFrame:
    return pairs.withColumn("rank", F.row_number().over(W.partitionBy(f"l.{left_id}").orderBy("distance", f"r.{right_id}"))).where(F.col("rank") <= k)


def _far_nearest(left: DataFrame, right: DataFrame, k: int, x: str, y: str) -> DataFrame:
    """Candidates (l, r, distance) with the k nearest, wherever the points lie.

    `right` is dealt to a grid of fixed size over its extent; the cells' boxes and counts, at most _GRID ** 2, go to every task.
    The nearest cells that together hold k points bound the distance, and only cells that come nearer are joined.
    """
    ends = right.agg(F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1"))
    at = lambda c, lo, hi: F.least(F.lit(_GRID - 1), F.floor(F.coalesce(F.try_divide((F.col(c) - F.col(lo)) * _GRID, F.col(hi) - F.col(lo)), F.lit(0.0)))).cast("long")
    dealt = right.join(F.broadcast(ends)).withColumn("_cell", at(x, "_x0", "_x1") * _GRID + at(y, "_y0", "_y1")).drop("_x0", "_x1", "_y0", "_y1")
    cells = dealt.groupBy("_cell").agg(F.count("*").alias("n"), F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    cells = cells.agg(F.collect_list(F.struct("_cell", "n", "x0", "x1", "y0", "y1")).alias("_cells"))

    def reach(c):
        gap = lambda p, lo, hi: F.greatest(c[lo] - F.col(p), F.col(p) - c[hi], F.lit(0.0))
        span = lambda p, lo, hi: F.greatest(F.abs(c[lo] - F.col(p)), F.abs(F.col(p) - c[hi]))
        return F.struct(F.hypot(span(x, "x0", "x1"), span(y, "y0", "y1")).alias("most"), c["n"].alias("n"), F.hypot(gap(x, "x0", "x1"), gap(y, "y0", "y1")).alias("least"), c["_cell"].alias("cell"))

    a = left.join(F.broadcast(cells)).withColumn("_by", F.array_sort(F.transform("_cells", reach))).drop("_cells")
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("d"))
    bound = F.aggregate("_by", start, lambda s, c: F.when(s["n"] >= k, s).otherwise(F.struct((s["n"] + c["n"]).alias("n"), c["most"].alias("d"))))["d"]
    a = a.withColumn("_d", bound).withColumn("_cell", F.explode(F.transform(F.filter("_by", lambda c: c["least"] <= F.col("_d")), lambda c: c["cell"])))
    a = a.select(*_flat(left, "l"), "_cell")
    b = dealt.select(*_flat(right, "r"), "_cell")
    d = _distance(x, y)
    return a.join(b, "_cell").select(_struct(left, "l"), _struct(right, "r"), d.alias("distance"))


#: Points of `right` in a cell that the first radius is chosen for, as a multiple of k, and halvings of the radius to get there.
_FULL, _HALVINGS = 16, 24


def _first_radius(right: DataFrame, k: int, radius: float, x: str, y: str) -> tuple[float, int]:
    """The radius, halved until no cell of that width holds many more points than are looked for, and the number of halvings."""
    for halved in range(_HALVINGS):
        most = right.groupBy(F.floor(F.col(x) / radius), F.floor(F.col(y) / radius)).count().agg(F.max("count")).first()[0]
        if most <= _FULL * k:
            return radius, halved
        radius /= 2
    return radius, _HALVINGS


def knn_join(left: DataFrame, right: DataFrame, k: int, radius: float, left_id: str = "id", right_id: str = "id", x: str = "px", y: str = "py") -> DataFrame:
    """The k nearest points of `right` for each of `left`, ties by id, as (l, r, distance, rank).

    Left points at the same place have the same nearest ones, and of right points at the same place only the k smallest ids can be among
    them: places are searched, not points.  The search begins with a radius, `radius` at most, within which few points lie anywhere, and
    doubles it until some way beyond `radius` for places that have fewer than k within it; for the places left then, counts on
    a grid tell which cells can hold the nearest.  Where `right` has fewer than k points, all are given; points without coordinates have none.
    """
    if left.isEmpty() or right.isEmpty():
        return radius_join(left, right, radius, x, y).withColumn("rank", F.lit(1)).limit(0)
    kept = right.withColumn("_n", F.row_number().over(W.partitionBy(x, y).orderBy(right_id))).where(F.col("_n") <= k).drop("_n")
    kept = stash(kept, "points")
    place = [F.col(x).alias("_x"), F.col(y).alias("_y")]
    todo = stash(left.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y).distinct().withColumn("_place", F.monotonically_increasing_id()), "places")
    radius, halved = _first_radius(kept, k, radius, x, y)
    found = None
    for _ in range(_DOUBLINGS + halved):
        ranked = stash(_nearest(radius_join(todo, kept, radius, x, y, False), k, "_place", right_id), "nearest")
        full = ranked.where(F.col("rank") == k).select(F.col("l._place").alias("_done"))
        part = ranked.join(full, F.col("l._place") == F.col("_done"), "left_semi")
        found = part if found is None else found.unionAll(part)
        todo = stash(todo.join(full, todo["_place"] == full["_done"], "left_anti"), "todo")
        if todo.isEmpty():
            break
        radius *= 2
    else:
        found = found.unionAll(_nearest(_far_nearest(todo, kept, k, x, y), k, "_place", right_id))
    lists = found.groupBy(F.col(f"l.{x}").alias("_x"), F.col(f"l.{y}").alias("_y")).agg(F.collect_list(F.struct("r", "distance", "rank")).alias("_near"))
    points = left.select(F.struct("*").alias("l"), *place)
    return points.join(lists, ["_x", "_y"]).select("l", F.explode("_near").alias("_one")).select("l", "_one.r", "_one.distance", "_one.rank")


def asof_join(left: DataFrame, right: DataFrame, by: list[str], on: str, right_columns: list[str], tolerance_seconds: float | None = None) -> DataFrame:
    """The latest right row at or before each left row's time, by one window over the union of both."""
    cols = {c: dict(right.dtypes)[c] for c in right_columns}
    a = left.withColumn("_right", F.lit(None).cast(f"struct<_t:{dict(right.dtypes)[on]},{','.join(f'{c}:{t}' for c, t in cols.items())}>")).withColumn("_side", F.lit(1))
    b = right.select(*by, on, F.struct(F.col(on).alias("_t"), *right_columns).alias("_right")).withColumn("_side", F.lit(0))
    w = W.partitionBy(*by).orderBy(on, "_side").rowsBetween(W.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_right", F.last("_right", ignorenulls=True).over(w)).where("_side = 1")
    fits = F.lit(True) if tolerance_seconds is None else (micros(on) - micros("_right._t")) <= F.lit(int(tolerance_seconds * 1e6))
    return both.select(*left.columns, *[F.when(fits, F.col(f"_right.{c}")).alias(f"right_{c}") for c in right_columns])


__all__ = ["BOX", "asof_join", "box_join", "knn_join", "radius_join"]
