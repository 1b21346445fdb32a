"""Matching a primary table with secondary ones, by role, in space and time.

The order of the steps is part of the result: boxes that touch are candidates, the temporal rule
chooses among these, and the exact spatial rule comes last.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import boxes
from ..functions.numeric import micros
from .joins import box_join, extent
from .nearest import grids, nearest_in_time


class SpatialRule:
    def column(self, a, b) -> Column:
        raise NotImplementedError


class Intersects(SpatialRule):
    """Boxes with a point in common."""

    def column(self, a, b):
        return boxes.touches(a, b)


@dataclass
class IouAtLeast(SpatialRule):
    threshold: float

    def __post_init__(self):
        if not 0 <= self.threshold <= 1:
            raise ValueError("threshold is from 0 to 1")

    def column(self, a, b):
        return boxes.iou(a, b) >= self.threshold


@dataclass
class CentroidWithin(SpatialRule):
    buffer: float = 0.0

    def column(self, a, b):
        return boxes.centroid_within(a, b, self.buffer)


class Contains(SpatialRule):
    """The secondary inside the primary."""

    def column(self, a, b):
        return boxes.contains(a, b)


class TemporalRule:
    """A condition on l and r, which have their intervals and their midpoints as mid; `nearest` keeps one candidate for each primary."""

    nearest = False

    def column(self) -> Column:
        raise NotImplementedError

    def reach(self) -> tuple[float, float]:
        """Seconds by which a primary's interval is widened before and after, so that all that can match overlaps it."""
        raise NotImplementedError


def midpoint(prefix: str = "") -> Column:
    return (micros(f"{prefix}start_time") + micros(f"{prefix}end_time")) / 2 / 1e6


@dataclass
class NearestInTime(TemporalRule):
    """The candidate of the nearest midpoint, at most `seconds` away; ties go to the smallest id."""

    seconds: float
    nearest = True

    def column(self):
        return F.abs(F.col("l.mid") - F.col("r.mid")) <= self.seconds

    def reach(self):
        return self.seconds, self.seconds


@dataclass
class WithinWindow(TemporalRule):
    """Midpoints from start to end seconds after the primary's."""

    start: float
    end: float

    def column(self):
        return (F.col("r.mid") - F.col("l.mid")).between(self.start, self.end)

    def reach(self):
        return max(-self.start, 0.0), max(self.end, 0.0)


@dataclass
class Synchronous(TemporalRule):
    """Closed intervals that overlap, the primary's widened by a tolerance in seconds."""

    tolerance: float = 0.0

    def column(self):
        t = int(self.tolerance * 1e6)
        return (micros("l.start_time") - t <= micros("r.end_time")) & (micros("l.end_time") + t >= micros("r.start_time"))

    def reach(self):
        return self.tolerance, self.tolerance


def matchup(primary: DataFrame, secondary: dict[str, DataFrame], *, spatial: SpatialRule, temporal: TemporalRule, join: str = "all", cell: float | None = None, tag: str | None = None) -> DataFrame:
    """Rows of member_ids, member_roles and time_offset_sec (in the order primary, roles), the common box and time_reference.

    Tables have id, xmin .. ymax, start_time, end_time.  "all": every role must match; "any": one at least, and
    roles without a match are left out of the row.  Ids are unique; `cell` is the grid's width, which changes no result.  Several matches of several roles give all combinations.
    """
    if join not in ("all", "any"):
        raise ValueError("join is all or any")
    reach = getattr(spatial, "buffer", 0.0) or 0.0
    base = primary.select("id", *boxes.BOX, "start_time", "end_time")
    out = base.select(F.struct("*").alias("p"))
    widths = grids(out, reach) if temporal.nearest else []
    for k, (role, df) in enumerate(secondary.items()):
        theirs = df.select("id", *boxes.BOX, "start_time", "end_time")
        if temporal.nearest:
            out = nearest_in_time(out, theirs, temporal.seconds, f"s_{role}", widths=widths, reach=reach, only=join == "all")
            near = spatial.column(boxes.box("p."), boxes.box(f"s_{role}."))
            out = out.where(near) if join == "all" else out.withColumn(f"s_{role}", F.when(near, F.col(f"s_{role}")))
            continue
        before, after = temporal.reach()
        moved = lambda c, s: F.timestamp_micros(micros(c) + F.lit(int(s * 1e6)))
        wide = base.select(F.struct("*", midpoint().alias("mid")).alias("_own"), *[(F.col(c) + s * reach).alias(c) if reach else c for c, s in zip(boxes.BOX, (-1, -1, 1, 1), strict=True)], moved("start_time", -before).alias("start_time"), moved("end_time", after).alias("end_time"))
        # time buckets a few times as long as the intervals keep both copies of rows and candidates in proportion to what is near in time
        (side_a, days_a), (side_b, days_b) = extent(wide), extent(theirs)
        pairs = box_join(wide, theirs.withColumn("mid", midpoint()), cell=cell or (side_a + side_b) or 1.0, days=max((before + after) / 86_400, 2 * (days_a + days_b), 1.0))
        pairs = pairs.select(F.col("l._own").alias("l"), "r").where(temporal.column())
        if not isinstance(spatial, Intersects):
            # a number of the row keeps the rule out of the join's condition: there it makes a method too long for the JVM to compile
            pairs = pairs.where(F.when(F.monotonically_increasing_id() >= 0, spatial.column(boxes.box("l."), boxes.box("r."))))
        if k == 0 and join == "all":
            # a pair has all of its primary row
            out = pairs.select(F.col("l").alias("p"), F.col("r").alias(f"s_{role}"))
            continue
        hit = pairs.select(F.col("l.id").alias("_id"), F.col("r").alias(f"s_{role}"))
        out = out.join(hit, F.col("p.id") == F.col("_id"), "inner" if join == "all" else "left").drop("_id")
    roles = list(secondary)
    if join == "any":
        some = F.lit(False)
        for r in roles:
            some = some | F.col(f"s_{r}").isNotNull()
        out = out.where(some)
    present = lambda r: F.col(f"s_{r}").isNotNull()
    offset = lambda r: midpoint(f"s_{r}.") - midpoint("p.")
    members = lambda first, of: F.array_compact(F.array(first, *[F.when(present(r), of(r)) for r in roles]))
    corner = lambda c, f: f(F.col(f"p.{c}"), *[F.col(f"s_{r}.{c}") for r in roles])
    ids = members(F.col("p.id"), lambda r: F.col(f"s_{r}.id"))
    return out.select(
        F.sha2(F.concat_ws("|", ids.cast("array<string>")), 256).alias("matchup_id"),
        F.lit(f"{type(spatial).__name__}+{type(temporal).__name__}").alias("strategy"),
        ids.alias("member_ids"),
        members(F.lit("primary"), lambda r: F.lit(r)).alias("member_roles"),
        members(F.lit(0.0), offset).alias("time_offset_sec"),
        *[corner(c, F.greatest).alias(c) for c in boxes.BOX[:2]],
        *[corner(c, F.least).alias(c) for c in boxes.BOX[2:]],
        F.timestamp_micros(((micros("p.start_time") + micros("p.end_time")) / 2).cast("long")).alias("time_reference"),
        F.lit(tag).alias("query_set"),
    )
