"""Numbers: NaN and null, rounding, percentiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def valid(v: Column) -> Column:
    """Null for NaN, so that aggregates skip it."""
    return F.when(~F.isnan(v), v)


def clip(v: Column, low, high) -> Column:
    return F.least(F.greatest(v, F.lit(low)), F.lit(high))


def over(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def half_even(v: Column) -> Column:
    return F.rint(v)


def ratio_or(a: Column, b: Column, other=0.0) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(other))


def percentile(v: Column, share: float) -> Column:
    """Exact, with linear interpolation."""
    return F.percentile(valid(v), F.lit(share))


def tidy(v: Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(v.cast("double"), digits) + F.lit(0.0)


def uniform(seed: int, *keys) -> Column:
    """A number in [0, 1) that depends on the keys and the seed alone, however rows are dealt out."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11).cast("double") * F.lit(2.0**-53)


def normal(seed: int, *keys) -> Column:
    """Standard normal by Box and Muller from two uniform() numbers."""
    a, b = uniform(2 * seed + 1, *keys), uniform(2 * seed + 2, *keys)
    return F.sqrt(-2 * F.log(1 - a)) * F.cos(2 * F.pi() * b)


def micros(t) -> Column:
    """Microseconds since 1970 of a timestamp with or without a zone (the session's is UTC)."""
    return F.unix_micros((F.col(t) if isinstance(t, str) else t).cast("timestamp"))
