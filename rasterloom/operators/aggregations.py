"""Merging overlapping patches into cells: each aggregation is a list of aggregates and how to finish them.

Patch rows have y, x, v and weight (and group columns).  merge() groups them by cell and joins the
domain's cells, so that those without a patch get the aggregation's own fill value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.numeric import uniform, valid

NAN, INF = float("nan"), float("inf")


def _v() -> Column:
    return F.col("v")


def _w() -> Column:
    return F.col("weight")


class Aggregation:
    """columns: name -> (aggregate, fill of cells without patches); streaming_safe: its state is small and merges."""

    streaming_safe = True

    def columns(self) -> dict[str, tuple[Column, float | None]]:
        raise NotImplementedError

    def merge(self, patches: DataFrame, domain: DataFrame | None = None, by=("y", "x")) -> DataFrame:
        cols = self.columns()
        out = patches.groupBy(*by).agg(*[c.alias(k) for k, (c, _) in cols.items()])
        if domain is not None:
            out = domain.select(*by).join(out, list(by), "left")
        return out.select(*by, *[(F.col(k) if fill is None else F.coalesce(k, F.lit(fill))).alias(k) for k, (_, fill) in cols.items()])


class SpatialSum(Aggregation):
    """NaN counts as 0."""

    def columns(self):
        return {"v": (F.sum(F.coalesce(valid(_v()), F.lit(0.0))), 0.0)}


class SpatialMax(Aggregation):
    def columns(self):
        return {"v": (F.max(valid(_v())), -INF)}


class SpatialMin(Aggregation):
    def columns(self):
        return {"v": (F.min(valid(_v())), INF)}


class SpatialWeightedSum(Aggregation):
    """Not normalised; weight is the window's, or a column function's of (v, weight)."""

    def __init__(self, weight: Callable[[Column, Column], Column] | None = None):
        self.weight = weight

    def columns(self):
        w = self.weight(_v(), _w()) if self.weight else _w()
        return {"v": (F.sum(F.coalesce(valid(_v() * w), F.lit(0.0))), 0.0)}


class SpatialMean(Aggregation):
    def columns(self):
        return {"v": (F.avg(valid(_v())), 0.0)}


class SpatialVariance(Aggregation):
    """Of the sample; 0 for one value or none."""

    def columns(self):
        return {"v": (F.when(F.count(valid(_v())) > 1, F.var_samp(valid(_v()))), 0.0)}


class SpatialOverlapAdd(Aggregation):
    """Weighted mean of valid values, 0 where the weights sum to 0; or the weighted sum."""

    def __init__(self, normalize: bool = True):
        self.normalize = normalize

    def columns(self):
        x = valid(_v())
        w = F.sum(F.when(x.isNotNull(), _w()))
        return {"v": (F.when(w > 0, F.sum(x * _w()) / w) if self.normalize else F.sum(x * _w()), 0.0)}


class SpatialInvVarWeightedMean(Aggregation):
    """Of v with its own variance `var`: mean and variance; without patches 0 and infinity."""

    def columns(self):
        w = _w() / F.col("var")
        return {"v": (F.sum(_v() * w) / F.sum(w), 0.0), "var": (1 / F.sum(w), INF)}


class SpatialMedian(Aggregation):
    streaming_safe = False

    def columns(self):
        return {"v": (F.median(valid(_v())), NAN)}


class SpatialMode(Aggregation):
    """The most frequent value, of equally frequent ones the smallest."""

    streaming_safe = False

    def columns(self):
        return {"v": (F.mode(valid(_v()), True), 0.0)}


class _Vote(Aggregation):
    def score(self) -> Column:
        raise NotImplementedError

    def merge(self, patches, domain=None, by=("y", "x")):
        one = patches.groupBy(*by, "label").agg(self.score().alias("_s"))
        best = one.groupBy(*by).agg(F.min_by("label", F.struct(-F.col("_s"), F.col("label"))).alias("v"))
        if domain is not None:
            best = domain.select(*by).join(best, list(by), "left")
        return best.select(*by, F.coalesce("v", F.lit(0)).alias("v"))


class SpatialHardVote(_Vote):
    """Rows have a label; the most frequent one, of equal ones the lowest."""

    def score(self):
        return F.count("*").cast("double")


class SpatialSoftVote(_Vote):
    """Rows have label and v, its probability; the label of the largest sum, of equal ones the lowest."""

    def score(self):
        return F.sum(_v())


class SpatialApproxQuantile(Aggregation):
    def __init__(self, q: float = 0.5, accuracy: int = 200):
        self.q, self.accuracy = q, accuracy

    def columns(self):
        return {"v": (F.percentile_approx(valid(_v()), self.q, self.accuracy), NAN)}


class SpatialApproxCardinality(Aggregation):
    def __init__(self, error: float = 0.01):
        self.error = error

    def columns(self):
        return {"v": (F.approx_count_distinct(valid(_v()), self.error), 0)}


class SpatialApproxMode(Aggregation):
    def __init__(self, k: int = 16):
        self.k = k

    def columns(self):
        return {"v": (F.call_function("approx_top_k", valid(_v()), F.lit(self.k)), None)}


class SpatialStreamingHistogram(Aggregation):
    def __init__(self, bins: int = 64):
        self.bins = bins

    def columns(self):
        return {"v": (F.histogram_numeric(valid(_v()), F.lit(self.bins)), None)}


class SpatialReservoir:
    """k values, those with the smallest hash of key and seed: a uniform sample however rows are dealt out."""

    def __init__(self, k: int = 100, seed: int = 0):
        self.k, self.seed = k, seed

    def reduce(self, patches: DataFrame, *key: str) -> DataFrame:
        return patches.withColumn("_u", uniform(self.seed, *key)).orderBy("_u", *key).limit(self.k).drop("_u")


class SpatialByIndex:
    """No merge: the value of each anchor and cell, of repeated ones that of the largest order."""

    def merge(self, patches: DataFrame, order: str, by=("anchor", "y", "x")) -> DataFrame:
        return patches.groupBy(*by).agg(F.max_by("v", order).alias("v"))


class SpatialLearned:
    """A function of a group's pandas rows; by default one group for each scene."""

    def __init__(self, fn, schema: str, by=("scene",)):
        self.fn, self.schema, self.by = fn, schema, by

    def merge(self, patches: DataFrame) -> DataFrame:
        return patches.groupBy(*self.by).applyInPandas(self.fn, self.schema)


def mean_std(patches: DataFrame) -> DataFrame:
    """Over all values of all patches; NaN is not skipped."""
    return patches.agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"))


def min_max(patches: DataFrame, anchor: str = "anchor") -> DataFrame:
    """Over the patches without NaN."""
    each = patches.groupBy(anchor).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.bool_or(F.isnan("v")).alias("nan")).where("not nan")
    return each.agg(F.min("lo").alias("min"), F.max("hi").alias("max"))


def two_pass(patches: DataFrame, stats: dict[str, Column], apply: Callable[..., Column], aggregation: Aggregation, domain: DataFrame | None = None) -> DataFrame:
    """Global statistics, then apply(v, statistics...), then the aggregation; the statistics are one row."""
    one = patches.agg(*[c.alias(f"_{k}") for k, c in stats.items()])
    both = patches.join(F.broadcast(one)).withColumn("v", apply(_v(), *[F.col(f"_{k}") for k in stats])).drop(*[f"_{k}" for k in stats])
    return aggregation.merge(both, domain)


def hll_merge(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mergeable distinct counts: a sketch for each group, and their union's estimate."""
    sketches = df.groupBy(*by).agg(F.hll_sketch_agg(value).alias("sketch"))
    return sketches.agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n"))


# time ---------------------------------------------------------------------------------------------------------------


def temporal_mean(patches: DataFrame, by=("k",)) -> DataFrame:
    """Mean across patches of each place in the window; NaN is not skipped."""
    return patches.groupBy(*by).agg(F.avg("v").alias("v"))


def temporal_forecast(patches: DataFrame, horizon: int = 1, anchor: str = "anchor") -> DataFrame:
    """The last `horizon` steps of each anchor, oldest first."""
    w = W.partitionBy(anchor).orderBy(F.desc("t"))
    return patches.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= horizon).drop("_n")


def hierarchical(patches: DataFrame, anchor: str = "anchor") -> DataFrame:
    """(anchor, scales): for each scale its values in the order of time."""
    one = patches.groupBy(anchor, "scale").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "v"))), lambda s: s["v"]).alias("v"))
    return one.groupBy(anchor).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("scale", "v")))).alias("scales"))


def temporal_fold(df: DataFrame, by: list[str], initial: Column, step: Callable[[Column, Column], Column], t: str = "t", v: str = "v") -> DataFrame:
    """A left fold over each group's values in the order of time, by a column function."""
    ordered = F.array_sort(F.collect_list(F.struct(t, v)))
    return df.groupBy(*by).agg(ordered.alias("_s")).select(*by, F.aggregate("_s", initial, lambda acc, s: step(acc, s[v])).alias("v"))
