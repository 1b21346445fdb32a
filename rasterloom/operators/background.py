"""Matched filters: backgrounds from one aggregation, a small solve on the driver, a linear expression on the pixels.

Pixels are wide rows whose column `bands` is an array of doubles.  Matrices are bands x bands.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import drop, stash


def to_arrays(cube: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, bands) from long rows (keys, band, v)."""
    return cube.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("band", "v"))), lambda s: s["v"]).alias("bands"))


def gram(df: DataFrame, n: int, bands: str = "bands") -> tuple[int, np.ndarray, np.ndarray]:
    """(count, sums, sums of products) in one pass with partial aggregation; rows with NaN or null are left out.

    Each partition adds up its own matrix, so what comes to the driver is a matrix per partition and then one.
    """
    def run(batches):
        import pyarrow as pa

        count, total, prod = 0, np.zeros(n), np.zeros((n, n))
        for b in batches:
            x = b.column(0)
            if not len(x):
                continue
            m = np.array(x.flatten().to_numpy(zero_copy_only=False), float).reshape(-1, n)
            m = m[np.isfinite(m).all(1)]
            count, total, prod = count + len(m), total + m.sum(0), prod + m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n * n + n + 1)), pa.array(np.concatenate([[count], total, prod.ravel()]))], ["i", "v"])

    parts = df.select(bands).where(F.col(bands).isNotNull()).mapInArrow(run, "i long, v double")
    rows = parts.groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    v = np.array([r.v for r in rows]) if rows else np.zeros(n * n + n + 1)
    return int(v[0]), v[1 : n + 1], v[n + 1 :].reshape(n, n)


def mean_cov(df: DataFrame, n: int, bands: str = "bands", ridge: float = 0.0) -> tuple[np.ndarray, np.ndarray, int]:
    count, total, prod = gram(df, n, bands)
    mean = total / max(count, 1)
    return mean, (prod - count * np.outer(mean, mean)) / max(count - 1, 1) + ridge * np.eye(n), count


def merge_gram(a, b):
    """The state of both; the same as one pass over all rows."""
    return a[0] + b[0], a[1] + b[1], a[2] + b[2]


def estimate_mean(df: DataFrame, by: list[str], v: str = "v", method: str = "mean", trim: float = 0.1) -> DataFrame:
    """Of each group: mean, median or the mean without the floor(trim * n) smallest and largest values."""
    from pyspark.sql import Window as W

    if method in ("mean", "median"):
        return df.groupBy(*by).agg((F.avg(v) if method == "mean" else F.median(v)).alias("mean"))
    w = W.partitionBy(*by)
    rows = df.withColumn("_r", F.row_number().over(w.orderBy(v))).withColumn("_n", F.count("*").over(w)).withColumn("_c", F.floor(F.col("_n") * trim))
    return rows.where((F.col("_r") > F.col("_c")) & (F.col("_r") <= F.col("_n") - F.col("_c"))).groupBy(*by).agg(F.avg(v).alias("mean"))


def huber_mean(df: DataFrame, by: list[str], v: str = "v", c: float = 1.345, rounds: int = 50, tol: float = 1e-6) -> DataFrame:
    """Reweighted means with the scale 1.4826 MAD (1 where that is 0), until the largest move is below `tol`; one row a group is written each round."""
    if c <= 0:
        raise ValueError("c is positive")
    med = df.groupBy(*by).agg(F.median(v).alias("m"))
    scale = df.join(med, by).groupBy(*by).agg((F.median(F.abs(F.col(v) - F.col("m"))) * 1.4826).alias("s"), F.first("m").alias("m"))
    scale = stash(scale.withColumn("s", F.when(F.col("s") > np.finfo(float).eps, F.col("s")).otherwise(F.lit(1.0))), "huber")
    for _ in range(rounds):
        z = F.greatest(F.abs(F.col(v) - F.col("m")) / F.col("s"), F.lit(float(np.finfo(float).eps)))
        w = F.least(F.lit(1.0), c / z)
        new = stash(df.join(scale, by).groupBy(*by).agg((F.sum(w * F.col(v)) / F.sum(w)).alias("m2"), F.first("m").alias("m"), F.first("s").alias("s")), "huber")
        move = new.agg(F.max(F.abs(F.col("m2") - F.col("m")))).first()[0]
        drop(scale)
        scale = stash(new.select(*by, F.col("m2").alias("m"), "s"), "huber")
        drop(new)
        if move is None or move < tol:
            break
    return scale.select(*by, F.col("m").alias("mean"))


def shrink_covariance(cov: np.ndarray, n: int, method: str = "oas") -> np.ndarray:
    """Towards its mean variance, by "oas" or "ledoit_wolf" from the covariance and the number of samples."""
    p, trace, square = len(cov), float(np.trace(cov)), float((cov * cov).sum())
    away = square - trace * trace / p
    if method == "oas":
        share = 1.0 if away <= 0 else min(1.0, ((1 - 2 / p) * square + trace**2) / ((n + 1) * away))
    elif method == "ledoit_wolf":
        share = 0.0 if away <= 0 else min(1.0, (square + trace**2 / p) / max(n, 1) / away)
    else:
        raise ValueError("method is oas or ledoit_wolf")
    return (1 - share) * cov + share * trace / p * np.eye(p)


def lowrank_covariance(cov: np.ndarray, rank: int = 10, tikhonov: float = 1e-3) -> np.ndarray:
    w, q = np.linalg.eigh(cov)
    w, q = w[-rank:], q[:, -rank:]
    return (q * w) @ q.T + tikhonov * np.eye(len(cov))


def validate(cov: np.ndarray, target: np.ndarray) -> None:
    if not np.any(target):
        raise ValueError("the target is zero")
    if np.linalg.eigvalsh(cov)[0] <= 0:
        raise ValueError("the covariance is not positive definite")


def filter_weights(mean: np.ndarray, cov: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, float, float]:
    """(weights, offset, gain): score = weights . x - offset."""
    s = np.linalg.solve(cov, target)
    gain = float(target @ s)
    w = s / gain
    return w, float(w @ mean), gain


def apply_filter(bands: Column, mean: np.ndarray, cov: np.ndarray, target: np.ndarray) -> Column:
    """(x - mean)' C^-1 t / (t' C^-1 t) as a dot product with literal weights."""
    w, offset, _ = filter_weights(mean, cov, target)
    lit = F.array(*[F.lit(float(k)) for k in w])
    return F.aggregate(F.zip_with(bands, lit, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x) - F.lit(offset)


def matched_filter_snr(amplitude: float, cov: np.ndarray, target: np.ndarray) -> float:
    return amplitude * math.sqrt(float(target @ np.linalg.solve(cov, target)))


def detection_threshold(false_alarm_rate: float, cov: np.ndarray, target: np.ndarray) -> float:
    return NormalDist().inv_cdf(1 - false_alarm_rate) / math.sqrt(float(target @ np.linalg.solve(cov, target)))


class MatchedFilter:
    """Estimates mean and covariance of all pixels, then scores them: two passes."""

    def __init__(self, target: np.ndarray, cov_method: str = "oas", ridge: float = 0.0):
        self.target, self.cov_method, self.ridge = np.asarray(target, float), cov_method, ridge

    def fit(self, df: DataFrame, bands: str = "bands") -> tuple[np.ndarray, np.ndarray]:
        mean, cov, n = mean_cov(df, len(self.target), bands, self.ridge)
        return mean, cov if self.cov_method == "empirical" else shrink_covariance(cov, n, self.cov_method)

    def __call__(self, df: DataFrame, bands: str = "bands", out: str = "score") -> DataFrame:
        return df.withColumn(out, apply_filter(F.col(bands), *self.fit(df, bands), self.target))


def cluster_filter(df: DataFrame, target: np.ndarray, label: str = "label", bands: str = "bands", ridge: float = 1e-3) -> DataFrame:
    """Each pixel by its cluster's background; the weights are a row for each cluster."""
    n = len(target)

    def run(batches):
        import pyarrow as pa

        sums: dict = {}
        for batch in batches:
            x = np.array(batch.column("bands").flatten().to_numpy(zero_copy_only=False), float).reshape(-1, n)
            of = batch.column("label").to_numpy(zero_copy_only=False)
            for k in np.unique(of):
                own = x[of == k]
                one = (len(own), own.sum(0), own.T @ own)
                sums[k] = merge_gram(sums[k], one) if k in sums else one
        for k, (c, s, p) in sums.items():
            flat = np.concatenate([[c], s, p.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), k)), pa.array(np.arange(len(flat))), pa.array(flat)], ["label", "i", "v"])

    # a partition adds up a matrix for each cluster, and partitions' matrices are added before they come to the driver
    parts = df.select(F.col(label).alias("label"), F.col(bands).alias("bands")).mapInArrow(run, f"label {dict(df.dtypes)[label]}, i long, v double")
    rows = parts.groupBy("label", "i").agg(F.sum("v").alias("v")).orderBy("label", "i").collect()
    flat: dict = {}
    for r in rows:
        flat.setdefault(r.label, []).append(r.v)
    state = {k: (f[0], np.array(f[1 : n + 1]), np.array(f[n + 1 :]).reshape(n, n)) for k, f in flat.items()}
    weights = []
    for k, (c, s, p) in state.items():
        mean = s / c
        cov = (p - c * np.outer(mean, mean)) / max(c - 1, 1) + ridge * np.eye(n)
        w, offset, _ = filter_weights(mean, cov, np.asarray(target, float))
        weights.append((k, w.tolist(), offset))
    table = df.sparkSession.createDataFrame(weights, f"{label} {dict(df.dtypes)[label]}, _w array<double>, _o double")
    dot = F.aggregate(F.zip_with(F.col(bands), F.col("_w"), lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x) - F.col("_o")
    return df.join(F.broadcast(table), label).withColumn("score", dot).drop("_w", "_o")


def pca(df: DataFrame, n: int, components: int, bands: str = "bands") -> tuple[np.ndarray, np.ndarray]:
    """(mean, axes): axes by falling variance; the largest entry of each is positive."""
    mean, cov, _ = mean_cov(df, n, bands)
    _, q = np.linalg.eigh(cov)
    q = q[:, ::-1][:, :components]
    return mean, q * np.sign(q[np.abs(q).argmax(0), np.arange(components)])


def project(bands: Column, mean: np.ndarray, axes: np.ndarray) -> Column:
    """Scores of the axes."""
    each = [F.aggregate(F.zip_with(bands, F.array(*[F.lit(float(a)) for a in axes[:, k]]), lambda x, a: x * a), F.lit(float(-mean @ axes[:, k])), lambda acc, x: acc + x) for k in range(axes.shape[1])]
    return F.array(*each)


def reconstruct(scores: Column, mean: np.ndarray, axes: np.ndarray) -> Column:
    return F.array(*[F.aggregate(F.zip_with(scores, F.array(*[F.lit(float(a)) for a in axes[b]]), lambda x, a: x * a), F.lit(float(mean[b])), lambda acc, x: acc + x) for b in range(len(mean))])


def linear_target(model, background: np.ndarray, amplitude: float = 1.0, step: float = 1e-4) -> np.ndarray:
    """Derivative of an observation model at a background, by finite differences."""
    return amplitude * (np.asarray(model(background + step)) - np.asarray(model(background))) / step


def nonlinear_target(model, background: np.ndarray, amplitude: float = 1.0) -> np.ndarray:
    return np.asarray(model(background + amplitude)) - np.asarray(model(background))
