"""Learning on pixels with pyspark.ml, and density operators by range joins.

Pixels are wide rows with band columns.  Rows with NaN or null take no part in a fit and come back
with a null prediction.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import valid


def features(df: DataFrame, bands: list[str], out: str = "features") -> DataFrame:
    """Rows with all bands valid, with a vector column."""
    from pyspark.ml.feature import VectorAssembler

    ok = reduce(lambda a, b: a & b, [valid(F.col(b).cast("double")).isNotNull() for b in bands])
    return VectorAssembler(inputCols=bands, outputCol=out).transform(df.where(ok))


class MLOperator:
    """An estimator of pyspark.ml on band columns: fit(), transform(), and a call that does both."""

    def __init__(self, bands: list[str], keys: list[str], out: str = "prediction", **params):
        self.bands, self.keys, self.out, self.params, self.model = bands, keys, out, params, None

    def estimator(self):
        raise NotImplementedError

    def fit(self, df: DataFrame) -> "MLOperator":
        self.model = self.estimator().fit(features(df, self.bands))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(features(df, self.bands))

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)


class KMeans(MLOperator):
    def estimator(self):
        from pyspark.ml.clustering import KMeans as Own

        return Own(k=self.params.get("k", 3), seed=self.params.get("seed", 0), featuresCol="features", predictionCol=self.out)


class MiniBatchKMeans(KMeans):
    """Lloyd's algorithm here: each round is one distributed pass, so batches gain nothing."""


class GMM(MLOperator):
    def estimator(self):
        from pyspark.ml.clustering import GaussianMixture

        return GaussianMixture(k=self.params.get("k", 2), seed=self.params.get("seed", 0), featuresCol="features", predictionCol=self.out, probabilityCol=f"{self.out}_probability")


class PCA(MLOperator):
    """Scores of centred bands."""

    def estimator(self):
        from pyspark.ml import Pipeline
        from pyspark.ml.feature import PCA as Own
        from pyspark.ml.feature import StandardScaler

        return Pipeline(stages=[StandardScaler(withMean=True, withStd=False, inputCol="features", outputCol="_centred"), Own(k=self.params.get("k", 2), inputCol="_centred", outputCol=self.out)])


IPCA = PCA


class NMF:
    """Non-negative factors of the pixel x band matrix by multiplicative updates; only band x rank and rank x rank sums reach the driver."""

    def __init__(self, bands: list[str], rank: int = 2, rounds: int = 50, seed: int = 0):
        self.bands, self.rank, self.rounds, self.seed = bands, rank, rounds, seed

    def fit(self, df: DataFrame) -> np.ndarray:
        from .background import gram

        n = len(self.bands)
        arr = df.select(F.array(*[F.greatest(F.col(b).cast("double"), F.lit(0.0)) for b in self.bands]).alias("bands"))
        _, _, g = gram(arr, n)  # X'X is all that the factor of the bands needs when the pixels' factor is X H' (H H')^-1
        h = np.random.default_rng(self.seed).random((self.rank, n)) + 0.1
        for _ in range(self.rounds):
            p = np.linalg.pinv(h @ h.T) @ h
            h *= np.maximum(p @ g, 0) / np.maximum(p @ g @ p.T @ h, 1e-12)
        return h

    def scores(self, h: np.ndarray) -> Column:
        p = np.linalg.pinv(h @ h.T) @ h
        return F.array(*[F.greatest(sum((F.col(b) * float(w) for b, w in zip(self.bands, row, strict=True)), F.lit(0.0)), F.lit(0.0)) for row in p])


def isolation_forest(df: DataFrame, bands: list[str], trees: int = 50, sample: int = 256, seed: int = 0) -> DataFrame:
    """`anomaly` in (0, 1) by random trees grown on the driver from a bounded sample (trees x sample rows at most)."""
    rows = df.select(*bands).where(reduce(lambda a, b: a & b, [valid(F.col(b).cast("double")).isNotNull() for b in bands])).orderBy(F.xxhash64(F.lit(seed), *bands)).limit(sample * 4).collect()
    x, r = np.array([list(t) for t in rows], float), np.random.default_rng(seed)

    def grow(x, depth, most):
        if len(x) <= 1 or depth >= most or (x.max(0) == x.min(0)).all():
            return len(x), depth
        k = r.choice(np.flatnonzero(x.max(0) > x.min(0)))
        cut = r.uniform(x[:, k].min(), x[:, k].max())
        return k, cut, grow(x[x[:, k] < cut], depth + 1, most), grow(x[x[:, k] >= cut], depth + 1, most)

    c = lambda n: 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n
    size = min(sample, len(x))
    forest = [grow(x[r.choice(len(x), size, replace=False)], 0, int(np.ceil(np.log2(max(size, 2))))) for _ in range(trees)] if len(x) else []

    def depth(node, m, idx, out):
        if len(node) == 2:
            out[idx] += node[1] + c(node[0])
            return
        k, cut, left, right = node
        low = m[idx, k] < cut
        depth(left, m, idx[low], out)
        depth(right, m, idx[~low], out)

    @F.pandas_udf("double")
    def score(*cols):
        import pandas as pd

        m = np.stack([col.to_numpy(float) for col in cols], 1)
        total = np.zeros(len(m))
        for t in forest:
            depth(t, m, np.arange(len(m)), total)
        return pd.Series(2 ** (-total / max(len(forest), 1) / max(c(size), 1e-12)))

    return df.withColumn("anomaly", score(*bands))


def local_outlier_factor(points: DataFrame, k: int = 5, radius: float = 2.0) -> DataFrame:
    """(id, lof) of points (id, px, py): mean reachability density of the k nearest over the point's own."""
    from ..checkpoints import stash
    from .joins import knn_join

    near = knn_join(points, points, k + 1, radius).select(F.col("l.id").alias("id"), F.col("r.id").alias("other"), "distance").where("id <> other")
    near = stash(near, "near")
    kth = near.groupBy("id").agg(F.max("distance").alias("kd"))
    reach = near.join(kth.select(F.col("id").alias("other"), "kd"), "other").withColumn("rd", F.greatest("distance", "kd"))
    lrd = stash(reach.groupBy("id").agg((F.count("*") / F.greatest(F.sum("rd"), F.lit(1e-12))).alias("lrd")), "lrd")
    other = near.join(lrd.select(F.col("id").alias("other"), F.col("lrd").alias("o")), "other").groupBy("id").agg(F.avg("o").alias("o"))
    return other.join(lrd, "id").select("id", (F.col("o") / F.col("lrd")).alias("lof"))


def model_op(df: DataFrame, fn, bands: list[str], out: str = "prediction", kind: str = "double") -> DataFrame:
    """A function of a (rows, bands) array applied to Arrow batches."""
    @F.pandas_udf(kind)
    def run(*cols):
        import pandas as pd

        return pd.Series(fn(np.stack([c.to_numpy(float) for c in cols], 1)))

    return df.withColumn(out, run(*bands))
