"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or, where that is unset and there is one machine only (tests), a new local folder."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="rasterloom-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


#: Lists of paths of the scopes that are open, innermost last.
_scopes: list[list[str]] = []


@contextmanager
def scope() -> Iterator[list[str]]:
    """Paths of the intermediate tables made inside, for remove() once nothing reads them."""
    own: list[str] = []
    _scopes.append(own)
    try:
        yield own
    finally:
        _scopes.remove(own)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/rasterloom/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def remove(spark: SparkSession, paths: list[str], needed: DataFrame | None = None) -> list[str]:
    """Removes intermediate tables but for those that `needed` reads, which are returned; other plans over them can no longer be run."""
    files = needed.inputFiles() if needed is not None else []
    sc, kept = spark.sparkContext, []
    for path in paths:
        name = path.rpartition("/")[2]
        if any(name in f for f in files):
            kept.append(path)
            continue
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
    return kept


#: Whether shuffle files go when the query that made them has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: the lineage ends there, a lost executor loses nothing, and the shuffle files go."""
    spark = df.sparkSession
    path, was = scratch(spark, name), spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, was)
    out = spark.read.schema(df.schema).parquet(path)
    out._stashed_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Removes tables as stash() returned them; plans over them can no longer be run."""
    for df in tables:
        remove(df.sparkSession, [df._stashed_at])
