"""A catalogue of files by place and time: lazy, one DataFrame.

Columns: filepath, start_time, end_time (closed interval), xmin, ymin, xmax, ymax, and others.  On disk the
box is the struct `bbox`, on which filters reach the Parquet scan.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.boxes import BOX, curve_key, from_mercator, to_mercator
from ..operators.joins import box_join

SCHEMA_VERSION = 0
RESERVED = ("filepath", "start_time", "end_time", "geometry", "bbox", *BOX)


class CatalogMetadataError(ValueError):
    """The archive does not say what a strict open needs."""


class CatalogSchemaError(ValueError):
    """The archive's schema versions are mixed, missing or newer."""


class Catalog:
    def __init__(self, df: DataFrame, crs: str = "EPSG:4326", backend: str = "raster"):
        self.df, self.crs, self.backend = df, crs, backend

    def _with(self, df: DataFrame) -> "Catalog":
        return Catalog(df, self.crs, self.backend)

    def query(self, slice_=None, *, bounds=None, crs: str | None = None, time=None) -> "Catalog":
        """Rows whose box touches the bounds and whose interval overlaps `time`; what is not given does not filter."""
        if slice_ is not None:
            if bounds is not None or time is not None:
                raise TypeError("give a slice, or bounds and time")
            bounds, crs, time = slice_.bounds, slice_.crs, slice_.interval
        df = self.df
        if bounds is not None:
            x0, y0, x1, y1 = reproject_bounds(df.sparkSession, bounds, crs or self.crs, self.crs)
            df = df.where((F.col("xmin") <= x1) & (F.col("xmax") >= x0) & (F.col("ymin") <= y1) & (F.col("ymax") >= y0))
        if time is not None:
            lo, hi = (F.lit(t).cast("timestamp") for t in time)
            df = df.where((F.col("end_time") >= lo) & (F.col("start_time") <= hi))
        return self._with(df)

    def intersect(self, other: "Catalog", *, spatial_only: bool = False, drop_touching: bool = True, cell: float | None = None, days: float = 32.0) -> "Catalog":
        """Pairs of rows that overlap: common box, common interval (the left one's if spatial_only), the right one's columns as _right_*.

        Boxes that only touch are dropped unless drop_touching is false.
        """
        pairs = box_join(self.df, other.df, cell=cell, days=None if spatial_only else days)
        low = [F.greatest(f"l.{c}", f"r.{c}").alias(c) for c in BOX[:2]]
        high = [F.least(f"l.{c}", f"r.{c}").alias(c) for c in BOX[2:]]
        when = [F.col("l.start_time"), F.col("l.end_time")] if spatial_only else [F.greatest("l.start_time", "r.start_time").alias("start_time"), F.least("l.end_time", "r.end_time").alias("end_time")]
        own = [c for c in self.df.columns if c not in (*BOX, "start_time", "end_time")]
        theirs = [c for c in other.df.columns if c not in (*BOX, "start_time", "end_time")]
        out = pairs.select(*[F.col(f"l.{c}") for c in own], *low, *high, *when, *[F.col(f"r.{c}").alias(f"_right_{c}") for c in theirs])
        if drop_touching:
            out = out.where("xmin < xmax and ymin < ymax")
        return self._with(out)

    def union(self, other: "Catalog") -> "Catalog":
        """All rows of both, by column name; missing columns are null."""
        return self._with(self.df.unionByName(other.df, allowMissingColumns=True))

    def where(self, text: str) -> "Catalog":
        return self._with(self.df.where(text))

    sql = where

    def total_bounds(self) -> DataFrame:
        """One row; NaN if there are no rows."""
        nan = F.lit(float("nan"))
        return self.df.agg(*[F.coalesce(f(c), nan).alias(c) for f, c in ((F.min, "xmin"), (F.min, "ymin"), (F.max, "xmax"), (F.max, "ymax"))])

    def temporal_extent(self) -> DataFrame:
        return self.df.agg(F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"))

    def count(self) -> int:
        return self.df.count()

    __len__ = count

    def stats(self) -> DataFrame:
        """Rows, bounds and extent in one pass."""
        return self.df.agg(F.count("*").alias("n"), F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"), F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"))

    def slices(self, resolution: tuple[float, float]) -> DataFrame:
        """A slice for each row, with its shape in pixels."""
        rx, ry = resolution
        return self.df.select("filepath", *BOX, "start_time", "end_time", F.rint((F.col("ymax") - F.col("ymin")) / ry).cast("long").alias("height"), F.rint((F.col("xmax") - F.col("xmin")) / rx).cast("long").alias("width"))

    def iter_rows(self, batch_size: int = 10_000) -> Iterator[dict]:
        """Rows one after another, a partition at a time; columns that start with _ are left out."""
        if batch_size < 1:
            raise ValueError("batch_size must be positive")
        for row in self.df.toLocalIterator(prefetchPartitions=True):
            d = row.asDict()
            yield {"filepath": d["filepath"], "bounds": tuple(d[c] for c in BOX), "interval": (d["start_time"], d["end_time"]), "crs": self.crs, "extras": {k: v for k, v in d.items() if k not in RESERVED and not k.startswith("_")}}

    def row(self, i: int) -> DataFrame:
        """The i-th row in the order of filepath."""
        return self.df.orderBy("filepath", "start_time").offset(i).limit(1)

    def materialize(self) -> "Catalog":
        return self._with(self.df.persist())

    def config(self) -> dict:
        return {"backend": self.backend, "crs": self.crs, "columns": self.df.columns}

    def write(self, path: str, *, partition_by: list[str] | None = None, sort: bool = True, mode: str = "overwrite") -> None:
        """Parquet with the box as a struct, sorted within files by start and place on a Hilbert curve; year, month and day of the start may be partitions."""
        parts = partition_by or []
        df = self.df.drop("geometry", "bbox")
        derived = {"year": F.year, "month": F.month, "day": F.dayofmonth}
        for c in parts:
            if c in derived and c not in df.columns:
                df = df.withColumn(c, derived[c]("start_time"))
            elif dict(df.dtypes)[c] == "string":
                df = df.withColumn(c, F.regexp_replace(c, r"[/\\=]", "_"))
        df = df.withColumn("bbox", F.struct(*BOX)).withColumn("_backend", F.lit(self.backend)).withColumn("_schema_version", F.lit(SCHEMA_VERSION))
        if sort:
            key = curve_key((F.col("xmin") + F.col("xmax")) / 2, (F.col("ymin") + F.col("ymax")) / 2)
            df = df.withColumn("_hilbert", key)
            df = df.repartitionByRange(*parts, "start_time", "_hilbert").sortWithinPartitions(*parts, "start_time", "_hilbert").drop("_hilbert")
        df.drop(*BOX).write.mode(mode).partitionBy(*parts).parquet(path)
        meta = json.dumps({"crs": self.crs, "backend": self.backend, "version": SCHEMA_VERSION, "partition_by": parts})
        df.sparkSession.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_catalog")

    to_geoparquet = write

    def append(self, path: str, *, partition_by: list[str] | None = None) -> None:
        """More rows for an archive; its partitions must be the same."""
        meta = _metadata(self.df.sparkSession, path)
        if meta is not None and meta["partition_by"] != (partition_by or []):
            raise ValueError(f"the archive is partitioned by {meta['partition_by']}")
        self.write(path, partition_by=partition_by, mode="append")


def _metadata(spark: SparkSession, path: str) -> dict | None:
    """What write() noted beside the rows; None for archives that have no such file."""
    meta = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_catalog")
    if any(c in path for c in "*?[{") or not meta.getFileSystem(spark._jsc.hadoopConfiguration()).exists(meta):
        return None
    rows = spark.read.text(f"{path}/_catalog").limit(1).collect()
    return json.loads(rows[0][0]) if rows else None


def open_catalog(spark: SparkSession, source: str, *, backend: str | None = None, crs: str | None = None, strict: bool = False) -> Catalog:
    """A file, directory, glob or partitioned archive; strict: CRS and backend must be known."""
    df = spark.read.parquet(source)
    meta = _metadata(spark, source)
    if strict and crs is None and (meta is None or "crs" not in meta):
        raise CatalogMetadataError("the archive names no CRS")
    if "_schema_version" in df.columns:
        lo, hi, n, some = df.agg(F.min("_schema_version"), F.max("_schema_version"), F.count("*"), F.count("_schema_version")).first()
        if n and (some != n or lo != hi or hi > SCHEMA_VERSION):
            raise CatalogSchemaError(f"schema versions {lo} to {hi}, null in {n - some} rows")
    if backend is None and "_backend" in df.columns:
        row = df.select("_backend").limit(1).collect()
        backend = row[0][0] if row else None
    if backend is None:
        if strict:
            raise CatalogMetadataError("the archive names no backend")
        backend = "raster"
    if "bbox" in df.columns:
        df = df.select("*", *[F.col(f"bbox.{c}").alias(c) for c in BOX]).drop("bbox")
    return Catalog(df.drop("_backend", "_schema_version"), crs or (meta or {}).get("crs", "EPSG:4326"), backend)


from_geoparquet = open_catalog


def migrate(spark: SparkSession, source: str, to: str, *, to_version: int = SCHEMA_VERSION) -> None:
    """Rewrites an archive at a newer version; there is one version, so the rows stay as they are."""
    if to_version != SCHEMA_VERSION:
        raise CatalogSchemaError(f"no way to version {to_version}")
    open_catalog(spark, source).write(to)


def reproject_bounds(spark: SparkSession, bounds, crs: str, to: str) -> tuple[float, ...]:
    """Bounds in another CRS, from the box's corners and edge middles; EPSG:4326 and EPSG:3857."""
    if crs == to:
        return tuple(map(float, bounds))
    ways = {("EPSG:4326", "EPSG:3857"): to_mercator, ("EPSG:3857", "EPSG:4326"): from_mercator}
    if (crs, to) not in ways:
        raise ValueError(f"no projection from {crs} to {to}")
    x0, y0, x1, y1 = map(float, bounds)
    points = [(x, y) for x in (x0, (x0 + x1) / 2, x1) for y in (y0, (y0 + y1) / 2, y1)]
    x, y = ways[crs, to](F.col("x"), F.col("y"))
    r = spark.createDataFrame(points, "x double, y double").select(x.alias("x"), y.alias("y")).agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    return tuple(r)


def from_filenames(paths: DataFrame, pattern: str, boxes: DataFrame, *, date_format: str = "yyyyMMdd", crs: str = "EPSG:4326", backend: str = "raster") -> Catalog:
    """A catalogue from paths (filepath) and their boxes (filepath, xmin ..): the pattern's first group is a day, and with a second one the last day.

    Paths that do not match are left out; an empty pattern gives 1900 to 2100.  A day ends a microsecond before the next.
    """
    df = paths.join(boxes, "filepath")
    if not pattern:
        lo, hi = F.lit("1900-01-01").cast("timestamp"), F.lit("2100-01-01").cast("timestamp")
    else:
        df = df.where(F.col("filepath").rlike(pattern))
        day = lambda k: F.to_timestamp(F.regexp_extract("filepath", pattern, k), date_format)
        lo = F.date_trunc("day", day(1))
        last = day(2) if pattern.count("(") - pattern.count("(?:") > 1 else day(1)
        hi = F.date_trunc("day", last) + F.expr("interval 1 day - interval 1 microsecond")
    return Catalog(df.withColumn("start_time", lo).withColumn("end_time", hi), crs, backend)
