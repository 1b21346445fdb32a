"""Streams: incremental append of catalogue rows, and windows over event time.

stream_of() reads a growing folder; every function here takes streaming and static DataFrames alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_of(spark: SparkSession, path: str, schema, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tumbling(events: DataFrame, length: str, by: list[str], late: str = "10 minutes", ts: str = "ts", v: str = "value") -> DataFrame:
    """Count and sum for each window and key; rows later than the watermark are dropped in a stream."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.window(ts, length), *by).agg(F.count("*").alias("n"), F.sum(v).alias("v")).select(F.col("window.start").alias("start"), *by, "n", "v")


def sliding(events: DataFrame, length: str, step: str, by: list[str], late: str = "10 minutes", ts: str = "ts", v: str = "value") -> DataFrame:
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.window(ts, length, step), *by).agg(F.count("*").alias("n"), F.sum(v).alias("v")).select(F.col("window.start").alias("start"), *by, "n", "v")


def sessions(events: DataFrame, gap: str, by: list[str], late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.session_window(ts, gap), *by).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, "n")


def append_catalog(rows: DataFrame, path: str, checkpoint: str, partition_by: list[str] | None = None, available_now: bool = True):
    """Appends streamed catalogue rows to an archive, each file once; returns the running query."""
    derived = {"year": F.year, "month": F.month, "day": F.dayofmonth}
    for c in partition_by or []:
        if c in derived and c not in rows.columns:
            rows = rows.withColumn(c, derived[c]("start_time"))
    w = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    w = w.partitionBy(*partition_by) if partition_by else w
    return (w.trigger(availableNow=True) if available_now else w).start()


def running_moments(rows: DataFrame, by: list[str], v: str = "v") -> DataFrame:
    """Count, mean and population variance of each key so far; in a stream use the update or complete mode."""
    return rows.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_pop(v).alias("var"))
