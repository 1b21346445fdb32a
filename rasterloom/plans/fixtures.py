"""Gridded and catalogue views over the test tables, in Spark and, side by side, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


PX = """(select l_suppkey % 8 scene, l_orderkey % 64 y, l_partkey % 64 x, l_shipdate t, l_tax blue, l_discount green,
  l_quantity / 50e0 red, l_extendedprice / 105e3 nir, (l_partkey % 100) / 100e0 swir, (l_suppkey % 50) / 50e0 swir2,
  (l_orderkey % 97) / 97e0 re1, (l_partkey % 89) / 89e0 re2, l_orderkey % 65536 qa from lineitem)"""


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide pixels; several observations for each cell."""
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        (c("l_suppkey") % 8).alias("scene"), (c("l_orderkey") % 64).alias("y"), (c("l_partkey") % 64).alias("x"), c("l_shipdate").alias("t"), c("l_tax").alias("blue"), c("l_discount").alias("green"),
        (c("l_quantity") / 50.0).alias("red"), (c("l_extendedprice") / 105e3).alias("nir"), ((c("l_partkey") % 100) / 100.0).alias("swir"), ((c("l_suppkey") % 50) / 50.0).alias("swir2"),
        ((c("l_orderkey") % 97) / 97.0).alias("re1"), ((c("l_partkey") % 89) / 89.0).alias("re2"), (c("l_orderkey") % 65536).alias("qa"),
    )


GRID = f"(select y, x, avg(nir) v, avg(red) r, avg(green) g, avg(blue) b, count(*) n from {PX} group by 1, 2)"


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each cell, 64 x 64."""
    return px(spark, sf_dir).groupBy("y", "x").agg(F.avg("nir").alias("v"), F.avg("red").alias("r"), F.avg("green").alias("g"), F.avg("blue").alias("b"), F.count("*").alias("n"))


DEM = """(select y, x, ((y * y + 3 * x + coalesce(q, 0)) % 97) * 1e0 v from range(64) a(y) cross join range(64) b(x)
  left join (select l_orderkey % 64 y, l_partkey % 64 x, sum(l_quantity)::bigint q from lineitem group by 1, 2) c using (y, x))"""


def dem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field without gaps, 64 x 64, of which every value comes from all rows of its cell."""
    c = F.col
    q = table(spark, sf_dir, "lineitem").groupBy((c("l_orderkey") % 64).alias("y"), (c("l_partkey") % 64).alias("x")).agg(F.sum("l_quantity").cast("long").alias("q"))
    cell = spark.range(64 * 64).select(F.floor(c("id") / 64).alias("y"), (c("id") % 64).alias("x"))
    return cell.join(q, ["y", "x"], "left").select("y", "x", ((c("y") * c("y") + 3 * c("x") + F.coalesce("q", F.lit(0))) % 97).cast("double").alias("v"))


CAT = """(select 'scene_' || o_orderkey || '.tif' filepath, o_orderkey id, (o_custkey % 360 - 180) * 1e0 xmin, (o_orderkey % 170 - 85) * 1e0 ymin,
  (o_custkey % 360 - 180 + 1 + o_orderkey % 3) * 1e0 xmax, (o_orderkey % 170 - 85 + 1 + o_orderkey % 3) * 1e0 ymax,
  o_orderdate start_time, o_orderdate + to_days(cast(o_orderkey % 5 as integer)) end_time, o_orderstatus status from orders)"""


def cat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue: a row for each file, with box and closed interval."""
    c = F.col
    x0, y0, d = c("o_custkey") % 360 - 180, c("o_orderkey") % 170 - 85, c("o_orderkey") % 3 + 1
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("scene_"), c("o_orderkey").cast("string"), F.lit(".tif")).alias("filepath"), c("o_orderkey").alias("id"),
        x0.cast("double").alias("xmin"), y0.cast("double").alias("ymin"), (x0 + d).cast("double").alias("xmax"), (y0 + d).cast("double").alias("ymax"),
        c("o_orderdate").alias("start_time"), (c("o_orderdate") + F.make_dt_interval((c("o_orderkey") % 5).cast("int"))).alias("end_time"), c("o_orderstatus").alias("status"),
    )


CAT_B = """(select 'b_' || c_custkey || '.tif' filepath, c_custkey id, (c_custkey * 7 % 360 - 180) * 1e0 xmin, (c_custkey * 11 % 170 - 85) * 1e0 ymin,
  (c_custkey * 7 % 360 - 178) * 1e0 xmax, (c_custkey * 11 % 170 - 83) * 1e0 ymax,
  timestamp '1995-01-01' + to_days(cast(c_custkey % 2000 as integer)) start_time, timestamp '1995-01-04' + to_days(cast(c_custkey % 2000 as integer)) end_time, c_mktsegment status from customer)"""


def cat_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second catalogue."""
    c = F.col
    x0, y0, day = c("c_custkey") * 7 % 360 - 180, c("c_custkey") * 11 % 170 - 85, F.make_dt_interval((c("c_custkey") % 2000).cast("int"))
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("b_"), c("c_custkey").cast("string"), F.lit(".tif")).alias("filepath"), c("c_custkey").alias("id"),
        x0.cast("double").alias("xmin"), y0.cast("double").alias("ymin"), (x0 + 2).cast("double").alias("xmax"), (y0 + 2).cast("double").alias("ymax"),
        (F.lit("1995-01-01").cast("timestamp") + day).alias("start_time"), (F.lit("1995-01-04").cast("timestamp") + day).alias("end_time"), c("c_mktsegment").alias("status"),
    )


PTS = "(select event_id id, (user_id * 37 + event_id) % 640 / 10e0 px, (user_id * 53 + event_id * 3) % 640 / 10e0 py, value, ts, event_type kind from events)"


def pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with a value and a time, on [0, 64) x [0, 64)."""
    c = F.col
    return table(spark, sf_dir, "events").select(
        c("event_id").alias("id"), ((c("user_id") * 37 + c("event_id")) % 640 / 10.0).alias("px"), ((c("user_id") * 53 + c("event_id") * 3) % 640 / 10.0).alias("py"), "value", "ts", c("event_type").alias("kind")
    )


CUBE = "(select vec_id pixel, cast(label as bigint) label, unnest(range(64)) band, unnest(embedding)::double v from embeddings)"


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long spectra: 64 bands for each pixel; band b is at 400 + 10 b nm."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pixel"), F.col("label").cast("long").alias("label"), F.posexplode("embedding").alias("band", "v")).withColumn("v", F.col("v").cast("double")).withColumn("band", F.col("band").cast("long"))
