"""Consecutive numbers over a whole table, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..checkpoints import stash


def numbered(df: DataFrame, order: list, name: str = "label") -> DataFrame:
    """Numbers from 1 in the given order, which must be total: rows are dealt out by ranges, and each range begins where those before it end."""
    # within a range monotonically_increasing_id counts from 0 above the range's own high bits
    rows = stash(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_n", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_n", 33)
    # one row for each range
    counts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_c"))
    before = counts.select("_part", (F.sum("_c").over(W.orderBy("_part")) - F.col("_c")).alias("_before"))
    return rows.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_n").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_part", "_n", "_before")
