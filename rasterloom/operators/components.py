"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import stash


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Every node points its neighbours (large: the greater ones) and itself at the smallest of them."""
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    near = both.join(least, "a")
    if large:
        out = near.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _done(links: DataFrame) -> bool:
    """Whether every node points at one other, which points at none: b is then the smallest of its component, as a > b in all links."""
    ends = links.select("a", F.lit(1).alias("up")).unionAll(links.select("b", F.lit(0)))
    return not ends.groupBy("a").agg(F.sum("up").alias("up"), F.count("*").alias("many")).where("up > 0 and many > 1").count()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes of `links` (a, b), component being the smallest node reachable.

    A pair may be given in either direction and repeatedly; a link of a node with itself counts for nothing.
    Each round is written to the shared folder, and the rounds end when all links point at their component.
    """
    links = stash(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while not _done(links):
        links = stash(_star(_star(links, True), False), "star")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
