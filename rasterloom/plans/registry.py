"""All queries of the engine by name, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from ..functions.numeric import tidy
from . import fixtures

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
#: Modules that register queries.
AREAS = ("pixel_queries", "aggregate_queries", "catalog_queries", "patch_queries", "neighbour_queries")


def add(name: str, run: Query, sql: str | None = None) -> None:
    if name in _QUERIES:
        raise ValueError(f"{name} is there already")
    _QUERIES[name] = run
    if sql:
        _SQL[name] = sql


def query(name: str, sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame."""

    def keep(run: Query) -> Query:
        add(name, run, sql)
        return run

    return keep


def per_pixel(name: str, column: Callable[[], Column], sql: str, *, exact: bool = False) -> None:
    """A query with one computed column of every pixel of px; `exact` for columns that are not numbers to round.

    The column is made when the query runs: without a session there are no columns.
    """
    run = lambda s, d: fixtures.px(s, d).select("scene", "y", "x", (column() if exact else tidy(column())).alias("v"))
    add(name, run, f"select scene, y, x, {sql if exact else f'round({sql}, 6) + 0.0'} v from {fixtures.PX}")


def _load() -> None:
    for area in AREAS:
        importlib.import_module(f"{__package__}.{area}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NDVI of a scene, stitched from overlapping windows."""
    return queries()["patch_overlap_add"](spark, sf_dir)
