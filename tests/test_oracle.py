"""Every query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from rasterloom.plans import registry

from .conftest import SF

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def plain(v):
        if isinstance(v, float) and math.isnan(v):
            return "nan"
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def _close(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 2e-6 * max(1.0, abs(a)))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, db, name):
    df = QUERIES[name](spark, str(SF))
    rel = db.sql(SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    ours, theirs = _rows(df.columns, [tuple(r) for r in df.collect()]), _rows(rel.columns, rel.fetchall())
    assert len(ours) == len(theirs) > 0
    assert all(_close(x, y) for r, s in zip(ours, theirs, strict=True) for x, y in zip(r, s, strict=True)), next((r, s) for r, s in zip(ours, theirs, strict=True) if r != s)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs_and_is_stable(spark, name):
    a = sorted(map(repr, QUERIES[name](spark, str(SF)).collect()))
    b = sorted(map(repr, QUERIES[name](spark, str(SF)).collect()))
    assert a
    assert a == b
