"""Every query against its SQL in DuckDB, on the small tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from quern.plans import registry
from quern.sources.tables import TABLES

FOLDER = os.environ.get("QUERN_TEST_DATA", "/root/testdata/sf0.01")
#: Queries without SQL, and why.
WITHOUT_SQL = {"sample_rows": "a sample by hash", "knn_ivf": "approximate; its recall is tested"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def canonical(value):
    if isinstance(value, float):
        return float(f"{value:.12g}")
    if isinstance(value, (list, tuple)):
        return tuple(map(canonical, value))
    return value


def same_rows(columns, left, right) -> bool:
    order = sorted(columns)

    def rows(names, data):
        at = [names.index(c) for c in order]
        return sorted((tuple(canonical(r[k]) for k in at) for r in data), key=repr)

    return rows(*left) == rows(*right)


def test_every_query_has_sql_or_a_reason():
    assert set(registry.QUERIES) == set(registry.SQL) | set(WITHOUT_SQL)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_agrees_with_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, FOLDER)
    found = [tuple(r) for r in df.collect()]
    result = duck.execute(registry.SQL[name])
    names, expected = [c[0] for c in result.description], result.fetchall()
    assert sorted(names) == sorted(df.columns)
    assert len(found) == len(expected)
    assert same_rows(df.columns, (df.columns, found), (names, expected))


@pytest.mark.parametrize("name", sorted(n for n in registry.QUERIES if n.startswith("tpch_")))
def test_decision_support_queries_return_rows(spark, name):
    assert registry.QUERIES[name](spark, FOLDER).limit(1).count() == 1
