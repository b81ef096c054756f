"""Queries against their SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest
from verimill.plans import registry
from verimill.plans.fixtures import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows, columns):
    place = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda x: round(float(x), 6) + 0.0 if isinstance(x, (int, float)) and not isinstance(x, bool) else x if x is None else str(x)
    return sorted((tuple(value(r[i]) for i in place) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    want = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert plain(df.collect(), df.columns) == plain(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).collect() is not None
