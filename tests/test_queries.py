"""Every query with SQL against DuckDB on the smallest tables, and the shape of the entry module."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from lectern.plans import catalog


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    want = duck.sql(catalog.SQL[name])
    assert sorted(want.columns) == columns
    rows = lambda x: sorted(repr(tuple(r)) for r in x)
    assert rows(df.select(*columns).collect()) == rows(want.select(*[f'"{c}"' for c in columns]).fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
