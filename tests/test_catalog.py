"""Every registered query of the outline engine against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from tessella import catalog

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF_DIR):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{name}'")
    return con


def _plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF_DIR)
    want = duck.sql(catalog.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = [[_plain(r[c]) for c in columns] for r in got.collect()]
    at = [want.columns.index(c) for c in columns]
    expected = [[_plain(r[i]) for i in at] for r in want.fetchall()]
    assert rows and sorted(rows) == sorted(expected)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)
