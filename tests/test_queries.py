"""Every query of the catalog against its SQL, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as driver
from catalog import REGISTRY
from tools.compare import TABLES, tidy

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
QUERIES = {name: f for name, (f, _) in REGISTRY.items()}
SQL = {name: sql for name, (_, sql) in REGISTRY.items() if sql is not None}


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    a, b = tidy(got), tidy(want)
    for c in a.columns:
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        assert same.all(), f"{c}: {a.loc[~same].head(3).to_dict()} against {b.loc[~same].head(3).to_dict()}"


def test_every_query_has_sql():
    assert QUERIES.keys() == SQL.keys()


def test_entry(spark):
    assert driver.entry(spark).count() == 7


def test_driver_offers_the_catalog():
    assert QUERIES.keys() <= driver.queries().keys() and SQL.keys() <= driver.oracle_sql().keys()
