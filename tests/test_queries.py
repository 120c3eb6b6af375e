"""Every registered query with SQL gives what DuckDB gives; the others run."""

import glob
import os

import duckdb
import pytest

from compare import rows
from conftest import SMALL
from tidemark.plans.catalogue import QUERIES, SQL

SLOW = {"temperature_fit"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for p in glob.glob(f"{SMALL}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SMALL).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - SLOW))
def test_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_registry_has_sql_only_for_queries():
    assert set(SQL) <= set(QUERIES)
