import glob
import os

import duckdb
import pytest

from compare import rows
from conftest import SMALL
from tidemark.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for p in glob.glob(f"{SMALL}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    assert rows(QUERIES[name](spark, SMALL).toPandas()) == rows(con.sql(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0
