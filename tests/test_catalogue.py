"""Every registered query with SQL agrees with DuckDB on the small tables."""

import glob
import os

import duckdb
import pytest

from tessera.plans import catalogue, more

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = catalogue.queries() | more.queries(), catalogue.oracle_sql() | more.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    got, want = QUERIES[name](spark, FOLDER).toPandas(), con.execute(SQL[name]).df()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    flat = lambda df: df[columns].astype(str).sort_values(columns).reset_index(drop=True)
    assert flat(got).equals(flat(want))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
