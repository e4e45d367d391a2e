"""Every raster and frame query with SQL, against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def views():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def same(ours: pd.DataFrame, theirs: pd.DataFrame) -> None:
    columns = sorted(theirs.columns)
    assert columns == sorted(ours.columns)
    order = lambda df: df[columns].sort_values(columns).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(ours), order(theirs), check_dtype=False, atol=1e-6)


@pytest.mark.parametrize("name", [k for k, (_, sql) in entry.OWN.items() if sql])
def test_equals_sql(spark, name):
    plan, sql = entry.OWN[name]
    same(plan(spark, SF).toPandas(), views().sql(sql).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
