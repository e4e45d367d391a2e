import duckdb
import pandas as pd

import __spark_entry__ as entry

PLAN, SQL = entry.OWN["screen_content_share"]
SCHEMA = "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"


def suppliers(spark, tmp_path, rows):
    spark.createDataFrame([(k, f"s{k}", nation, 0.0) for k, nation in rows], SCHEMA).write.parquet(f"{tmp_path}/supplier.parquet")
    return str(tmp_path)


def test_samples_are_shuffled_once_and_never_broadcast(spark, tmp_path):
    found = PLAN(spark, suppliers(spark, tmp_path, [(k, k % 25) for k in range(400)]))
    assert sum(r["blocks"] for r in found.collect()) == 400 * 16
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "Broadcast" not in plan
    assert plan.count("Exchange hashpartitioning(") == 3  # samples, suppliers, sums by nation


def test_odd_suppliers_equal_sql(spark, tmp_path):
    """No key, no nation, a key twice in one nation or in two, great and negative keys."""
    sf_dir = suppliers(spark, tmp_path, [(None, 1), (1, None), (2, 5), (2, 5), (3, 5), (3, 6), (4, 6), (-7, 6), (2**40, 7), (5, None)])
    con = duckdb.connect()
    con.sql(f"create view supplier as select * from '{sf_dir}/supplier.parquet/*.parquet'")
    theirs = con.sql(SQL).df().sort_values("s_nationkey").reset_index(drop=True)
    ours = PLAN(spark, sf_dir).toPandas().sort_values("s_nationkey").reset_index(drop=True)
    pd.testing.assert_frame_equal(ours[list(theirs.columns)], theirs, check_dtype=False)
