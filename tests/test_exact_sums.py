"""Ranks of sums that lie on a rounding limit."""

import datetime as dt

import duckdb
from compare import compare
from pyspark.sql import functions as F

import __spark_entry__ as entry


def test_half_units_are_rounded_from_exact_sums(spark, tmp_path):
    # Exactly 14.50, but a sum of doubles is below in this order; the second unit has 15, the third one no price.
    assert sum([0.29] * 50) < 14.5
    lines = [(1, 0.29)] * 50 + [(2, 15.0), (3, None), (4, 14.0)]
    day = dt.datetime(1995, 5, 5)
    src = spark.createDataFrame([(u, p, day) for u, p in lines], "l_suppkey long, l_extendedprice double, l_shipdate timestamp_ntz")
    src = src.withColumns({"l_quantity": F.lit(1.0), "l_discount": F.lit(0.0), "l_returnflag": F.lit("N")})
    src.coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    df = entry.queries()["rank_to_percentile"](spark, str(tmp_path))
    assert {r["unit"]: r["rank_no"] for r in df.collect()} == {1: 1, 2: 1, 3: 4, 4: 3}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    assert compare(df, con, entry.oracle_sql()["rank_to_percentile"], tol=1e-9) == []
