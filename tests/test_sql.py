"""Every job with a SQL statement agrees with DuckDB on the small tables."""

import pytest
from compare import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("key", sorted(entry.oracle_sql()))
def test_job_agrees_with_sql(spark, con, key):
    assert compare(entry.queries()[key](spark, SF), con, entry.oracle_sql()[key], tol=1e-9) == []


def test_entry_has_rows_and_schema(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns[:2] == ["duration", "n_risk"]


def test_every_statement_has_a_job():
    assert set(entry.oracle_sql()) <= set(entry.queries())
