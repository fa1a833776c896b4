"""Every registered query against its SQL on the smallest data."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, open_duckdb

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test data not present")


@pytest.fixture(scope="module")
def duck():
    return open_duckdb(FOLDER)


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    assert compare(spark, duck, entry.queries()[name], entry.oracle_sql()[name], FOLDER) is None


def test_entry_has_rows_and_a_stable_schema(spark):
    df = entry.entry(spark)
    assert df.columns == ["order_id", "customer_id", "order_date", "total", "status", "priority", "paid"]
    assert df.count() > 0
