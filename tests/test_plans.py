"""What the physical plans must and must not contain."""

import os

import pytest

import __spark_entry__ as entry
from tableferry.suite.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test data not present")
RUN_WHILE_BUILT = {"migration_run", "dry_run_counts", "sink_roundtrip", "stream_replay", "quarantine_load"}


def plan(spark, name):
    return entry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in RUN_WHILE_BUILT])
def test_no_query_pairs_all_rows(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text


def test_filters_and_columns_reach_the_reader(spark):
    text = plan(spark, "scan_filter")
    scan = next(line for line in text.split("\n") if "FileScan" in line)
    assert "PushedFilters: [IsNotNull(l_shipdate), IsNotNull(l_quantity), GreaterThanOrEqual(l_shipdate" in scan
    assert "l_extendedprice" not in scan and "l_discount" not in scan and "l_suppkey" not in scan
    assert "o_orderpriority" not in plan(spark, "join_inner")


def test_row_wise_work_needs_no_shuffle(spark):
    for name in ("scan_filter", "rename_columns", "map_structure", "transform_case", "date_to_text", "type_map_mysql", "calculate_column"):
        assert "Exchange" not in plan(spark, name), name


@pytest.mark.parametrize("name", ["column_match", "table_match", "table_suggestions", "auto_map"])
def test_matching_runs_no_python(spark, name):
    text = plan(spark, name)
    assert not any(word in text for word in ("Python", "Pandas", "ArrowEval", "CoGroup", "CartesianProduct", "NestedLoop"))


def test_one_join_for_two_conditions(spark):
    text = plan(spark, "join_multi_key")
    assert text.count("HashJoin") + text.count("SortMergeJoin") == 1
