"""Plan shape of the registered queries: no cartesian products, no Python in the hot path,
filters and column pruning reach the parquet scans."""

import re

import pytest

from conftest import SF_SMALL
from tillbook.registry import QUERIES

# Jobs that write or checkpoint while the DataFrame is built are left to the oracle test.
EAGER = ("chg1", "chg2", "chg3", "chg5", "chg6", "chg7", "chg8", "chg9", "join10", "join11", "str", "snk", "srt")
LAZY = sorted(k for k in QUERIES if not k.startswith(EAGER))


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_cartesian_no_python(spark, name):
    plan = plan_text(QUERIES[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "EvalPython" not in plan and "FlatMapGroupsInPandas" not in plan


def test_period_filter_and_pruning_reach_the_scan(spark):
    df = QUERIES["rep5_inventory_export"](spark, SF_SMALL)
    formatted = df._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    orders_scan = re.search(r"Scan parquet[^\n]*\n(?:[^\n]+\n)*?Location:[^\n]*orders\.parquet[^\n]*\n"
                            r"PushedFilters: \[([^\n]*)\]\nReadSchema: ([^\n]*)", formatted)
    assert orders_scan, formatted
    assert "GreaterThanOrEqual(o_orderdate" in orders_scan.group(1)
    assert orders_scan.group(2) == "struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>"
    lineitem_schema = re.search(r"lineitem\.parquet[^\n]*\n(?:PushedFilters[^\n]*\n)?ReadSchema: ([^\n]*)", formatted)
    assert lineitem_schema and "l_shipdate" not in lineitem_schema.group(1) and "l_comment" not in lineitem_schema.group(1)


def test_aggregates_are_partial_before_the_shuffle(spark):
    plan = plan_text(QUERIES["win1_current_status"](spark, SF_SMALL))
    assert "partial_max_by" in plan
    plan = plan_text(QUERIES["rep2_inventory_report"](spark, SF_SMALL))
    assert "partial_sum" in plan
