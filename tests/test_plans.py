"""Scale invariants of every registered query's executed plan: no cartesian product or
nested-loop join (no pair emission), no Python evaluation (no UDFs), and the
focus-country filter of the quarter queries reaches the Parquet scan."""

import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from cumulus.plans.catalog import QUERIES

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF")


def executed_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_no_pairs_no_python(spark, key):
    plan = executed_plan(entry.queries()[key](spark, SF_SMALL))
    assert not [f for f in FORBIDDEN if f in plan]


def test_filter_pushed_to_scan(spark):
    df = entry.queries()["us_percent_by_quarter"](spark, SF_SMALL)
    df.collect()
    formatted = df._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "EqualTo(country,NATION_0)" in formatted
    assert "ReadSchema: struct<observed_date:date,country:string,confirmed:bigint>" in formatted


@pytest.mark.parametrize("key", ["global_count_unpacked", "global_count_vertical", "growth_unpacked", "merge_global"])
def test_merges_shuffle_once_and_filter_below(spark, key):
    df = entry.queries()[key](spark, SF_SMALL)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "FullOuter" not in plan
    if key != "merge_global":
        # the country filter stands below the merge's aggregate, on every input
        assert plan.count("isnull(region") >= 3
