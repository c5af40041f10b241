"""Every query gives what its SQL gives, and its plan keeps to the rules."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.parity_check import connect, differences

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


def test_every_sql_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry_has_rows(spark):
    assert entry(spark).count() == 16


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_matches_sql(spark, connection, name):
    assert differences(spark, connection, name, queries()[name], oracle_sql().get(name), SF_DIR) is None


@pytest.mark.parametrize(
    "name", ["zscore_rows", "timeseries_flagged", "report_anomalies", "usage_cost", "run_scores", "reference_check"]
)
def test_plan_has_no_cartesian_product_and_no_python(spark, name):
    plan = queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "Python" not in plan and "Pandas" not in plan


def test_zscore_reaches_the_scan(spark):
    plan = queries()["zscore_rows"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(GreaterThan(value," in plan
    assert "ReadSchema: struct<event_id:bigint,value:double>" in plan


def test_every_value_counted_is_limited_before_the_shuffle(spark):
    from plumbline.operators.statistics import _counted_categories

    events = spark.read.parquet(f"{SF_DIR}/events.parquet")
    plan = _counted_categories(events, ["event_type", "props"], 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
