"""Every registered query against its oracle SQL, and the plans that matter."""

import sys
from pathlib import Path

import pytest

from conftest import DATA

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

from check_queries import compare  # noqa: E402

import __spark_entry__ as contract  # noqa: E402
from embertide.operators import alarms as al  # noqa: E402
from embertide.operators import readings as rd  # noqa: E402
from embertide.plans.inputs import Inputs  # noqa: E402
from embertide.plans.queries import registered  # noqa: E402


@pytest.mark.parametrize("name", list(registered()))
def test_query_equals_oracle(spark, name):
    ok, _, _, _, notes = compare(spark, DATA, name)
    assert ok is not False, notes


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    inputs = Inputs(spark, DATA)
    text = plan(al.count_in_window(inputs.alarms, "2024-01-05T00:00:00Z", "2024-01-06T00:00:00Z"))
    assert "GreaterThanOrEqual(ts" in text and "LessThan(ts" in text and "GreaterThan(value" in text
    assert "ReadSchema: struct<ts:timestamp_ntz,value:double>" in text
    text = plan(rd.bucketed(inputs.sensor_data, "1 hour"))
    assert "props" not in text
    assert text.count("Exchange") == 1  # partial aggregation, one shuffle


def test_top_k_and_per_key_limits_are_cut_before_the_shuffle(spark):
    inputs = Inputs(spark, DATA)
    assert "TakeOrderedAndProject" in plan(al.newest(inputs.alarms))
    text = plan(al.newest_per(inputs.alarms, "device_id", 3))
    assert text.count("WindowGroupLimit") == 2


def test_flagship_has_one_shuffle_for_both_windows(spark):
    text = plan(contract.queries()[contract.FLAGSHIP](spark, DATA))
    assert "BroadcastHashJoin" in text
    assert text.count("Exchange hashpartitioning") == 1
