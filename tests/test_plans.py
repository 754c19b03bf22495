"""Physical-plan properties the design relies on, checked on the registered queries."""

import re

import pytest

import __spark_entry__ as entry
from tests.conftest import SF001

NAMES = sorted(entry.queries())


def executed_plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    return {name: executed_plan(entry.queries()[name](spark, SF001)) for name in NAMES}


def test_no_cross_products_anywhere(plans):
    for name, plan in plans.items():
        assert "CartesianProduct" not in plan, name
        assert "BroadcastNestedLoopJoin" not in plan, name


def test_no_row_at_a_time_python(plans):
    for name, plan in plans.items():
        assert "BatchEvalPython" not in plan, name  # only Arrow-batched Python


def test_flagship_plan_shape(plans):
    plan = plans[entry.FLAGSHIP]
    assert plan.count("FlatMapCoGroupsInArrow") == 1
    # Hashing once per side, and the queries once more for the list of asked buckets.
    assert plan.count("ArrowEvalPython") == 3
    assert re.search(r"BroadcastHashJoin.*LeftSemi", plan)  # drops training rows unasked for
    assert "WindowGroupLimit" in plan  # per-query top k cut before the window
    assert "CartesianProduct" not in plan


def test_scans_read_only_needed_columns(plans):
    # Column pruning reaches the Parquet scan: a query without vector work never reads
    # the vector column.
    schemas = re.findall(r"ReadSchema: (struct<[^\n]*?>)(?:,|\s|$)", plans["bernoulli_all"])
    assert schemas
    assert all("embedding" not in sch for sch in schemas)
    # The side that only reports the queries (id, label) reads no vectors either.
    reports = [sch for sch in re.findall(r"ReadSchema: (struct<[^\n]*)", plans["bucket_vote"])
               if "embedding" not in sch]
    assert reports


@pytest.mark.parametrize("name", ["sweep", "sweep_sign"])
def test_sweep_is_one_pass(plans, name):
    """All settings come out of one kernel, over vectors hashed before it and stored."""
    assert plans[name].count("FlatMapCoGroupsInArrow") == 1
    assert "ArrowEvalPython" not in plans[name]


def test_one_key_search_single_python_pass(plans):
    plan = plans["search_one_key"]
    assert plan.count("ArrowEvalPython") == 1  # hash test and distance in one pass
    assert "TakeOrderedAndProject" in plan  # partial top k per partition, bounded merge
