"""Shapes of physical plans: no cross joins, pruned scans, pushed filters."""

import os

import pytest

from tidemark.plans import registry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables aren't here")


def plan_of(spark, name):
    return registry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["event_reaction", "dedup_prefix", "cluster_siblings", "relations_semi", "decision_cards", "person_summary"])
def test_no_cross_join(spark, name):
    plan = plan_of(spark, name)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filter_and_columns_reach_the_scan(spark):
    plan = plan_of(spark, "retention")
    assert "PushedFilters" in plan and "GreaterThanOrEqual(ts" in plan and "props" not in plan


@pytest.mark.parametrize("name", ["rule_labels", "heat_score", "risk_scores", "canonical_url"])
def test_scalar_rules_need_no_shuffle_and_no_python(spark, name):
    plan = plan_of(spark, name)
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
