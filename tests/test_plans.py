"""What the physical plans must and must not have at any size."""

import pytest

from kairoframe.plans import catalog


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, sf):
    text = plan(catalog.queries()["filter_composition"](spark, sf))
    assert "PushedFilters: [" in text and "GreaterThanOrEqual(o_totalprice" in text and "In(o_orderpriority" in text
    assert "Exchange" not in text
    scan = plan(catalog.queries()["semi_by_coverage"](spark, sf))
    assert "o_totalprice" not in scan


@pytest.mark.parametrize("name", ["pit_full_snapshot", "pit_customer_order_history", "asof_last_view_before_purchase", "tolerance_pair_match", "theta_budget_swap", "identity_top_candidate", "home_away_unpivot", "change_point_islands"])
def test_no_join_without_a_key(name, spark, sf):
    text = plan(catalog.queries()[name](spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_asof_join_is_one_shuffle(spark, sf):
    text = plan(catalog.queries()["asof_last_view_before_purchase"](spark, sf))
    assert text.count("Window [") == 1 and "Join" not in text


@pytest.mark.parametrize("name", ["topk_per_group", "latest_version_by_priority"])
def test_ranks_are_limited_before_the_shuffle(name, spark, sf):
    assert "WindowGroupLimit" in plan(catalog.queries()[name](spark, sf))
