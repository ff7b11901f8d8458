"""Plan shape: no Python UDFs or cross joins anywhere; pushdown, semi-joins, partial top-k where expected."""

from __future__ import annotations

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from tests.test_entry import own

FORBIDDEN = ["PythonUDF", "BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    return {name: plan_of(fn(spark, SF_SMALL)) for name, fn in own(E.queries()).items()}


def test_no_python_udf_or_cross_join(plans):
    for name, plan in plans.items():
        for bad in FORBIDDEN:
            assert bad not in plan, f"{name} uses {bad}"


def test_expected_operators(plans):
    assert "WindowGroupLimit" in plans["recommend_all"]
    assert "WindowGroupLimit" in plans["most_frequent_group_per_month"]
    assert "TakeOrderedAndProject" in plans["recommend_filters_group"]
    assert "LeftSemi" in plans["relevant_categories_group"]
    assert "LeftSemi" in plans["recommend_by_category"]
    # a title request reads the folders of its own tokens; no join, no shuffle
    assert "tok_bucket" in plans["title_matches"].split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "Join" not in plans["title_matches"] and "Exchange" not in plans["title_matches"]
    # category requests read the first rows of their categories' runs
    for name in ("recommend_by_category", "recommend_with_requested_category", "recommend_with_chosen_categories"):
        assert "LessThanOrEqual(rank,6)" in plans[name], name


def test_title_scan_is_one_projection(spark):
    """Without an index, one product's title set is a scalar subquery: the catalogue side is a plain scan, no join."""
    from basketry.operators.similarity import title_matches
    from basketry.plans.registry import cat

    plan = plan_of(title_matches(cat(spark, SF_SMALL).products, 42))
    assert "Subquery" in plan and "Join" not in plan.split("Subquery")[0]


def test_searches_shuffle_no_edges(plans, spark):
    from basketry.plans.registry import cat

    step = plan_of(cat(spark, SF_SMALL).graph_neighbours.step(spark.createDataFrame([("product:0000000042",)], "id string")))
    assert "Bucketed: true" in step and step.count("Exchange") == 1


def test_filters_reach_the_scan(spark):
    from basketry.plans.registry import cat
    from basketry.operators.recommend import relevant_categories

    plan = plan_of(relevant_categories(cat(spark, SF_SMALL).products, 42))
    assert "PushedFilters: [IsNotNull(id), EqualTo(id,42)" in plan


def test_no_copy_of_the_edges_for_a_search(spark, plans):
    assert "InMemoryTableScan" not in plans["bfs_copurchase"]
    # the path's bound half is two scalar subqueries; no join has one literal for its key
    assert plans["path_top_n"].count("Subquery") >= 2
    assert "Exchange" not in plans["recommend_filters_none"]
