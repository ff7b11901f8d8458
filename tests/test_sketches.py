"""Mergeable quantiles within their rank error; top values proven from candidates; levels of one grouping."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from basketry.operators import explore as X
from basketry.operators import graph as G
from basketry.operators import sketches as K
from basketry.operators.profile import top_values


def test_merged_quantiles_stay_within_their_error(spark):
    df = spark.range(60_000).select(
        (F.col("id") % 9).alias("part"), (F.xxhash64("id") % 1_000_003).cast("double").alias("wide"), F.when(F.col("id") % 3 == 0, F.col("id") % 4).alias("few"),
        F.lit(None).cast("int").alias("none"), F.when(F.col("id") < 50, F.lit(float("nan"))).otherwise(F.lit(7.0)).alias("nan"))
    sketches = K.quantile_sketches(df, ["wide", "few", "none", "nan"], by=["part"])
    assert sketches.count() == 9 * 4
    found = K.merged_quantiles(sketches, (0.01, 0.25, 0.5, 0.75, 0.99))
    off = {(r.col_name, r.q): r for r in K.rank_errors(df, found).collect()}
    assert {c for c, _ in off} == {"wide", "few", "nan"} and len(off) == 15
    assert max(r.rank_error for r in off.values()) <= 0.01
    assert off["wide", 0.5].n == 60_000 and off["few", 0.5].n == 20_000 and off["nan", 0.5].value == 7.0
    assert K.merged_quantiles(K.quantile_sketches(df.limit(0), ["wide"])).count() == 0


def test_rank_error_sees_a_wrong_quantile(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("x"))
    wrong = spark.createDataFrame([("x", 1000, 0.5, 600.0), ("x", 1000, 0.25, 250.0)], "col_name string, n long, q double, value double")
    got = {r.q: r.rank_error for r in K.rank_errors(df, wrong).collect()}
    assert got[0.5] == pytest.approx(0.1) and got[0.25] == 0


@pytest.mark.parametrize("tracked", [16, 4096])
def test_heavy_hitters_equal_top_values(spark, tracked):
    rnd = random.Random(4)
    values = [rnd.choice([None, 1.5, 2.5, float("nan")]) for _ in range(50)]
    rows = [(rnd.randrange(5000), min(int(rnd.expovariate(0.3)), 40), None if k % 3 else 7, values[k % 50]) for k in range(6000)]
    df = spark.createDataFrame(rows, "flat int, skewed int, nulls int, few double").repartition(4)
    columns = ["flat", "skewed", "nulls", "few"]
    got = {r.col_name: r.most_freq_values_top_10 for r in K.heavy_hitters(df, columns, tracked=tracked).collect()}
    want = {r.col_name: r.most_freq_values_top_10 for r in top_values(df, columns).collect()}
    assert got == want and set(got) == set(columns)


def test_columns_without_proof_are_counted_in_full(spark, monkeypatch):
    df = spark.range(5000).select(F.col("id").alias("flat"), (F.col("id") % 3).alias("few"))
    asked = []
    monkeypatch.setattr(K, "top_values", lambda d, c, n: asked.append(c) or top_values(d, c, n))
    assert {r.col_name for r in K.heavy_hitters(df, ["flat", "few"], tracked=64).collect()} == {"flat", "few"}
    assert asked == [["flat"]]


def test_levels_equal_single_questions(spark):
    rnd = random.Random(5)
    products = spark.createDataFrame([(i, rnd.choice(["Book", "Music", "DVD"])) for i in range(30)], "id long, group string")
    rows = [(rnd.randrange(33), datetime.date(1995 + rnd.randrange(4), rnd.randrange(1, 13), 3) if rnd.random() < 0.95 else None) for _ in range(2000)]
    reviews = spark.createDataFrame(rows, "id long, date date")
    got = {(r.level, r.period): (r.group, r["count"]) for r in X.most_frequent_groups(products, reviews).collect()}
    years = {("year", r.year): (r.group, r["count"]) for r in X.most_frequent_group_per_period(products, reviews, "year").collect()}
    months = {("month", r.month): (r.group, r["count"]) for r in X.most_frequent_group_per_period(products, reviews, "month").collect()}
    r = X.most_frequent_group(products, reviews.where("date is not null")).first()
    assert got == years | months | {("all", 0): (r.group, r["count"])}


def test_recursive_reach_equals_search(spark):
    rnd = random.Random(6)
    edges = spark.createDataFrame([(rnd.randrange(80), rnd.randrange(80)) for _ in range(120)], "src long, dst long")
    for depth in (0, 1, 2, 3):
        want = {r.id: r.depth for r in G.product_bfs(edges, 5, max_depth=depth).collect()}
        assert {r.id: r.depth for r in G.reach_within(edges, 5, depth).collect()} == want
