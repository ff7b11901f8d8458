"""Exploration and profile semantics; the one-pass profile equals per-column queries."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from basketry.functions.ranking import dense_rank_values
from basketry.operators import explore as X
from basketry.operators.profile import PROFILE_COLUMNS, profile


def profile_input(spark):
    rows = [(float(i % 7) if i % 5 else None, i % 3, 2.5, None) for i in range(100)]
    return spark.createDataFrame(rows, "salesrank double, total_reviews int, avg_rating double, empty double")


def test_profile_matches_per_column_queries(spark):
    df = profile_input(spark)
    out = {r.col_name: r for r in profile(df, ["salesrank", "total_reviews", "avg_rating", "empty"]).collect()}
    assert list(next(iter(out.values())).asDict()) == PROFILE_COLUMNS
    for c in ["salesrank", "total_reviews", "avg_rating", "empty"]:
        r = out[c]
        nn = df.where(F.col(c).isNotNull()).count()
        nulls = df.where(F.col(c).isNull()).count()
        assert r["count"] == nn and r.dataset_size == 100
        assert r.distinct_count == df.select(c).distinct().count()
        assert r.distinct_count_ == df.select(c).na.drop().distinct().count()
        assert r.col_sparsity == round(nulls / 100 * 100, 2)
        assert r.fill_rate == (100.0 if nulls == 0 else round(nn / 100 * 100, 2))
        if nn:
            q = df.approxQuantile(c, [0.25, 0.5, 0.75], 0.0)
            assert [r.q1, r.q2, r.q3] == q
            assert r["min"] == df.agg(F.min(c)).first()[0] and r["max"] == df.agg(F.max(c)).first()[0]
            assert r.mean == pytest.approx(df.agg(F.mean(c)).first()[0])
        top = df.groupBy(c).count().orderBy(F.desc("count")).collect()
        assert [x["count"] for x in r.most_freq_values_top_10] == [t["count"] for t in top[:10]]
    assert out["avg_rating"].stddev == 0.0 and out["empty"]["count"] == 0 and out["empty"].mean is None
    assert 0 < out["salesrank"].sample_size < 100


def test_null_rates_and_helpfulness(spark):
    reviews = spark.createDataFrame(
        [(1, dt.date(2000, 7, 28), "a", 5, 10, 9), (1, None, "b", 4, 0, 0), (2, dt.date(2001, 1, 5), None, 3, 4, 1)],
        "id long, date date, customer string, rating int, votes int, helpful int",
    )
    rates = {r.column: r.null_rate for r in X.null_rates(reviews).collect()}
    assert rates["date"] == pytest.approx(1 / 3) and rates["id"] == 0.0
    hp = [r.helpful_percentage for r in X.helpfulness(reviews).orderBy("customer").collect()]
    assert hp == [25.0, 90.0, None]  # null customer first; zero votes give null
    m = X.misleading_share(reviews).first()
    assert m.avg_helpful_percentage == pytest.approx(57.5) and m.misleading_percentage == pytest.approx(42.5)


def test_most_frequent_group(spark):
    products = spark.createDataFrame([(1, "Book"), (2, "Music"), (3, "Book")], "id long, group string")
    reviews = spark.createDataFrame(
        [(2, dt.date(2000, 7, 1)), (2, dt.date(2000, 7, 2)), (1, dt.date(2000, 7, 3)), (1, dt.date(2001, 1, 1)),
         (3, dt.date(2001, 1, 1))], "id long, date date")
    assert X.most_frequent_group(products, reviews, month="07").first()["group"] == "Music"
    assert X.most_frequent_group(products, reviews, year=2001).first()["group"] == "Book"
    assert X.most_frequent_group(products).first()["group"] == "Book"
    per = {r.month: r["group"] for r in X.most_frequent_group_per_period(products, reviews, "month").collect()}
    assert per == {7: "Music", 1: "Book"}


def test_sort_histogram_sample(spark):
    p = spark.createDataFrame([(1, "B", 5.0), (2, "B", None), (3, "B", 1.0), (4, "M", 2.0)],
                              "id long, group string, salesrank double")
    assert [r.id for r in X.sort_by_salesrank(p, "B").collect()] == [3, 1, 2]
    h = X.histogram(p, "salesrank", 4).collect()
    # empty bins stay; the max falls in the last bin
    assert [(r.bucket, r["count"]) for r in h] == [(1, 1), (2, 1), (3, 0), (4, 1)]
    assert X.sample(spark.range(1000), 0.1, 3).count() == X.sample(spark.range(1000), 0.1, 3).count()


def test_dense_rank_values_matches_python(spark):
    rnd = random.Random(9)
    vals = [float(rnd.randint(0, 300)) for _ in range(3000)] + [None]
    df = spark.createDataFrame([(v,) for v in vals], "v double").repartition(7)
    got = {r.v: r.rank for r in dense_rank_values(df, "v", "rank").collect()}
    distinct = sorted({v for v in vals if v is not None}, reverse=True)
    assert got == {v: i + 1 for i, v in enumerate(distinct)}


def test_profile_keeps_no_sketch(spark):
    plan = profile(profile_input(spark), ["salesrank"])._jdf.queryExecution().executedPlan().toString()
    assert "percentile_approx" not in plan


def test_dense_rank_does_not_lean_on_reused_exchanges(spark):
    n = 300_000
    df = spark.range(n).select((F.col("id") * 7 % 1_000_003).alias("v"))
    old = spark.conf.get("spark.sql.exchange.reuse")
    for reuse in ("true", "false"):
        spark.conf.set("spark.sql.exchange.reuse", reuse)
        try:
            r = dense_rank_values(df, "v").agg(F.count_distinct("rank"), F.min("rank"), F.max("rank")).first()
        finally:
            spark.conf.set("spark.sql.exchange.reuse", old)
        assert tuple(r) == (n, 1, n)


def test_histogram_has_its_empty_bins(spark):
    df = spark.createDataFrame([(1.0,), (1.5,), (10.0,), (None,)], "x double")
    assert [(r.bucket, r["count"]) for r in X.histogram(df, "x", 3).collect()] == [(1, 2), (2, 0), (3, 1)]
    assert X.histogram(df.where("x is null"), "x", 3).count() == 0
