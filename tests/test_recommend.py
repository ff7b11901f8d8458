"""Recommender semantics on hand-made rows, and the batch recommender against brute force."""

from __future__ import annotations

import random

import pytest

from basketry.operators import recommend as R

SCHEMA = (
    "id long, asin string, title string, group string, salesrank double, total_reviews long, avg_rating double, "
    "similars array<string>, categories array<string>"
)


def score(rank, reviews, rating):
    if rank is None or reviews is None or rating is None:
        return None
    return ((1e7 - rank) / 1e7 + reviews / 100 + rating) / 3


def products(spark):
    rows = [
        (1, "A1", "red ring", "Book", 10.0, 5, 4.0, ["A2", "A9"], ["|Books|Fiction", "|Books|Kids"]),
        (2, "A2", "blue ring", "Book", 20.0, 50, 4.5, ["A1"], ["|Books|Fiction"]),
        (3, "A3", "red bolt", "Music", 5.0, 1, 3.0, [], ["|Books|Kids", "|Music|Rock"]),
        (4, "A4", "green bolt", "Book", None, 3, 3.5, [], ["|Books|Kids"]),
        (5, "A5", "red ring", "DVD", 30.0, 10, 5.0, [], ["|DVD|Drama"]),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_relevant_categories_forms(spark):
    p = products(spark)
    own = sorted(r["category"] for r in R.relevant_categories(p, 1).collect())
    assert own == ["|Books|Fiction", "|Books|Kids"]
    # running-code form: the product's own categories, if a similar exists in the catalogue
    assert sorted(r["category"] for r in R.relevant_categories(p, 1, "Book").collect()) == own
    assert R.relevant_categories(p, 1, "DVD").count() == 0
    # intent form: the similars' own rows
    sim = sorted((r["id"], r["category"]) for r in R.relevant_categories(p, 1, "Book", from_similars=True).collect())
    assert sim == [(2, "|Books|Fiction")]


def test_id_required(spark):
    with pytest.raises(ValueError):
        R.recommend_by_category(products(spark), None)


def test_recommend_by_category_excludes_input_and_orders_by_score(spark):
    got = [(r["asin"], None if r["score"] is None else round(r["score"], 9))
           for r in R.recommend_by_category(products(spark), 1, top_n=5).collect()]
    want = [("A2", round(score(20.0, 50, 4.5), 9)), ("A3", round(score(5.0, 1, 3.0), 9))]
    # A4 has a null rank, so a null score: it comes last
    assert got[:2] == want and got[2][0] == "A4" and got[2][1] is None


def test_optional_filters(spark):
    p = products(spark)
    # a missing category adds no predicate (the reference's contains(None) dropped every row)
    assert [r["asin"] for r in R.recommend(p, asin="A1", group="Book").collect()] == ["A2", "A4"]
    assert [r["asin"] for r in R.recommend(p, category="Kids", top_n=10).collect()] == ["A1", "A3", "A4"]
    # asin alone: the asin's own group
    assert [r["asin"] for r in R.recommend(p, asin="A5").collect()] == []
    assert len(R.recommend(p).collect()) == 5


def test_top_scored_groups_before_sorting(spark):
    df = spark.createDataFrame([("A", "t", 1.0), ("A", "t", 3.0), ("B", "u", 2.0)], "asin string, title string, score double")
    assert [(r.asin, r.score) for r in R.top_scored(df, 5).collect()] == [("A", 3.0), ("B", 2.0)]
    assert [(r.asin, r.score) for r in R.top_scored(df, 5, ascending=True).collect()] == [("B", 2.0), ("A", 3.0)]


def test_title_and_requested_category(spark):
    p = products(spark)
    got = [r["asin"] for r in R.recommend_by_category_and_title(p, 5, threshold=0.3).collect()]
    assert got == ["A2", "A1", "A3"]  # title matches (ring / red) only: A5 has its own category alone
    got = [r["asin"] for r in R.recommend_with_requested_category(p, 5, None, "|Music|Rock").collect()]
    assert got == ["A3"]


def test_recommend_all_equals_brute_force(spark):
    rnd = random.Random(11)
    cats = [f"|c{i}" for i in range(12)]
    rows = []
    for i in range(300):
        rank = None if i % 37 == 0 else float(rnd.randint(1, 50))
        rows.append((i, f"{i:05d}", f"t{i}", "G", rank, rnd.randint(0, 5), rnd.choice([1.0, 2.0, 3.0]), [],
                     rnd.sample(cats, rnd.randint(1, 3))))
    p = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in R.recommend_all(p, 4).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["rec_id"]))
    by_id = {r[0]: r for r in rows}

    def key(j):
        s = score(by_id[j][4], by_id[j][5], by_id[j][6])
        return (s is None, -(s or 0), by_id[j][1], j)

    for i, row in enumerate(rows):
        cands = {j for j, other in by_id.items() if j != i and set(other[8]) & set(row[8])}
        want = sorted(cands, key=key)[:4]
        assert [rid for _, rid in sorted(got.get(i, []))] == want


def test_products_without_categories_stay(spark):
    p = spark.createDataFrame(
        [(1, "A1", "red ring", "Book", 1.0, 9, 5.0, [], []), (2, "A2", "red ring", "Book", 5.0, 1, 1.0, [], ["|x"])], SCHEMA)
    assert [r.asin for r in R.recommend(p).collect()] == ["A1", "A2"]
    assert [r.asin for r in R.recommend_by_category_and_title(p, 2).collect()] == ["A1"]
    assert [r.asin for r in R.recommend(p, category="   |x ").collect()] == ["A2"]
    plan = R.recommend(p)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "TakeOrderedAndProject" in plan


def test_chosen_categories_are_equal_not_folded(spark):
    p = spark.createDataFrame(
        [(1, "A1", "t", "Book", 1.0, 9, 5.0, [], ["|Own"]), (2, "A2", "u", "Book", 5.0, 1, 1.0, [], ["|books|fiction"]),
         (3, "A3", "v", "Book", 5.0, 1, 1.0, [], ["|Books|Fiction"])], SCHEMA)
    got = R.recommend_with_chosen_categories(p, 1, "Book", ["   |Books|Fiction"]).collect()
    assert [r.asin for r in got] == ["A3"]


def test_forms_over_the_context_rows(spark):
    p = spark.createDataFrame(
        [(1, "A1", "red ring", "Book", 1.0, 9, 5.0, ["A2", "X9"], ["|x", "|y"]),
         (2, "A2", "blue ring", "Book", 5.0, 1, 1.0, [], ["|y", "|z"]),
         (3, "A3", "green hat", "DVD", 2.0, 2, 3.0, [], ["|q"])], SCHEMA)
    assert [r.asin for r in R.context_recommendation(p, 1).collect()] == ["A1"]
    assert [r.asin for r in R.context_recommendation(p, 1, "Book", from_similars=True).collect()] == ["A2"]
    assert [r.asin for r in R.context_recommendation(p, 1, requested=" |q").collect()] == ["A1", None]
    assert [r.asin for r in R.context_recommendation(p, 1, requested="|none").collect()] == ["A1"]
    assert [r.asin for r in R.context_and_titles(p, 1).collect()] == ["A1", "A2"]
    assert [r.asin for r in R.context_and_chosen(p, 1, "Book", ["|q"]).collect()] == ["A1", "A3"]
    got = sorted((r.asin, r.category) for r in R.context_by_asin(p, 1).collect())
    assert got == [("A1", "|x"), ("A1", "|y"), ("A2", "|y"), ("A2", "|z")]
    assert {r.category for r in R.context_by_asin(p, 1, categories=[" |Z"]).collect()} == {"|z"}


def test_stored_category_buckets_prune_and_agree(spark, scratch):
    from types import SimpleNamespace

    from basketry.operators import catalog as C

    p = products(spark)
    path = f"{scratch}/categories"
    C.bucketed_product_categories(p, 3).write.partitionBy("cat_bucket").parquet(path)
    stored = SimpleNamespace(categories=spark.read.parquet(path), category_buckets=3)
    for fn in (lambda s: R.recommend_by_category(p, 1, stored=s),
               lambda s: R.recommend_with_requested_category(p, 5, None, "|Music|Rock", stored=s),
               lambda s: R.recommend_with_chosen_categories(p, 5, "Book", ["|Music|Rock"], stored=s),
               lambda s: R.recommend_by_category_and_title(p, 5, stored=s)):
        assert [tuple(r) for r in fn(stored).collect()] == [tuple(r) for r in fn(None).collect()]
    df = R.recommend_by_category(p, 1, stored=stored)
    df.collect()
    assert "dynamicpruningexpression" in df._jdf.queryExecution().executedPlan().toString()


def test_catalog_is_stored_per_table_and_released(spark):
    import glob
    import os

    from basketry.plans.store import StoredCatalog
    from tests.conftest import SF_SMALL

    c = StoredCatalog(spark, SF_SMALL)
    folder = c.path.removeprefix("file:")
    assert not os.path.exists(folder)
    assert c.edges.count() > 0 and [os.path.basename(x) for x in glob.glob(f"{folder}/*")] == ["edges"]
    c.release()
    assert not os.path.exists(folder)
