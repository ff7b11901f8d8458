"""Stored indexes give what the scans give, and read less: title postings, category runs, path trigrams."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from basketry.operators import recommend as R
from basketry.operators import similarity as S
from basketry.operators.catalog import bucketed_product_categories
from basketry.operators.category_grams import store_category_grams
from basketry.operators.category_runs import store_category_runs
from basketry.operators.title_index import store_title_index
from tests.test_graph import SCHEMA
from tests.test_plans import plan_of

WORDS = ["red", "blue", "box", "car", "tea", "Élan", "42", "of", "the", "ring"]


def catalogue(spark, seed=3, n=160):
    """Products with repeated titles and asins, null titles, ranks and ratings, and few categories."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        title = None if rnd.random() < 0.05 else " ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(0, 7)))
        asin = None if rnd.random() < 0.05 else f"A{rnd.randrange(n)}"
        cats = rnd.sample([f"|{g}|c{k}" for g in ("Book", "Music") for k in range(4)] + ["|x", ""], rnd.randrange(0, 4))
        rank = rnd.choice([None, 0.0, *map(float, range(1, 9))])
        rows.append((i, asin, title, rnd.choice(["Book", "Music", None]), rank, rnd.randrange(3), rnd.choice([None, 1.0, 4.5]), [f"A{rnd.randrange(n)}" for _ in range(3)], cats))
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("ngram", [None, 3])
def test_title_index_equals_scan(spark, scratch, ngram):
    p = catalogue(spark)
    index = store_title_index(p, f"{scratch}/t", ngram, rows_per_bucket=60)
    assert index.buckets > 3
    for pid in (0, 7, 33, 10**6):
        for t in (0.3, 0.6, 1.0):
            assert rows(S.title_matches(p, pid, t, ngram, index=index)) == rows(S.title_matches(p, pid, t, ngram)), (pid, t)
    assert rows(S.similar_titles(p, 7, 0.3, ngram, False, index)) == rows(S.similar_titles(p, 7, 0.3, ngram, False))
    with pytest.raises(ValueError):
        S.similar_titles(p, 7, 0.3, 4, index=index)
    with pytest.raises(ValueError):
        S.similar_titles(p, 7, 0.0, ngram, index=index)


def test_title_request_reads_its_tokens_folders(spark, scratch):
    p = catalogue(spark)
    index = store_title_index(p, f"{scratch}/t", rows_per_bucket=40)
    pid = p.where("size(split(title, ' ')) >= 3").first().id
    plan = plan_of(S.similar_titles(p, pid, 0.5, index=index))
    scan = next(line for line in plan.split("\n") if "FileScan" in line)
    assert "tok_bucket" in scan.split("PartitionFilters")[1].split("PushedFilters")[0] and "In(tok" in scan and "GreaterThanOrEqual(n," in scan
    assert "Join" not in plan and "Exchange" not in plan


class Tables:
    """What the recommenders take as stored tables."""

    def __init__(self, spark, products, path, depth):
        self.category_buckets = 3
        rows_ = bucketed_product_categories(products, 3)
        rows_.write.partitionBy("cat_bucket").parquet(f"{path}/categories")
        self.categories = spark.read.schema(rows_.schema).parquet(f"{path}/categories")
        self.category_runs = store_category_runs(self.categories, 3, f"{path}/runs", depth)
        self.category_grams = store_category_grams(self.categories, f"{path}/grams", rows_per_bucket=20)
        self.title_index = store_title_index(products, f"{path}/titles", rows_per_bucket=60)


def scores(df):
    """Scores and asins; products without an asin tie, so only how many there are of a score is certain."""
    return sorted(str((r.score, r.asin if r.asin is not None else "-")) for r in df.collect())


@pytest.mark.parametrize("depth", [30, 3])
def test_recommenders_by_runs_equal_scans(spark, scratch, depth):
    p = catalogue(spark)
    with_categories = [r.id for r in p.where("size(categories) > 1").orderBy("id").limit(3).collect()]
    stored = Tables(spark, p, scratch, depth)
    for pid in with_categories:
        for n in (1, 4):
            for args in ((R.recommend_by_category, (p, pid, None, None, n)), (R.recommend_by_category_and_title, (p, pid, None, None, n, 0.4)),
                         (R.recommend_with_chosen_categories, (p, pid, "Book", [" |Music|c1", "|x"], n)), (R.recommend_with_requested_category, (p, pid, None, " |Music|c2", n))):
                fn, call = args
                assert scores(fn(*call, stored=stored)) == scores(fn(*call)), (fn.__name__, pid, n)


def test_a_request_reads_few_rows_of_each_run(spark, scratch):
    p = catalogue(spark, n=400)
    stored = Tables(spark, p, scratch, 50)
    wanted = spark.createDataFrame([("|Book|c1",), ("|Music|c3",), ("|x",)], "category string")
    assert p.where("array_contains(categories, '|x')").count() > 20
    found = stored.category_runs.candidates(wanted, 4, 10**6)
    assert 3 * 5 <= found.count() <= 3 * 5 * 2
    assert "LessThanOrEqual(rank,5)" in plan_of(found)
    assert stored.category_runs.rows.groupBy("category", "by_group", "group").count().agg(F.max("count")).first()[0] <= 50
    assert not stored.category_runs.serves(50) and stored.category_runs.serves(49)


def test_substring_requests_by_trigrams_equal_scans(spark, scratch):
    p = catalogue(spark)
    stored = Tables(spark, p, scratch, 10)
    for text in ("Book|c", "|c1", "|x", "", "c3", "k|c2 ", "usic", "none of them", "|Book|c0"):
        for asin, group in ((None, None), ("A7", "Book"), (None, "Music")):
            got, want = R.recommend(p, asin, group, text, 500, stored=stored), R.recommend(p, asin, group, text, 500)
            assert rows(got) == rows(want), text
    found = stored.category_grams.containing("|Music|c1")
    assert [r.category for r in found.collect()] == ["|Music|c1"]
    scans = [line for line in plan_of(found).split("\n") if "FileScan" in line]
    assert "gram_bucket" in scans[0].split("PartitionFilters")[1].split("PushedFilters")[0]


def test_banded_pairs_are_most_of_the_exact_ones(spark):
    rnd = random.Random(9)
    titles = [(i, " ".join(rnd.sample([f"w{k}" for k in range(60)], rnd.randrange(1, 7)))) for i in range(500)]
    p = spark.createDataFrame([*titles, (900, None), (901, ""), (902, "w1 w2"), (903, "w1 w2")], "id long, title string")
    exact = {(r.title_a, r.title_b): r.similarity for r in S.similar_title_pairs(p, 0.3).collect()}
    banded = {(r.title_a, r.title_b): r.similarity for r in S.similar_title_pairs_banded(p, 0.3, block=7).collect()}
    assert all(exact[k] == v for k, v in banded.items())
    assert len(banded) >= 0.9 * len(exact) > 300
    sure = [k for k, v in exact.items() if v >= 0.6]
    assert sure and all(k in banded for k in sure)
