"""Jaccard semantics and the exact all-pairs title join against brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from basketry.functions.sets import jaccard, pooled_jaccard, tokens
from basketry.operators import similarity as S


def py_tokens(text):
    import regex

    return set(w for w in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if w)


def py_jaccard(a, b):
    if not a or not b:
        return 0.0
    return len(a & b) / len(a | b)


CASES = [
    ("red ring", "red ring", 1.0),
    ("red ring", "blue bolt", 0.0),
    ("", "blue bolt", 0.0),
    (None, "blue bolt", 0.0),
    ("a b c d e f g h i j", "a b c x y z q r s t", 3 / 17),
    ("Ring ring RING", "ring", 1.0),
    ("Café au lait", "cafe AU lait", 0.5),
]


def test_jaccard_cases(spark):
    df = spark.createDataFrame([(a, b) for a, b, _ in CASES], "a string, b string")
    got = [r[0] for r in df.select(jaccard(tokens("a"), tokens("b"))).collect()]
    assert got == pytest.approx([c for _, _, c in CASES])


def test_exactly_at_threshold_is_kept(spark):
    # 3 shared of 10 distinct words: exactly 0.3
    a = "w1 w2 w3 a4 a5 a6 a7"
    b = "w1 w2 w3 b4 b5 b6"
    assert py_jaccard(py_tokens(a), py_tokens(b)) == 0.3
    products = spark.createDataFrame(
        [(1, "0000000001", a, "G", 1.0, 1, 1.0, [], ["|c"]), (2, "0000000002", b, "G", 2.0, 1, 1.0, [], ["|c"])],
        "id long, asin string, title string, group string, salesrank double, total_reviews long, "
        "avg_rating double, similars array<string>, categories array<string>",
    )
    m = S.title_matches(products, 1, 0.3, include_self=False).collect()
    assert [r["id"] for r in m] == [2] and m[0]["similarity"] == pytest.approx(0.3)
    pairs = S.similar_title_pairs(products, 0.3).collect()
    assert len(pairs) == 1


def test_pooled_jaccard(spark):
    df = spark.createDataFrame(
        [(["a", "b"], [["a"], ["b", "c"]]), ([], [["a"]]), (["a"], [])], "a array<string>, s array<array<string>>"
    )
    got = [r[0] for r in df.select(pooled_jaccard("a", "s")).collect()]
    # (1 + 1) / (2 + 3)
    assert got == pytest.approx([0.4, 0.0, 0.0])


@pytest.mark.parametrize("seed,threshold", [(1, 0.3), (2, 0.5), (3, 0.8)])
def test_all_pairs_join_equals_brute_force(spark, seed, threshold):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(25)]
    titles = sorted({" ".join(rnd.sample(vocab, rnd.randint(1, 8))) for _ in range(150)})
    products = spark.createDataFrame(
        [(i, f"{i:010d}", t, "G", [], []) for i, t in enumerate(titles)],
        "id long, asin string, title string, group string, similars array<string>, categories array<string>",
    )
    got = {(r.title_a, r.title_b): r.similarity for r in S.similar_title_pairs(products, threshold).collect()}
    want = {}
    for i, a in enumerate(titles):
        for b in titles[i + 1:]:
            j = py_jaccard(py_tokens(a), py_tokens(b))
            if j >= threshold:
                want[(min(a, b), max(a, b))] = j
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == pytest.approx(v)


def test_char_ngrams(spark):
    df = spark.createDataFrame([("abcd",), ("ab",), ("",)], "t string")
    got = [sorted(r[0]) for r in df.select(S.char_ngrams("t", 3)).collect()]
    assert got == [["abc", "bcd"], ["ab"], []]


def test_jaccard_symmetric_and_bounded(spark):
    rnd = random.Random(5)
    words = ["x", "y", "z", "w", "v"]
    rows = [(" ".join(rnd.choices(words, k=rnd.randint(0, 4))), " ".join(rnd.choices(words, k=rnd.randint(0, 4))))
            for _ in range(200)]
    df = spark.createDataFrame(rows, "a string, b string")
    out = df.select(jaccard(tokens("a"), tokens("b")).alias("ab"), jaccard(tokens("b"), tokens("a")).alias("ba"))
    assert out.where((F.col("ab") != F.col("ba")) | (F.col("ab") < 0) | (F.col("ab") > 1)).count() == 0


def test_all_pairs_join_cuts_hot_tokens_into_a_grid(spark):
    # one token in every title: with a tiny block its postings are a grid of many cells
    rnd = random.Random(8)
    titles = sorted({"hot " + " ".join(rnd.sample([f"w{i}" for i in range(12)], rnd.randint(0, 3))) for _ in range(200)})
    products = spark.createDataFrame(
        [(i, f"{i:010d}", t, "G", [], []) for i, t in enumerate(titles)],
        "id long, asin string, title string, group string, similars array<string>, categories array<string>",
    )
    salted = {(r.title_a, r.title_b): r.similarity for r in S.similar_title_pairs(products, 0.5, block=7).collect()}
    plain = {(r.title_a, r.title_b): r.similarity for r in S.similar_title_pairs(products, 0.5, block=10**6).collect()}
    want = {(a, b) for i, a in enumerate(titles) for b in titles[i + 1:]
            if py_jaccard(py_tokens(a), py_tokens(b)) >= 0.5}
    assert set(salted) == set(plain) == want
