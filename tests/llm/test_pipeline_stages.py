"""Stages of the pipeline on planted cases."""

from __future__ import annotations

import random

import corpus_pipeline
from basketry.llm import near_dedup as N
from tests.conftest import SF_SMALL
from tests.llm import brute
from tests.llm.conftest import odd_rows, prose
from tests.llm.test_packing_topk import check_pieces


def jaccard(a, b):
    a, b = brute.shingles(a), brute.shingles(b)
    return len(a & b) / len(a | b)


def near_pair(low, high, words=200):
    """A text and a near copy with a Jaccard similarity from ``low`` to below ``high``."""
    rnd = random.Random(8)
    base = prose(rnd, words, 10**6).split()
    for n in range(words):
        copy = " ".join([*base[:50], *(f"x{k}" for k in range(n)), *base[50 + n :]])
        if low <= jaccard(" ".join(base), copy) < high:
            return " ".join(base), copy
    raise ValueError("no such pair")


def test_bands_miss_few_pairs():
    assert N.banding(0.85) == (42, 6) and N.banding(0.8) == (51, 5)


def test_near_copies_from_0_8_on_go(spark):
    a, b = near_pair(0.81, 0.83)
    c, d = near_pair(0.77, 0.79)
    rows = [(1, a), (2, b), (3, c.replace("w", "y")), (4, d.replace("w", "y"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in N.near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}  # operator 2's contract
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF_SMALL).collect()) == [1, 3, 4]


def test_near_copies_go_through_the_pipeline(spark, tmp_path):
    a, b = near_pair(0.81, 0.83)
    rows = [(1, a, "en", "s", len(a)), (2, b, "en", "s", len(b)), (3, prose(random.Random(3), 60), "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    check_pieces(corpus_pipeline.run(spark, str(tmp_path)).collect(), [(1, a), (3, rows[2][1])])


def test_one_row_of_each_component_stays(spark, odd):
    rows = [(i, t) for i, t in odd_rows() if i is not None]
    texts = dict(enumerate(sorted({(i, t) for i, t in rows}, key=lambda r: (r[0], r[1] or ""))))
    groups = {k: c for k, (_, c) in brute.components([(k, t) for k, (_, t) in texts.items()], 80).items()}
    out = corpus_pipeline.drop_near_duplicates(spark, odd, SF_SMALL)
    got = [(r.doc_id, r.text) for r in out.collect()]
    known = [r for r in got if r[0] is not None]
    number = {r: k for k, r in texts.items()}
    assert sorted(groups[number[r]] for r in known) == sorted(set(groups.values()))
    assert sorted(i for i, _ in known) == sorted(texts[c][0] for c in set(groups.values()))
    assert len(got) - len(known) == 2 and out.columns == odd.columns


def test_repeated_rows_and_versions_keep_their_text(spark, tmp_path):
    a, b, c = (prose(random.Random(k), 60, 10**6) for k in (1, 2, 3))
    rows = [(1, a), (1, a), (2, b), (3, b), (3, c), (3, c)]
    docs = [(i, t, "en", "s", len(t)) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    check_pieces(corpus_pipeline.run(spark, str(tmp_path)).collect(), [(1, a), (2, b), (3, c)])
