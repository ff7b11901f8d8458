"""Operator 2 where rows of one id have different texts."""

from __future__ import annotations

import random

from basketry.llm import near_dedup as N
from tests.llm import brute
from tests.llm.conftest import odd_rows, prose


def plain_components(rows):
    """(doc_id, text) -> component's smallest id; every different text of an id is a document of its own."""
    texts = sorted({(i, t) for i, t in rows if i is not None and brute.shingles(t)})
    numbers = dict(enumerate(texts))  # numbers follow the ids
    found = brute.components([(k, t) for k, (_, t) in numbers.items()])
    return {numbers[k]: numbers[c][0] for k, (_, c) in found.items()}


def check(spark, rows):
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    want = plain_components(rows)
    want = [(i, len(brute.shingles(t)), want.get((i, t), i)) for i, t in rows]
    key = lambda r: (r[0] is not None, r)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=key) == sorted(want, key=key)


def test_odd_rows_with_versions(spark):
    check(spark, odd_rows())


def test_each_version_keeps_its_links(spark):
    rnd = random.Random(4)
    rows = []
    for k in range(0, 60, 3):  # two versions of one id, each with a near copy of its own under a later id
        for copy in (k + 1, k + 2):
            words = prose(rnd, 150, 10**6).split()
            rows += [(k, " ".join(words)), (copy, " ".join([*words[:-1], "end"]))]
    check(spark, rows)
