"""Operators 2, 5 and 9 against plain versions."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest

from basketry.llm import near_dedup as N
from basketry.llm import repeat_dedup as R
from basketry.llm import suffix_dedup as S
from basketry.llm.graph import components
from tests.conftest import SF_CHECK
from tests.llm import brute
from tests.llm.conftest import odd_rows, prose


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=lambda r: (r[0] is not None, r))


def test_components(spark):
    rnd = random.Random(5)
    links = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(330)] + [(500 + k, 501 + k) for k in range(60)]
    parent = {x: x for link in links for x in link}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_near_duplicates_of_odd_rows(odd, empty):
    got = rows_of(N.near_duplicates(odd), "doc_id", "n_shingles", "component_id", "kept")
    rows = odd_rows()
    known = [(i, t) for i, t in rows if i is not None]
    versions = dict(known[::-1])
    want = brute.components([(i, t) for i, t in known if [j for j, _ in known].count(i) == 1 or i not in (71, 80)])
    for i, n, c, kept in got:
        if i is None:
            assert c is None and kept
        elif i in want:
            assert (n, c) == want[i] and kept == (i == c), i
    assert len(got) == len(rows) and versions
    assert N.near_duplicates(empty).count() == 0


def test_near_duplicates_of_a_table(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet").where("doc_id < 500")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(docs).collect()}
    assert got == brute.components([(r.doc_id, r.text) for r in docs.collect()])


def test_no_link_is_lost_between_members_of_a_hub(spark, monkeypatch):
    # near copies around the threshold: many are not linked to the hub, but some of them to each other
    rnd = random.Random(9)
    base, rows = prose(rnd, 120).split(), []
    for f in range(25):
        w = list(base)
        for _ in range(rnd.randrange(1, 7)):
            w[rnd.randrange(120)] = f"f{rnd.randrange(10**6)}"
        for k in range(6):
            v = list(w)
            for _ in range(rnd.randrange(0, 3)):
                v[rnd.randrange(120)] = f"k{rnd.randrange(10**6)}"
            rows.append((10 * f + k, " ".join(v)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.components(rows)
    assert 3 < len({c for _, c in want.values()}) < 100
    for block in (4000, 9):  # a hub's members as one block, and as a grid of blocks
        monkeypatch.setattr(N, "BLOCK_MEMBERS", block)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(docs).collect()} == want


def test_estimate_is_near_the_truth():
    rnd = np.random.default_rng(1)
    for n, share in ((60, 0.9), (400, 0.85), (5000, 0.5)):
        errors = []
        for _ in range(40):
            pool = rnd.integers(0, 2**63, 2 * n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            common = int(n * share)
            a, b = np.unique(pool[:n]), np.unique(np.concatenate([pool[:common], pool[n : 2 * n - common]]))
            truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            x = N.registers([a, b])
            got, _ = N.estimate(x[:1], x[1:], np.array([len(a)]), np.array([len(b)]))
            errors.append(got[0] - truth)
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_repeats_of_odd_rows(odd, empty):
    got = rows_of(R.remove_repeats(odd), "doc_id", "n_words", "n_removed", "kept_sha256")
    rows = odd_rows()
    want = brute.without_repeats([r for r in rows if r[0] is not None])
    alone = [(i, *r[1:]) for i, t in rows if i is None for r in brute.without_repeats([(0, t)])]
    assert got == sorted(alone, key=lambda r: r[1:]) + want or sorted(got[2:]) == want
    assert sorted(r for r in got if r[0] is not None) == want
    assert sorted(r[1:] for r in got if r[0] is None) == sorted(r[1:] for r in alone)
    assert R.remove_repeats(empty).count() == 0


def test_repeats_of_a_table(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    got = rows_of(R.remove_repeats(docs), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == brute.without_repeats([(r.doc_id, r.text) for r in docs.collect()])


def test_texts_without_repeats(odd):
    out = {(r.doc_id, r.n_chars): r for r in R.without_repeats(odd).select("doc_id", "text", "n_chars").collect()}
    assert R.without_repeats(odd).columns == odd.columns
    changed = [r for r in odd_rows() if 40 <= (r[0] or 0) < 52]
    for i, t in changed:
        r = next(x for k, x in out.items() if k[0] == i)
        assert r.text != t and r.n_chars == len(r.text)
    assert next(x for k, x in out.items() if k[0] == 53).text == next(t for i, t in odd_rows() if i == 53)


def test_shared_bytes_of_odd_rows(odd, empty):
    cols = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    got = rows_of(S.remove_shared_bytes(odd), *cols)
    rows = odd_rows()
    assert [r for r in got if r[0] is not None] == brute.without_shared_bytes([r for r in rows if r[0] is not None])
    assert sorted(r[1:] for r in got if r[0] is None) == sorted(r[1:] for i, t in rows if i is None for r in brute.without_shared_bytes([(0, t)]))
    assert S.remove_shared_bytes(empty).count() == 0


def test_shared_bytes_of_a_table(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet").where("doc_id < 400")
    cols = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    want = brute.without_shared_bytes([(r.doc_id, r.text) for r in docs.collect()])
    assert rows_of(S.remove_shared_bytes(docs), *cols) == want
    # every anchor hot: the grouped minimum gives the same
    lost = S.shared_bytes_removed(docs, hot_segments=1)
    assert sorted((r.doc_id, r.n_removed, r.n_spans, r.kept_sha256) for r in lost.collect()) == [(r[0], *r[2:]) for r in want if r[2]]


@pytest.mark.parametrize("seed", range(20))
def test_windows_of_a_smaller_owner(seed):
    rnd = random.Random(seed)
    for _ in range(20):
        window = rnd.choice([3, 5, 8])
        segments = [bytes(rnd.choice(b"ab\x00\xffc") for _ in range(window + rnd.randrange(15))) for _ in range(rnd.randrange(1, 30))]
        docs = np.array([rnd.randrange(9) for _ in segments])
        low = {}
        for s, d in zip(segments, docs):
            for k in range(len(s) - window + 1):
                low[s[k : k + window]] = min(low.get(s[k : k + window], 99), d)
        want = [[k for k in range(len(s) - window + 1) if low[s[k : k + window]] < d] for s, d in zip(segments, docs)]
        assert [x.tolist() for x in S.smaller_owner(segments, docs, window)] == want


def test_suffixes_are_sorted():
    rnd = random.Random(3)
    segments = [bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(6, 30))) for _ in range(50)]
    text, order, begin = S.suffix_array(segments, 6)
    joined = b"\0".join(segments) + b"\0"
    suffixes = [joined[i : i + 6].split(b"\0")[0] for i in order]
    assert suffixes == sorted(suffixes)
    starts = {int(b) + k for b, s in zip(begin, segments) for k in range(len(s) - 5)}
    assert starts <= set(order.tolist())


def test_segments_are_shuffled_once(spark):
    """No hot anchor: the segments' bytes go to their group and nowhere else. Hot anchors are told by a small table."""
    rnd = random.Random(4)
    rows = [(k % 5, k, "v", 0, bytes(rnd.choice(b"ab") for _ in range(55))) for k in range(40)]
    segments = spark.createDataFrame(rows, S.SEGMENTS)
    shuffles = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hash")
    assert shuffles(S.resolved(segments)) == 1

    def starts(df):
        return sorted((r.doc, int(x)) for r in df.collect() for x in np.frombuffer(r.starts, np.int64))

    want = starts(S.resolved(segments, 20))
    assert want and starts(S.resolved(segments, 20, hot_segments=7)) == want


def test_the_disk_holds_no_shuffled_texts_afterwards(spark):
    """op5's steps free their shuffle files themselves, whenever the driver collects its garbage."""
    rnd = random.Random(6)
    passage = prose(rnd, 60)
    docs = spark.createDataFrame([(k, prose(rnd, 3000) + passage) for k in range(60)], "doc_id long, text string")

    def held():
        files, n = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator(), 0
        while files.hasNext():
            f = files.next()
            n += f.length() if f.getName().startswith("shuffle_") else 0
        return n

    before = held()
    lost = S.shared_bytes_removed(docs)
    end = time.time() + 20
    while held() - before > 50_000 and time.time() < end:
        time.sleep(0.1)
    assert held() - before <= 50_000 and lost.count() == 59
