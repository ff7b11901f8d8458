"""Operator 13 against a plain ranking and SQL."""

from __future__ import annotations

import collections
import math
import random
import re

import duckdb
import numpy as np
import pytest

from basketry.llm import lexical as L
from tests.conftest import SF_CHECK
from tests.llm.conftest import odd_rows

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, top=20):
    """(item_id, rank, doc_id, score) by scoring every document."""
    rows = [(i, collections.Counter(t), len(t)) for i, t in ((i, terms(t)) for i, t in docs) if t]
    n, length = len(rows), sum(r[2] for r in rows)
    df = collections.Counter(x for _, c, _ in rows for x in c)
    out = []
    for item, text in sorted(set(items), key=str):
        weights = {x: k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) for x, k in collections.Counter(terms(text)).items() if df[x]}
        scored = []
        for i, c, size in rows:
            m = 75 + 25 * size * n // length
            s = sum(w * (10**9 * c[x] // (1000 * c[x] + 12 * m)) for x, w in weights.items() if x in c)
            scored += [(-s, i is None, i or 0, i)] if s > 0 else []
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def ranked(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize("shard_bytes,shard_docs,item_terms", [(1 << 24, 1 << 16, 1 << 16), (20_000, 1 << 16, 40), (1 << 24, 3, 1 << 16)])
def test_odd_rows(spark, odd, shard_bytes, shard_docs, item_terms):
    items = [(1, "W1 w2, w3 w3 w4!"), (1, "w5 w6"), (2, None), (3, ""), (4, "... --"), (None, "é one two"), (5, odd_rows()[8][1]), (6, "nothing known 77"), (1, "w5 w6"),
             (7, "z" * 150_000), (8, "é" * 200)]
    index = L.build_index(odd, shard_bytes, shard_docs).cache()
    got = ranked(L.search(index, spark.createDataFrame(items, "item_id long, text string"), item_terms=item_terms))
    assert got == plain(odd_rows(), items) and len(got) > 20
    index.unpersist()


def test_ties_and_repeated_rows(spark):
    docs = [(k % 40, "same text here") for k in range(120)] + [(None, "same text here")] * 3 + [(7, "same text"), (900, "other words")]
    items = [(1, "same text"), (2, "Same"), (3, "words")]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int").repartition(6)
    assert ranked(L.search(L.build_index(df, shard_docs=7), spark.createDataFrame(items, "item_id long, text string"))) == plain(docs, items)


def test_empty_tables(spark, odd, empty):
    items = spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert L.search(L.build_index(empty), items).count() == 0
    assert L.search(L.build_index(odd), items.where("item_id = 0")).count() == 0
    assert L.search(L.build_index(odd.where("doc_id in (2, 3)")), items).count() == 0


def shard_of(texts):
    """One opened shard, and its documents' term counts."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["_id", "_text"])
    (row,) = L._indexed(iter([batch]), 1 << 30, L.SHARD_DOCS)
    arrays = {c: np.frombuffer(row.column(c)[0].as_py(), kind) for c, kind in L.ARRAYS.items()}
    counts = [collections.Counter(terms(t)) for t in texts]
    n, length = len(texts), sum(sum(c.values()) for c in counts)
    return L.Shard(arrays, n, length), counts, n, length


def test_blocks_hold_their_postings_and_bounds_hold():
    rnd = random.Random(3)
    texts = [" ".join([f"w{min(int(rnd.expovariate(0.02)), 900)}" for _ in range(rnd.randrange(1, 120))] + ["often"] * rnd.choice([0, 1, 300, 70_000 if k == 5 else 1])) for k in range(1500)]
    shard, counts, n, length = shard_of(texts)
    for word in ("often", "w0", "w3", "w100", "w150"):
        hashes = L.terms_of(np.frombuffer(word.encode(), np.uint8), np.array([0, len(word)]))
        k = int(np.flatnonzero(shard.first_hash == hashes[0][0])[0])
        doc, impact = shard.whole(k)
        want = [(i, 10**9 * c[word] // (1000 * c[word] + 12 * (75 + 25 * sum(c.values()) * n // length))) for i, c in enumerate(counts) if word in c]
        assert list(zip(doc.tolist(), impact.tolist())) == want
        bounds = np.repeat(shard.bound[shard.block_at[k] : shard.block_at[k + 1]], shard.size[shard.block_at[k] : shard.block_at[k + 1]])
        assert (impact <= bounds).all() and impact.max() <= shard.list_bound[k] and len(bounds) == len(want)


def test_block_maxima_keep_blocks_closed():
    """A frequent term's list is not essential beside a rare one, and only the blocks of candidates are decoded."""
    texts = [f"common filler{k}" + (" rare" if k % 400 == 0 else "") for k in range(20_000)]
    shard, _, n, length = shard_of(texts)
    hashes = [L.terms_of(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0][0] for w in ("common", "rare")]
    where = np.array([np.flatnonzero(shard.first_hash == h)[0] for h in hashes])
    doc, sums = shard.search(where, np.array([1, 5000]), np.zeros(0, np.int64), 20, np.zeros(n, np.int64))
    assert set(doc.tolist()) == set(range(0, 20_000, 400)) and len(set(sums.tolist())) == 1
    assert shard.decoded < 60  # of 157 blocks of the frequent term
    before = shard.decoded
    shard.search(where, np.array([1, 5000]), np.full(20, int(sums[0]) + 50_000), 20, np.zeros(n, np.int64))
    assert shard.decoded == before  # no document can reach the threshold


def test_query_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_CHECK}/{t}.parquet'")
    assert ranked(L.op13_lexical_search(spark, SF_CHECK)) == sorted(con.execute(L.OP13_SQL).fetchall(), key=str)
