"""Operators 6 and 7 against the tokenizer, a plain search and SQL."""

from __future__ import annotations

import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from basketry.llm import packing as P
from basketry.llm import topk as K
from tests.conftest import SF_CHECK
from tests.llm.conftest import odd_rows


def check_pieces(rows, texts):
    """Pieces of each text rebuild its ids; pieces of each sequence lie gapless."""
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, t in texts:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want += [(i, s, min(2048, len(ids) - s), zlib.crc32(ids[s : s + 2048].tobytes()), len(ids)) for s in range(0, len(ids), 2048)]
    key = lambda r: (r[0] is not None, r)
    assert sorted(((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows), key=key) == sorted(want, key=key)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 2048
    return len(by), sum(r.length for r in rows)


def test_pieces_of_odd_rows(odd, empty):
    check_pieces(P.pack_documents(odd).collect(), odd_rows())
    assert P.pack_documents(empty).count() == 0


def test_special_tokens_marks_and_cases(spark):
    texts = ["Hello, World! it's DON'T...", "<|endoftext|> and <|ENDOFTEXT|> <|startoftext|>x", "a.b. c, d;e É. ñ! 3.5, 7?", "...  ,a ,, .", "ﬁ １２ Ａ. ǅ ß."]
    rows = list(enumerate(texts))
    check_pieces(P.pack_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def test_packing_of_a_table_has_little_padding(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    rows = P.pack_documents(docs).collect()
    sequences, ids = check_pieces(rows, [(r.doc_id, r.text) for r in docs.collect()])
    assert ids / sequences / 2048 > 0.99


def test_best_fit_takes_the_tightest_room():
    rnd = random.Random(2)
    for _ in range(50):
        lengths = np.sort([rnd.randrange(1, 65) for _ in range(rnd.randrange(1, 80))])[::-1]
        sequence, offset = P.best_fit(lengths, 64)
        room, want = [], []
        for n in lengths:
            fits = [(r, s) for s, r in enumerate(room) if r >= n]
            want.append(min(fits)[0] if fits else 64)
            s = next(s for s, r in enumerate(room) if r == min(fits)[0]) if fits else len(room)
            if fits:
                room[s] -= n
            else:
                room.append(64 - n)
        assert len(set(sequence.tolist())) == len(room)
        assert [64 - o for o in offset] == want


def test_groups_bound_a_task(spark):
    pieces = spark.range(1000).select(
        F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("start"), (F.col("id") % 2000 + 1).alias("length"),
        F.lit(0).cast("long").alias("ids_crc32"), F.lit(1).cast("long").alias("doc_tokens"))
    out = P.pack(pieces, group_pieces=100)
    assert out.count() == 1000 and out.select((F.col("sequence_id") / (1 << 32)).cast("long")).distinct().count() > 5


def test_topk_of_a_table(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF_CHECK}/embeddings.parquet'")
    want = sorted(con.execute(K.OP7_SQL).fetchall())
    vectors = spark.read.parquet(f"{SF_CHECK}/embeddings.parquet")
    for bucket_rows, local_cosine in ((4096, 0.6), (40, 0.6), (40, 0.0), (40, 2.0)):  # both prunings, and neither
        got = K.top_products(vectors, F.col("vec_id") % 50 == 0, bucket_rows=bucket_rows, local_cosine=local_cosine)
        assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == want


def test_topk_of_odd_vectors(spark):
    rnd = random.Random(4)
    rows = [(i, [rnd.choice([-1.0, 0.0, 0.5, 3.0]) for _ in range(4)], "x") for i in range(120)]  # many ties
    rows += [(200, None, "x"), (250, [1.0, None, 2.0, 0.0], "x"), (300, [1.0, float("nan"), 2.0, 0.0], "x"), (350, [float("inf"), 0.0, 0.0, 0.0], "x"),
             (400, [0.0, 0.0, 0.0, 0.0], "x"), (450, [-9.0, -9.0, -9.0, -9.0], "x"), (7, rows[7][1], "x"), (None, [1.0, 1.0, 1.0, 1.0], "x"),
             (500, [1.0, 2.0], "x"), (501, [4.0, 4.0], "x"), (550, [], "x"), (600, [1e6, 1e6, -1e6, 1e6], "x"),
             (100, [2.0, 2.0, 2.0, 2.0], "x"), (100, [2.0, 2.0, 2.0, 2.0], "x"), (100, [-1.0, 0.0, 0.0, 0.0], "x")]  # four queries share an id
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string").repartition(3)
    usable = [(i, [int(np.floor(256 * x)) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for k, (q, v) in enumerate(usable):
        if q % 50 == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w)), i) for j, (i, w) in enumerate(usable) if j != k and len(w) == len(v))
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:5])]
    for bucket_rows, query_rows in ((4096, 4096), (16, 4096), (16, 3)):
        got = K.top_products(df, F.col("vec_id") % 50 == 0, bucket_rows=bucket_rows, query_rows=query_rows).collect()
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", [(i, v) for i, v, _ in rows])
    assert sorted(con.execute(K.OP7_SQL).fetchall()) == sorted(want)
    assert K.top_products(df.where("vec_id = -1"), F.col("vec_id") % 50 == 0).count() == 0


def test_equal_vectors_of_one_id_fill_many_buckets(spark):
    rows = spark.range(3000).select(F.lit(50).cast("long").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    buckets = K.length_buckets(K.quantised(rows), 256).select(F.length("ids") / 8).collect()
    assert sum(r[0] for r in buckets) == 3000 and max(r[0] for r in buckets) < 512


def test_equal_pieces_are_dealt_over_the_groups(spark):
    pieces = spark.range(4000).select(
        F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("start"), F.lit(700).cast("long").alias("length"), F.lit(9).cast("long").alias("ids_crc32"),
        F.lit(700).cast("long").alias("doc_tokens"))
    out = P.pack(pieces, group_pieces=500)
    sizes = [r["count"] for r in out.groupBy((F.col("sequence_id") / (1 << 32)).cast("long")).count().collect()]
    assert sum(sizes) == 4000 and max(sizes) < 1000
