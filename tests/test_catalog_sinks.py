"""Catalogue views, hot keys, sinks."""

from __future__ import annotations

import json
import os
import random

from pyspark.sql import functions as F

from basketry.operators import catalog as C
from basketry.operators import graph as G
from basketry.operators import recommend as R
from basketry.operators.explore import sample
from basketry.operators.profile import profile
from basketry.sources import sinks
from tests.test_recommend import SCHEMA, score


def test_hot_node_is_many_rows_in_many_tasks(spark):
    # node 0 holds a third of all edges
    edges = [(0, i) for i in range(1, 1001)] + [(i, i + 1) for i in range(1, 2001)]
    df = spark.createDataFrame(edges, "src long, dst long")
    adj = C.adjacency(df, directed=True)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions would be merged
    try:
        assert adj.where("src = 0").select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    hub = sorted((r.pos, r.dst) for r in adj.where("src = 0").collect())
    assert hub == [(i, i) for i in range(1, 1001)]
    assert adj.where("src <> 0").agg(F.max("pos")).first()[0] == 1 and adj.count() == 3000


def test_reviews_nested_keeps_every_review(spark):
    rows = [(1 if i % 3 == 0 else i, None, str(i // 2), 5, 1, 0) for i in range(600)]
    reviews = spark.createDataFrame(rows, "id long, date date, customer string, rating int, votes int, helpful int")
    nested = C.reviews_nested(reviews).collect()
    assert sum(r.times for r in nested) == 600
    one = sorted((r.pos, r.times) for r in nested if r.id == 1)
    assert [p for p, _ in one] == [1 + sum(t for _, t in one[:k]) for k in range(len(one))]


def test_copurchase_edges_pair_every_part_of_an_order(spark):
    rnd = random.Random(4)
    lines = [(o, rnd.randint(0, 40), n) for o in range(60) for n in range(rnd.randint(0, 9))]
    lines += [(1000, p, n) for n, p in enumerate(list(range(100)) + [3, 5, 5])] + [(None, 1, 1), (7, None, 1)]
    df = spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int")
    by_order = {}
    for o, p, _ in lines:
        if o is not None and p is not None:
            by_order.setdefault(o, set()).add(p)
    want = {}
    for parts in by_order.values():
        for a in parts:
            for b in parts:
                if a < b:
                    want[a, b] = want.get((a, b), 0) + 1
    for block in (1000, 7):  # the large order as one block, and as a grid of blocks
        assert {(r.src, r.dst): r.weight for r in C.copurchase_edges(df, block).collect()} == want


def test_graph_rows_keep_nodes_without_product_and_empty_lists(spark):
    products = spark.createDataFrame([(1, "A", "a", "Book", 1.0, 1, 4.0, [], ["|x", "|y"])], SCHEMA)
    edges = spark.createDataFrame([(1, 9, 1)], "src long, dst long, weight long")
    rows = sorted((r.id, r.to, r.asin, r.similar, r.category or "") for r in C.graph_rows(products, edges).collect())
    assert rows == [(1, 9, "A", None, "|x"), (1, 9, "A", None, "|y"), (9, 1, None, None, "")]


def test_recommend_all_with_a_hot_category(spark):
    rnd = random.Random(2)
    rows = [(i, f"{i:05d}", "t", "G", float(rnd.randint(1, 40)), rnd.randint(0, 3), 2.0, [],
             ["|hot"] if i % 3 == 0 else [f"|c{i % 17}"]) for i in range(600)]
    p = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in R.recommend_all(p, 3).collect():
        got.setdefault(r.id, []).append((r["rank"], r.rec_id))
    by_id = {r[0]: r for r in rows}
    for i, row in by_id.items():
        cands = [j for j, o in by_id.items() if j != i and set(o[8]) & set(row[8])]
        want = sorted(cands, key=lambda j: (-score(*by_id[j][4:7]), by_id[j][1]))[:3]
        assert [rid for _, rid in sorted(got[i])] == want


def test_sinks(spark, scratch):
    df = spark.createDataFrame([("A1", "red ring", 1.5), ("A2", None, 2.0)], "asin string, title string, score double")
    rows = [json.loads(r.value) for r in sinks.to_json_rows(df).collect()]
    assert rows == [{"asin": "A1", "title": "red ring", "score": 1.5}, {"asin": "A2", "score": 2.0}]
    env = sinks.response_rows(df).first()
    assert env.success is True and json.loads(env.data)["asin"] == "A1"
    sinks.write_json(df, os.path.join(scratch, "json"))
    assert spark.read.json(os.path.join(scratch, "json")).count() == 2
    products = spark.createDataFrame(
        [(1, "A", "a", "Book", 1.0, 1, 4.0, [], ["|x"]), (2, "B", "b", "DVD", 2.0, 1, 4.0, ["A"], ["|y"])], SCHEMA)
    sinks.write_graph(G.vertices(products), G.edges(products), os.path.join(scratch, "graph"))
    e = spark.read.parquet(os.path.join(scratch, "graph", "edges"))
    assert e.where(F.col("label") == "belongs_to").count() == 2 and e.count() == 7
    sinks.write_profile(profile(products, ["salesrank"]), os.path.join(scratch, "profile"))
    assert spark.read.parquet(os.path.join(scratch, "profile")).count() == 1


def test_sample_repeats_whatever_the_partitioning(spark):
    df = spark.range(5000).select(F.col("id"), (F.col("id") % 7).alias("g"))
    a = {r.id for r in sample(df.repartition(3), 0.2, 5).collect()}
    b = {r.id for r in sample(df.repartition(11), 0.2, 5).collect()}
    assert a == b and 800 < len(a) < 1200


def test_draw_tells_nulls_and_rows_apart(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None)], "x string, y string")
    from basketry.operators.explore import _as_text
    texts = {tuple(r) for r in df.select(_as_text(df, "x"), _as_text(df, "y")).collect()}
    assert texts == {("-", "=a"), ("=a", "-")}
    # a column with few values: rows are drawn one by one, not value by value
    few = spark.range(10_000).select("id", (F.col("id") % 5).cast("double").alias("v"))
    size = profile(few, ["v"], 0.1, seed=3).first().sample_size
    assert 850 < size < 1150
