"""Tasks of the catalogue's large steps follow the rows: same results, more tasks, hubs in parts."""

from __future__ import annotations

import random
from collections import Counter
from itertools import permutations

import pytest

from basketry.functions import ranking
from basketry.operators import catalog as C
from basketry.operators import graph as G
from basketry.operators.recommend import recommend_all
from tests.conftest import SF_SMALL

LINES = "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double"


def lines(spark, seed=3):
    rnd = random.Random(seed)
    rows = [(rnd.randrange(60), rnd.choice([1, 2, rnd.randrange(30)]), k % 7, 1.0) for k in range(400)]
    return spark.createDataFrame([*rows, *rows[:20], (None, 4, 1, 1.0), (5, None, 1, 1.0)], LINES)


def weights(df):
    orders: dict = {}
    for r in df.collect():
        if r.l_orderkey is not None and r.l_partkey is not None:
            orders.setdefault(r.l_orderkey, set()).add(r.l_partkey)
    return Counter(p for parts in orders.values() for p in permutations(sorted(parts), 2))


@pytest.mark.parametrize("hub_lines", [20, 1_000_000])
def test_similars_of_line_items(spark, hub_lines):
    df = lines(spark)
    found = weights(df)
    want = {}
    for (a, b), n in found.items():
        want.setdefault(a, []).append((-n, b))
    got = {r.id: r.similars for r in C.similars_from_lines(df, C.part_stats(df), hub_lines=hub_lines).collect()}
    assert got == {a: [f"{b:010d}" for _, b in sorted(x)[:5]] for a, x in want.items()}


def test_edges_are_dealt_by_their_number(spark, monkeypatch):
    df = lines(spark)
    monkeypatch.setattr(ranking, "ROWS_PER_TASK", 10)
    edges = C.copurchase_edges(df)
    assert {(r.src, r.dst): r.weight for r in edges.collect()} == {k: n for k, n in weights(df).items() if k[0] < k[1]}
    assert edges.rdd.getNumPartitions() > 50
    p = spark.createDataFrame([(k, f"a{k // 2}", f"g{k % 2}", ["|c"], []) for k in range(30)], "id long, asin string, group string, categories array<string>, similars array<string>")
    out = G.edges(p, edges)
    assert out.count() == out.distinct().count() and out.rdd.getNumPartitions() > 10


@pytest.mark.parametrize("hub_edges", [3, 1_000_000])
def test_adjacency_places(spark, hub_edges):
    pairs = [(1, k) for k in range(2, 12)] + [(2, 3), (2, 3), (5, 4)]
    df = spark.createDataFrame([(a, b, 1) for a, b in pairs], "src long, dst long, weight long")
    want: dict = {}
    for a, b in {*pairs, *((b, a) for a, b in pairs)}:
        want.setdefault(a, set()).add(b)
    got = sorted(map(tuple, C.adjacency(df, directed=False, hub_edges=hub_edges).collect()))
    assert got == sorted((a, i, b) for a, x in want.items() for i, b in enumerate(sorted(x), 1))
    ring = spark.range(200).selectExpr("id AS src", "(id + 1) % 200 AS dst", "1 AS weight")
    plan = C.adjacency(ring, directed=False)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan  # one shuffle by node where there is no hub


def test_distinct_undirected_with_loops_and_nulls(spark):
    rows = [("a", "b", "x"), ("b", "a", "x"), ("a", "b", "y"), ("c", "c", "x"), ("c", "c", "x"), ("d", None, "x"), (None, "d", "x"), (None, None, "x")]
    df = spark.createDataFrame(rows, "src string, dst string, label string")
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, G.distinct_undirected(df).collect()), key=key) == sorted(map(tuple, G.undirected(df).distinct().collect()), key=key)


def test_recommend_all_of_shared_categories(spark, monkeypatch):
    """A candidate of several categories takes one place; candidates are not made distinct before they are ranked."""
    monkeypatch.setattr(ranking, "ROWS_PER_TASK", 10)
    rows = [(k, f"a{k}", f"t{k}", "g", float(k + 1), k, 4.0, ["|c", "|d", f"|e{k % 2}"], []) for k in range(9)]
    p = spark.createDataFrame(rows, "id long, asin string, title string, group string, salesrank double, total_reviews long, avg_rating double, categories array<string>, similars array<string>")
    out = recommend_all(p, 3)
    got = out.collect()
    assert sorted((r.id, r["rank"]) for r in got) == [(k, i) for k in range(9) for i in (1, 2, 3)]
    best = [r.rec_id for r in sorted(got, key=lambda r: (r.id, r["rank"])) if r.id == 4]
    assert len(set(best)) == 3 and 4 not in best
    assert out.rdd.getNumPartitions() > 8
    assert "ShuffledHashJoin" in out._jdf.queryExecution().executedPlan().toString()  # the products' side is not broadcast


def test_graph_rows_repeats_each_product_once(spark):
    """Empty and null lists and unknown products keep their rows; one explode after the join, none on its repeated rows before."""
    p = spark.createDataFrame(
        [(1, "a1", ["x", "y"], ["|c", "|d"]), (2, "a2", [], ["|c"]), (3, None, ["x"], None), (4, "a4", None, [None])],
        "id long, asin string, similars array<string>, categories array<string>",
    ).selectExpr("*", "asin AS title", "asin AS group", "1.0D AS salesrank", "1L AS total_reviews", "1.0D AS avg_rating")
    out = C.graph_rows(p, spark.createDataFrame([(1, 2, 1), (3, 4, 1), (1, 9, 1)], "src long, dst long, weight long"))
    first = [(1, s, c) for s in "xy" for c in ("|c", "|d")]
    want = [(i, to, s, c) for to in (2, 9) for i, s, c in first] + [(2, 1, None, "|c"), (3, 4, "x", None), (4, 3, None, None), (9, 1, None, None)]
    got = [(r.id, r.to, r.similar, r.category) for r in out.collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Generate ") == 2  # the neighbours and the rows


def test_graph_rows_of_hubs(spark, monkeypatch):
    """Hubs, with and without a product, give the rows they gave; nodes are dealt to as many tasks as the pairs ask."""
    p = spark.createDataFrame(
        [(1, "a1", ["x", "y"], ["|c", "|d"]), (2, "a2", [], ["|c"]), (2, "a2 again", ["z"], None), (None, "a0", ["x"], ["|c"])],
        "id long, asin string, similars array<string>, categories array<string>",
    ).selectExpr("*", "asin AS title", "asin AS group", "1.0D AS salesrank", "1L AS total_reviews", "1.0D AS avg_rating")
    pairs = [(1, k, 1) for k in range(2, 40)] + [(k, 50, 1) for k in range(2, 30)] + [(None, 1, 1), (1, None, 1), (60, 61, 1)]
    e = spark.createDataFrame(pairs, "src long, dst long, weight long")
    monkeypatch.setattr(ranking, "ROWS_PER_TASK", 10)
    plain = C.graph_rows(p, e)
    laid = {1: [("a1", s, c) for s in "xy" for c in ("|c", "|d")], 2: [("a2", None, "|c"), ("a2 again", "z", None)]}
    both = [x for a, b, _ in pairs for x in ((a, b), (b, a))]
    want = Counter((a, to, *row) for a, to in both for row in laid.get(a, [(None, None, None)]))
    for hub_partners in (750_000, 20, 1):
        got = C.graph_rows(p, e, hub_partners).collect()
        assert Counter((r.id, r.to, r.asin, r.similar, r.category) for r in got) == want
    plan = plain._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan  # the products are not sent whole to every task
    assert plain.rdd.getNumPartitions() == 14  # of 138 pairs


@pytest.mark.parametrize("hub_lines", [20, 1_000_000])
def test_similars_of_stored_edges(spark, hub_lines):
    df = lines(spark)
    stats = C.part_stats(df)
    got = {r.id: r.similars for r in C.similars_from_edges(C.copurchase_edges(df), stats, hub_lines=hub_lines).collect()}
    assert got == {r.id: r.similars for r in C.similars_from_lines(df, stats, hub_lines=hub_lines).collect()}


def test_graph_rows_query_makes_pairs_once_and_rounds_products(spark, monkeypatch):
    from basketry.plans import registry, store

    def never(*a, **k):
        raise AssertionError("the edges are stored: similars come from them")

    monkeypatch.setattr(store, "_STORED", {})
    monkeypatch.setattr(store, "similars_from_lines", never)
    out = registry.q_graph_rows(spark, SF_SMALL)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "round(" not in plan[: plan.index("Join")]  # below the join: once a product
    assert out.count() > 0
    store.release_catalogs(spark)
