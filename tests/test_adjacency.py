"""Searches over stored adjacencies: same results as over plain edges, no shuffle of the edges, hubs in parts."""

from __future__ import annotations

import random

import pytest

from basketry.operators import graph as G
from tests.test_graph import py_bfs
from tests.test_plans import plan_of


def random_graph(seed, n=200, m=300):
    rnd = random.Random(seed)
    hub = [(0, k) for k in range(1, n, 3)] + [(k, 0) for k in range(2, n, 7)]
    return [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)] + hub


def some(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "id long")


@pytest.mark.parametrize("hub_edges", [10, 1_000_000])
def test_search_on_adjacency_equals_plain(spark, scratch, hub_edges):
    edges = random_graph(5)
    labelled = [(a, b, "xy"[(a + b) % 2]) for a, b in edges]
    df = spark.createDataFrame(labelled, "src long, dst long, label string")
    adjacency = G.store_adjacency(df, f"{scratch}/a", hub_edges=hub_edges)
    assert (adjacency.hubs is None) == (hub_edges > 100)
    for directed in (False, True):
        for labels in (None, ["x"]):
            kept = [(a, b) for a, b, c in labelled if a != b and (labels is None or c in labels)]
            got = {r.id: r.depth for r in G.bfs(adjacency, some(spark, [3]), labels, directed=directed).collect()}
            assert got == py_bfs(kept, 3, directed)
    if adjacency.hubs is not None:  # no salt of the hub has all of its edges
        worst = adjacency.rows.where("src = 0").groupBy("salt").count().collect()
        assert len(worst) > 5 and max(r["count"] for r in worst) < 40
    spark.sql(f"DROP TABLE {adjacency.table}")


def test_a_hop_shuffles_the_frontier_only(spark, scratch):
    edges = spark.createDataFrame(random_graph(6), "src long, dst long")
    for hub_edges in (10, 1_000_000):
        adjacency = G.store_adjacency(edges, f"{scratch}/{hub_edges}", hub_edges=hub_edges)
        plan = plan_of(adjacency.step(some(spark, [3, 4])))
        lines = plan.split("\n")
        scan = next(i for i, line in enumerate(lines) if "FileScan parquet" in line and "dst" in line)
        depth = lambda line: len(line) - len(line.lstrip(" :+-"))
        path = []  # from the scan up to the root
        for line in reversed(lines[: scan + 1]):
            if not path or depth(line) < depth(path[-1]):
                path.append(line)
        above = [line for line in path if "Join" not in line]
        joined = next(i for i, line in enumerate(path) if "ShuffledHashJoin" in line)
        assert "Bucketed: true" in lines[scan] and not any("Exchange" in line for line in path[:joined]), plan
        assert above
        spark.sql(f"DROP TABLE {adjacency.table}")


@pytest.mark.parametrize("seed", range(4))
def test_two_ended_search_equals_bfs(spark, seed):
    rnd = random.Random(seed)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(280)]
    df = spark.createDataFrame(edges, "src long, dst long")
    targets = rnd.sample(range(300), 6)
    dist = py_bfs([e for e in edges if e[0] != e[1]], 7)
    near = min((dist[t] for t in targets if t in dist), default=None)
    want = sorted((t, near) for t in targets if near is not None and dist.get(t) == near)
    got = G.nearest_targets(df, some(spark, [7]), some(spark, targets))
    assert sorted((r.id, r.depth) for r in got.collect()) == want
    again = G.bfs(df, some(spark, [7]), targets=some(spark, targets))
    assert sorted((r.id, r.depth) for r in again.collect()) == want


def test_two_ended_search_reads_less(spark, monkeypatch):
    """A tree of fan-out 6, from its root to one leaf four hops away: one search visits all, two meet in the middle."""
    edges, level, n = [], [0], 1
    for _ in range(4):
        below = []
        for v in level:
            edges += [(v, n + k) for k in range(6)]
            below += range(n, n + 6)
            n += 6
        level = below
    df = spark.createDataFrame(edges, "src long, dst long")
    visited = []
    level_of = G._level
    monkeypatch.setattr(G, "_level", lambda *a: visited.append(level_of(*a)) or visited[-1])
    assert [(r.id, r.depth) for r in G.bfs(df, some(spark, [0]), targets=some(spark, [n - 1])).collect()] == [(n - 1, 4)]
    one = sum(v.count() for v in visited)
    visited.clear()
    assert [(r.id, r.depth) for r in G.nearest_targets(df, some(spark, [0]), some(spark, [n - 1])).collect()] == [(n - 1, 4)]
    assert 2 * sum(v.count() for v in visited) < one
    visited.clear()
    assert G.nearest_targets(df, some(spark, [0]), some(spark, [10**6])).count() == 0
    assert G.nearest_targets(df, some(spark, [0, 5]), some(spark, [5, 9])).collect()[0].depth == 0


def test_edges_of_repeated_records_are_distinct(spark):
    rows = [(1, "A", "a", "Book", 1.0, 1, 1.0, ["B"], ["|x"]), (2, "A", "a again", "Book", 1.0, 1, 1.0, ["B", "C"], ["|x", "|y"]), (3, "B", "b", "Book", 1.0, 1, 1.0, [], ["|x"])]
    from tests.test_graph import SCHEMA

    p = spark.createDataFrame(rows, SCHEMA)
    co = spark.createDataFrame([(1, 3, 1), (2, 3, 1)], "src long, dst long, weight long")
    got = [tuple(r) for r in G.edges(p, co).collect()]
    assert len(got) == len(set(got)) and ("product:A", "product:B", "co_purchase") in got and ("product:A", "category:|x", "belongs_to") in got
