"""Property graph, BFS against a plain Python BFS, path pattern query."""

from __future__ import annotations

import random
from collections import deque

from basketry.operators import graph as G

SCHEMA = (
    "id long, asin string, title string, group string, salesrank double, total_reviews long, avg_rating double, "
    "similars array<string>, categories array<string>"
)


def py_bfs(edges, source, directed=False):
    adj = {}
    for a, b in edges:
        adj.setdefault(a, set()).add(b)
        if not directed:
            adj.setdefault(b, set()).add(a)
    dist = {source: 0}
    q = deque([source])
    while q:
        v = q.popleft()
        for w in adj.get(v, ()):
            if w not in dist:
                dist[w] = dist[v] + 1
                q.append(w)
    return dist


def test_bfs_matches_python(spark):
    rnd = random.Random(3)
    edges = [(rnd.randint(0, 199), rnd.randint(0, 199)) for _ in range(260)]
    df = spark.createDataFrame(edges, "src long, dst long")
    for directed in (False, True):
        src = spark.createDataFrame([(0,)], "id long")
        got = {r.id: r.depth for r in G.bfs(df, src, directed=directed).collect()}
        want = py_bfs([(a, b) for a, b in edges if a != b], 0, directed)
        assert got == want


def test_bfs_max_depth_and_targets(spark):
    chain = [(i, i + 1) for i in range(10)]
    df = spark.createDataFrame(chain, "src long, dst long")
    src = spark.createDataFrame([(0,)], "id long")
    assert max(r.depth for r in G.bfs(df, src, max_depth=3).collect()) == 3
    targets = spark.createDataFrame([(7,), (9,)], "id long")
    assert [(r.id, r.depth) for r in G.bfs(df, src, targets=targets).collect()] == [(7, 7)]
    unreachable = spark.createDataFrame([(99,)], "id long")
    assert G.bfs(df, src, targets=unreachable).count() == 0


def graph_products(spark):
    rows = [
        (1, "A", "a", "Book", 5.0, 3, 4.0, ["B"], ["|x", "|y"]),
        (2, "B", "b", "Book", 3.0, 3, 3.0, ["A"], ["|x"]),        # avg_rating exactly 3.0: excluded
        (3, "C", "c", "Music", 2.0, 3, 4.5, [], ["|x", "|y"]),    # other group, reachable by two categories
        (4, "D", "d", "Book", 0.0, 3, 5.0, [], ["|x"]),           # salesrank 0: excluded
        (5, "E", "e", "Book", None, 3, 5.0, [], ["|x"]),          # null rank: excluded
        (6, "F", "f", "Book", 9.0, 3, 3.5, [], ["|x"]),
        (7, "G", "g", "DVD", 1.0, 3, 4.0, [], ["|z"]),            # unreachable
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_vertices_and_edges(spark):
    p = graph_products(spark)
    co = spark.createDataFrame([(1, 2, 1), (2, 6, 2)], "src long, dst long, weight long")
    v = G.vertices(p)
    assert v.where("kind = 'product'").count() == 7
    assert sorted(r.id for r in v.where("kind = 'group'").collect()) == ["group:Book", "group:DVD", "group:Music"]
    e = G.edges(p, co)
    labels = {r.label: r.n for r in e.groupBy("label").count().withColumnRenamed("count", "n").collect()}
    assert labels == {"has_group": 7, "belongs_to": 9, "falls_under": 5, "is_similar_to": 2, "co_purchase": 2}


def test_path_top_n(spark):
    p = graph_products(spark)
    v, e = G.vertices(p), G.edges(p)
    got = [r.asin for r in G.path_top_n(v, e, "A", "Book", "|x", 5).collect()]
    assert got == ["C", "F"]
    assert G.path_top_n(v, e, "A", "Music", "|x", 5).count() == 0  # a is not in Music
    assert [r.asin for r in G.path_top_n(v, e, "A", "Book", "|x", 1).collect()] == ["C"]


def test_bfs_to_group_and_reachable(spark):
    p = graph_products(spark)
    co = spark.createDataFrame([(1, 2, 1), (2, 3, 1)], "src long, dst long, weight long")
    v, e = G.vertices(p), G.edges(p, co)
    near = [(r.asin, r.depth) for r in G.bfs_to_group(v, e, "A", "Music").collect()]
    assert near == [("C", 2)]
    reach = {r.asin: r.depth for r in G.reachable_products(v, e, "A").collect()}
    assert "G" not in reach and reach["A"] == 0 and reach["B"] == 1 and reach["C"] == 2
