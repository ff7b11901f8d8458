"""Property-based checks (hypothesis) of the ranking and set helpers against plain Python."""

from __future__ import annotations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from basketry.functions.ranking import dense_rank_values, top_n_per_group
from basketry.functions.sets import jaccard, tokens

FAST = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@FAST
@given(st.lists(st.one_of(st.none(), st.integers(-50, 50)), min_size=1, max_size=200), st.booleans())
def test_dense_rank_property(spark, values, ascending):
    df = spark.createDataFrame([(v,) for v in values], "v long").repartition(5)
    got = {r.v: r.rank for r in dense_rank_values(df, "v", "rank", ascending=ascending).collect()}
    distinct = sorted({v for v in values if v is not None}, reverse=not ascending)
    assert got == {v: i + 1 for i, v in enumerate(distinct)}


@FAST
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 1000)), min_size=1, max_size=300), st.integers(1, 4))
def test_top_n_per_group_property(spark, rows, n):
    df = spark.createDataFrame(rows, "g long, x long").repartition(4)
    got = {}
    for r in top_n_per_group(df, ["g"], [F.desc("x")], n).collect():
        got.setdefault(r.g, []).append(r.x)
    want = {}
    for g, x in rows:
        want.setdefault(g, []).append(x)
    assert {g: sorted(v, reverse=True) for g, v in got.items()} == {g: sorted(v, reverse=True)[:n] for g, v in want.items()}


WORDS = st.lists(st.sampled_from(["red", "ring", "blue", "bolt", "Red", "café"]), max_size=5).map(" ".join)


@FAST
@given(st.lists(st.tuples(WORDS, WORDS), min_size=1, max_size=50))
def test_jaccard_property(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    out = df.select(jaccard(tokens("a"), tokens("b")).alias("ab"), jaccard(tokens("b"), tokens("a")).alias("ba")).collect()
    for (a, b), r in zip(pairs, out):
        sa, sb = set(a.lower().split()), set(b.lower().split())
        want = len(sa & sb) / len(sa | sb) if sa and sb else 0.0
        assert r.ab == r.ba and abs(r.ab - want) < 1e-12 and 0.0 <= r.ab <= 1.0
