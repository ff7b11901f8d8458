"""Driver contract: entry, queries, SQL oracle on the smallest tables."""

from __future__ import annotations

import math

import duckdb

import __spark_entry__ as E
from tests.conftest import SF_SMALL

TABLES = ["part", "orders", "lineitem"]


def own(named: dict) -> dict:
    """Without the training-data queries, which have their tests in tests/llm."""
    return {k: v for k, v in named.items() if not k.startswith("op") and k != "pipeline"}


def norm(v):
    if v is None:
        return ""
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{round(v, 6):.6f}"
    return str(v)


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["asin", "title", "score"]
    assert 0 < df.count() <= 5


def test_every_query_has_sql():
    assert set(own(E.queries())) == set(own(E.oracle_sql()))
    assert set(E.oracle_sql()) <= set(E.queries())


def test_queries_match_sql(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    sqls = E.oracle_sql()
    for name, fn in own(E.queries()).items():
        df = fn(spark, SF_SMALL)
        rows = [tuple(r) for r in df.collect()]
        res = con.execute(sqls[name])
        cols = [d[0] for d in res.description]
        assert sorted(cols) == sorted(df.columns), name
        assert canon(df.columns, rows) == canon(cols, res.fetchall()), name
