"""Operator 11 against a plain trie and SQL."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import duckdb
from pyspark.sql import functions as F

from basketry.llm import prefix_trie as T
from tests.conftest import SF_CHECK

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, depth int, seq string, k1 string"


def plain(rows):
    """Each node straight from its definition; rows: (conv_id, turn, role, text)."""
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, tie, (role, text)))
    own = {c: [x[-1] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - c % 20 if c >= 0 else c + (-c) % 20
        built[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = collections.defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        words = len(WORD.findall(p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * words
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def nodes(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def check(spark, rows, parts=4):
    df = spark.createDataFrame([(*r, 1, "s", "k") for r in rows], SCHEMA).repartition(parts)
    assert nodes(T.prefix_trie(df)) == plain(rows)


def test_odd_conversations(spark):
    rnd = random.Random(6)
    rows = []
    for c in [*range(0, 90), -3, -20, -21, 10**12 + 7, 10**12 - 5]:
        for turn in range(rnd.randrange(0, 6)):
            rows.append((c, turn if rnd.random() < 0.9 else None, rnd.choice(["user", "assistant", None]), rnd.choice(["a", "a b", "", None, " c\td ", "é ü"])))
    rows += rows[:6] + [(5, 1, "user", "a")] * 4 + [(None, 0, "user", "a"), (None, None, None, None)]
    rows += [(40, 0, "1:u", "x"), (60, 0, "1", ":ux"), (81, 3, "user", "w " * 50_000)]
    check(spark, rows)


def test_many_branches_on_one_path(spark):
    """Sequences that leave one long path at every depth, and one that goes on after all others."""
    rows = []
    for k in range(24):
        c = 1000 + 20 * k  # multiples of 20 keep their own turns
        rows += [(c, d, "u", f"t{d}") for d in range(k)] + [(c, k, "u", f"leaf{k % 5}")]
    rows += [(2000, d, "u", f"t{d}") for d in range(70)]
    check(spark, rows)


def test_equal_conversations_and_turnless_ones(spark):
    rows = [(20 * k, d, "u", f"t{d}") for k in range(30) for d in range(3)]
    rows += [(c, 0, "u", "x") for c in range(1001, 1012)]  # their base is absent: those that replace a turn have none left
    check(spark, rows)


def test_empty(spark):
    df = spark.createDataFrame([(None, 1, "u", "t")], "conv_id long, turn long, role string, text string")
    assert T.prefix_trie(df).count() == T.prefix_trie(df.where("turn = 0")).count() == 0


def test_two_fattest(spark):
    pairs = [(a, b) for a in range(40) for b in range(a + 1, 41)]
    got = spark.createDataFrame(pairs, "a long, b long").withColumn("f", T.two_fattest("a", "b")).collect()
    for a, b, f in got:
        assert f == max(range(a + 1, b + 1), key=lambda x: x & -x)


def test_a_long_conversation_is_spread(spark):
    """Running values of one key over many ranges."""
    df = spark.range(5000).select(F.lit(1).alias("k"), F.col("id").alias("o"), (F.col("id") % 7).alias("s"), F.xxhash64("id").alias("x"))
    out = T.running(df, ["k"], [F.col("o")], {"s": "sum", "x": "xor"}).orderBy("o").collect()
    total, bits = 0, 0
    for r, x in zip(out, [r.x for r in df.collect()]):
        total, bits = total + r.o % 7, bits ^ x
        assert (r.s, r.x) == (total, bits)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF_CHECK}/conversations.parquet'")
    rows = con.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    cursor = con.execute(T.OP11_SQL)
    assert [c[0] for c in cursor.description] == COLUMNS
    assert nodes(T.op11_prefix_trie(spark, SF_CHECK)) == sorted(cursor.fetchall(), key=str) == plain(rows)
