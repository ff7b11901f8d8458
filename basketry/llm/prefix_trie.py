"""Operator 11: the trie of conversation prefixes as a z-fast trie.

Conversations are rows of turns throughout, so one with very many turns is spread like any other.

1. Rebuild. Turns are numbered by a running count over ranges of (conversation, turn). A conversation takes the first
   turns of the one its id falls back to, then its own; its turns are rows (conversation, depth).
2. Prefixes. Every turn has 128 bits drawn from (depth, role, text); a prefix is named by the exclusive or of its turns'
   bits, a running aggregate over ranges. Conversations that are equal as a whole become one sequence with a count.
3. Trie. A compacted node stands for the depths (a, b] that no sequence leaves or ends at before b; it is hashed by its
   handle, the name of its prefix at the two-fattest depth of (a, b] (the one with the most trailing zero bits). All
   sequences that are not in the trie yet form a batch. Each finds its exit node by fat binary search: it probes the
   handles at the two-fattest depths of the interval left, log2(length) joins; the last node met, or its child by the next
   turn, is the exit node, and the depth up to which they agree is found along it. Where sequences leave or end inside a node the node is split there; of the sequences that leave
   at one place by the same next turn the longest is added as a leaf, the others are the next batch. Batches end when no
   sequence is left; each is written, so lineage stays short.
4. Sums over subtrees by doubling: after k steps a node has the sums of all nodes less than 2^k below it and its ancestor
   2^k above, log2(height) joins of compacted nodes. What prefixes save follows from sums of the words up to each
   sequence's end.
5. Nodes are expanded to one row for each of their depths.

Hot groups: equal turns, conversations and prefixes are counted before they are shuffled; a prefix that very many
conversations share is one node. The ids that end at a node are joined by ranges of ids and hashed as a stream, in
constant memory (SHA-256 of one text cannot be split further).

Cases: turns are ordered by turn (null first), equal ones by a hash of role and text; null role or text is empty; rows
without ``conv_id`` take no part; a conversation without rebuilt turns ends at the root; repeated rows are turns of their
own; a turn's text may have any length, it is read once for its hash and its words; an empty table gives no rows, not
even the root; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketry.llm.scratch import bucketed, read_table, ship, stored

#: A conversation falls back to conv_id - conv_id % STEP, for crc32(conv_id) % HEADS turns.
STEP = 20
HEADS = 4
WORD = r"[^\x20\x09-\x0D]+"
NAME = ["k1", "k2"]


def _xor(name: str) -> Column:
    return F.bit_xor(name)


def running(df: DataFrame, keys: list[str], order: list[Column], totals: dict[str, str]) -> DataFrame:
    """``df`` with each column of ``totals`` replaced by its running value over the rows of the same ``keys`` in ``order``
    (total within a key): "sum" or "xor". A key's rows are spread over ranges; each range's totals are one row."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(df.repartitionByRange(n, *keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    fold = {c: (F.sum if how == "sum" else _xor) for c, how in totals.items()}
    own = [*keys, "_range"]
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy(*own).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    offsets = ranged.groupBy(*own).agg(*(fold[c](c).alias(f"_{c}") for c in totals))
    offsets = offsets.select(*own, *(F.coalesce(fold[c](f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in totals))
    rows = ranged.select(*(c for c in ranged.columns if c not in totals), *(fold[c](c).over(within).alias(c) for c in totals))
    both = rows.join(offsets, own).drop("_range")
    joined = {c: F.col(c) + F.col(f"_{c}") if how == "sum" else F.col(c).bitwiseXOR(F.col(f"_{c}")) for c, how in totals.items()}
    return both.withColumns(joined).drop(*(f"_{c}" for c in totals))


def rebuilt(conversations: DataFrame, step: int = STEP, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """``conv_id, depth, length, words, pair`` of every rebuilt turn (``pair``: hash of role and text), and ``conv_id,
    length`` of every conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    pair = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    rows = conversations.where(F.col("conv_id").isNotNull())
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", pair.alias("pair"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    rows = rows.groupBy("conv_id", "turn", "pair").agg(F.count(F.lit(1)).alias("n"), F.max("words").alias("words"))
    order = [F.col("turn").asc_nulls_first(), F.col("pair")]
    counted = stored(running(rows.withColumn("upto", F.col("n")), ["conv_id"], order, {"upto": "sum"}), "turns")
    own = counted.select("conv_id", "pair", "words", F.explode(F.sequence(F.col("upto") - F.col("n") + 1, F.col("upto"))).alias("place"))

    head = F.crc32(F.col("conv_id").cast("string")) % heads
    convs = counted.groupBy("conv_id").agg(F.max("upto").alias("turns"))
    convs = convs.select("conv_id", "turns", head.alias("head"), (F.col("conv_id") - F.col("conv_id") % step).alias("base"))
    bases = convs.where(F.col("conv_id") % step == 0).select(F.col("conv_id").alias("base"), F.col("turns").alias("base_turns"))
    taken = F.least("head", F.coalesce("base_turns", F.lit(0)))
    left = F.greatest(F.col("turns") - F.col("head"), F.lit(0))
    convs = convs.join(bases, "base", "left").select("conv_id", "base", "head", taken.alias("taken"), (taken + left).alias("length"))
    convs = stored(convs, "conversations")
    first = own.where((F.col("conv_id") % step == 0) & (F.col("place") < heads)).select(F.col("conv_id").alias("base"), "place", "pair", "words")
    first = first.join(convs.where("taken > 0"), "base").where("place <= taken").select("conv_id", F.col("place").alias("depth"), "length", "words", "pair")
    rest = own.join(convs.where("length > taken"), "conv_id").where("place > head")
    rest = rest.select("conv_id", (F.col("place") - F.col("head") + F.col("taken")).alias("depth"), "length", "words", "pair")
    return first.unionByName(rest), convs.select("conv_id", "length")


def named(turns: DataFrame) -> DataFrame:
    """``conv_id, depth, length, words, upto, k1, k2``: the name of each turn's prefix and the words up to its end."""
    bits = F.md5(F.concat(F.col("depth").cast("string"), F.lit(":"), F.col("pair")))
    halves = [F.conv(F.substring(bits, at, 16), 16, -10).cast("long").alias(c) for at, c in ((1, "k1"), (17, "k2"))]
    rows = turns.select("conv_id", "depth", "length", "words", F.col("words").alias("upto"), *halves)
    return running(rows, ["conv_id"], [F.col("depth")], {"upto": "sum", "k1": "xor", "k2": "xor"})


def two_fattest(low: str, high: str) -> Column:
    """The number in (low, high] with the most trailing zero bits."""
    return F.expr(f"{high} & shiftleft(-1L, length(bin({low} ^ {high})) - 1)")


NODE = "seq long, a long, b long, f long, k1 long, k2 long, c1 long, c2 long, e1 long, e2 long"


def _with_names(nodes: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``a, b, seq`` with ``f``, the two-fattest depth of (a, b], and the names of the sequence's prefixes there (the
    handle k1, k2), at a + 1 (c1, c2) and at b (e1, e2)."""
    out = nodes.withColumns({"f": two_fattest("a", "b"), "c": F.col("a") + 1, "e": F.col("b")})
    for depth, name in (("f", "k"), ("c", "c"), ("e", "e")):
        out = out.join(prefixes.select("seq", F.col("depth").alias(depth), F.col("k1").alias(f"{name}1"), F.col("k2").alias(f"{name}2")), ["seq", depth])
    return out.select("seq", "a", "b", "f", "k1", "k2", "c1", "c2", "e1", "e2")


def _exits(batch: DataFrame, nodes: DataFrame, prefixes: DataFrame, longest: int) -> DataFrame:
    """``seq, length, a, b, node, z1, z2, at``: each sequence's exit node (a sequence on it as ``node``, its handle as z1,
    z2; null at the root) and the depth ``at`` up to which they agree."""
    names = prefixes.select("seq", F.col("depth").alias("probe"), F.col("k1").alias("q1"), F.col("k2").alias("q2"))
    node = F.struct("a", "b", "f", F.col("seq").alias("node"), F.col("k1").alias("z1"), F.col("k2").alias("z2"), "e1", "e2")
    handles = nodes.select(F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("f").alias("probe"), node.alias("hit"))
    state = batch.withColumns({"low": F.lit(0).cast("long"), "high": F.col("length"), "best": F.lit(None).cast(handles.schema["hit"].dataType)})
    for _ in range(longest.bit_length()):
        open_ = F.col("low") < F.col("high")
        probed = state.withColumn("probe", F.when(open_, two_fattest("low", "high"))).join(names, ["seq", "probe"], "left")
        probed = probed.join(handles, ["q1", "q2", "probe"], "left")
        hit = F.col("hit").isNotNull()
        state = probed.select(
            "seq", "length", F.when(hit, F.col("hit.b")).otherwise(F.col("low")).alias("low"),
            F.when(open_ & ~hit, F.col("probe") - 1).otherwise(F.col("high")).alias("high"), F.coalesce("hit", "best").alias("best"),
        )
    # the last node whose handle agrees; if it agrees to its end, the child that begins with the next turn
    state = state.withColumn("probe", F.col("best.b")).join(names, ["seq", "probe"], "left")
    ended = F.col("best").isNull() | F.coalesce((F.col("q1") == F.col("best.e1")) & (F.col("q2") == F.col("best.e2")), F.lit(False))
    state = state.select("seq", "length", "best", ended.alias("ended"), F.when(ended, F.coalesce("best.b", F.lit(0)) + 1).alias("probe"))
    child = nodes.select(F.col("c1").alias("q1"), F.col("c2").alias("q2"), (F.col("a") + 1).alias("probe"), node.alias("child"))
    state = state.join(names, ["seq", "probe"], "left").join(child, ["q1", "q2", "probe"], "left")
    agreed = F.when(F.col("child").isNotNull(), F.col("probe")).when(F.col("ended"), F.col("probe") - 1).otherwise(F.col("best.f"))
    found = state.select("seq", "length", agreed.alias("agreed"), F.coalesce("child", "best").alias("at_node"))
    found = stored(found.select("seq", "length", "agreed", "at_node.a", "at_node.b", "at_node.node", "at_node.z1", "at_node.z2"), "exit-nodes")
    # the depths after the one that is known to agree are compared one by one
    end = F.least("b", "length")
    inside = found.where(F.col("node").isNotNull() & (end > F.col("agreed"))).select("seq", "node", F.explode(F.sequence(F.col("agreed") + 1, end)).alias("depth"))
    mine = prefixes.select("seq", "depth", "k1", "k2")
    its = prefixes.select(F.col("seq").alias("node"), "depth", "k1", "k2")
    agree = inside.join(mine, ["seq", "depth"]).join(its, ["node", "depth", "k1", "k2"]).groupBy("seq").agg(F.max("depth").alias("agree"))
    return found.join(agree, "seq", "left").withColumn("at", F.coalesce("agree", "agreed")).drop("agree", "agreed")


def build_trie(sequences: DataFrame, prefixes: DataFrame, longest: int) -> DataFrame:
    """Compacted nodes (``NODE``) of the trie of ``sequences`` (``seq, length``), whose prefixes are
    ``prefixes`` (``seq, depth, k1, k2``). Every node has its depths (a, b], a sequence it lies on, and its handle."""
    spark = sequences.sparkSession
    batch, nodes = sequences, spark.createDataFrame([], NODE)
    while not batch.isEmpty():
        exits = stored(_exits(batch, nodes, prefixes, longest), "exits")
        after = prefixes.select("seq", (F.col("depth") - 1).alias("at"), F.col("k1").alias("n1"), F.col("k2").alias("n2"))
        leaving = stored(exits.where("at < length").join(after, ["seq", "at"]).select("seq", "length", "at", "n1", "n2"), "leaving")
        # one sequence for each place and next turn; the longest, so that a long path is not added piece by piece
        longest_of = F.max(F.struct("length", F.xxhash64("seq").alias("h"), "seq", "at")).alias("it")
        chosen = stored(leaving.groupBy("n1", "n2").agg(longest_of).select("it.length", "it.seq", "it.at"), "chosen")
        leaves = chosen.select(F.col("at").alias("a"), F.col("length").alias("b"), "seq")
        cuts = exits.where("at < b").select("z1", "z2", "a", "b", "node", "at").distinct()
        touched = cuts.select("z1", "z2", "a", "b", "node").distinct()
        ends = cuts.unionByName(touched.withColumn("at", F.col("b")))
        above = F.lag("at").over(Window.partitionBy("z1", "z2").orderBy("at"))
        pieces = ends.select(F.coalesce(above, "a").alias("a"), F.col("at").alias("b"), F.col("node").alias("seq"))
        whole = nodes.join(touched.select(F.col("z1").alias("k1"), F.col("z2").alias("k2")), NAME, "left_anti")
        new = _with_names(leaves.unionByName(pieces), prefixes)
        nodes = stored(whole.unionByName(new.select(*whole.columns)), "nodes")
        batch = stored(leaving.select("seq", "length").join(chosen.select("seq"), "seq", "left_anti"), "batch")
    return nodes


def _subtrees(nodes: DataFrame, values: list[str]) -> DataFrame:
    """``k1, k2`` and the sums of ``values`` (the least of ``least``) over the node and all below it. Nodes have their
    name at b (k1, k2) and their parent's (p1, p2)."""
    sums = stored(nodes.select(*NAME, "least", *values), "sums")
    up = stored(nodes.where("a > 0").select(*NAME, F.col("p1").alias("t1"), F.col("p2").alias("t2")), "ancestors")
    while not up.isEmpty():
        fold = [F.min("least").alias("x_least"), *(F.sum(c).alias(f"x_{c}") for c in values)]
        more = up.join(sums, NAME).groupBy("t1", "t2").agg(*fold).withColumnsRenamed({"t1": "k1", "t2": "k2"})
        added = [F.least("least", "x_least").alias("least"), *((F.col(c) + F.coalesce(f"x_{c}", F.lit(0))).alias(c) for c in values)]
        sums = stored(sums.join(more, NAME, "left").select(*NAME, *added), "sums")
        next_ = up.select(F.col("k1").alias("t1"), F.col("k2").alias("t2"), F.col("t1").alias("u1"), F.col("t2").alias("u2"))
        up = stored(up.join(next_, ["t1", "t2"]).select(*NAME, F.col("u1").alias("t1"), F.col("u2").alias("t2")), "ancestors")
    return sums


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash for each run of equal names, over texts joined by commas."""
    name, state = None, None
    for batch in batches:
        done: list[tuple[int, int, str]] = []
        for k1, k2, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if (k1, k2) != name:
                if state:
                    done.append((*name, state.hexdigest()))
                name, state = (k1, k2), hashlib.sha256(ids.as_py().encode())
            else:
                state.update(f",{ids.as_py()}".encode())
        yield _hashes(done)
    if state:
        yield _hashes([(*name, state.hexdigest())])


def _hashes(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    a, b, c = zip(*rows) if rows else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.string())], [*NAME, "ends_sha256"])


def _end_hashes(ends: DataFrame) -> DataFrame:
    """``k1, k2, ends_sha256`` of the conversations (``conv_id, k1, k2``) that end at each prefix: ids of one range of
    ids are joined in it, the pieces of a prefix are hashed in the order of their ranges."""
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = ends.repartitionByRange(n, "conv_id").withColumn("_range", F.spark_partition_id())
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = ranged.groupBy(*NAME, "_range").agg(ids.alias("ids"))
    rows = pieces.repartition(n, *NAME).sortWithinPartitions(*NAME, "_range").select(*NAME, "ids")
    return rows.mapInArrow(_streamed, "k1 long, k2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, step: int = STEP, heads: int = HEADS) -> DataFrame:
    """One row for each distinct prefix of the rebuilt conversations: ``conv_id`` (smallest member), ``depth``,
    ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``."""
    ship(conversations.sparkSession)
    turns, convs = rebuilt(conversations, step, heads)
    prefix = stored(named(turns), "prefixes")
    ends = prefix.where("depth = length").select("conv_id", *NAME)
    turnless = convs.where("length = 0").select("conv_id", F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"))
    whole = prefix.where("depth = length").groupBy(*NAME).agg(F.min("conv_id").alias("seq"), F.count(F.lit(1)).alias("n"), F.max("length").alias("length"))
    sequences = stored(whole, "sequences")
    own = prefix.join(sequences.select(F.col("seq").alias("conv_id")), "conv_id", "left_semi")
    own = own.select(F.col("conv_id").alias("seq"), "depth", *NAME, "upto", "words")
    with bucketed(own, ["seq", "depth"], "trie_prefixes") as prefixes:
        return _rows(prefixes, sequences, ends.unionByName(turnless), convs)


def _rows(prefixes: DataFrame, sequences: DataFrame, ends: DataFrame, convs: DataFrame) -> DataFrame:
    """The written rows of ``prefix_trie``: the trie of the ``sequences``, its sums, and its nodes expanded. ``ends``: the name
    of the prefix that each conversation ends at."""
    longest = sequences.agg(F.max("length")).first()[0] or 0
    compact = build_trie(sequences.select("seq", "length"), prefixes, longest)

    # names and words at both ends of each node, the sequences that end there, the children
    bottom = prefixes.select("seq", F.col("depth").alias("b"), *NAME, F.col("upto").alias("upto_b"))
    top = prefixes.select("seq", F.col("depth").alias("a"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("upto").alias("upto_a"))
    zero = F.lit(0).cast("long")
    nodes = compact.select("seq", "a", "b").join(bottom, ["seq", "b"]).join(top, ["seq", "a"], "left")
    nodes = nodes.withColumns({c: F.coalesce(c, zero) for c in ("p1", "p2", "upto_a")})
    nodes = stored(nodes.join(sequences.select(*NAME, F.col("n").alias("members"), F.col("seq").alias("least")), NAME, "left"), "trie")
    children = nodes.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, NAME, "left").select(
        "seq", "a", "b", *NAME, "p1", "p2", "upto_a", "least", F.coalesce("members", zero).alias("members"), F.coalesce("n_children", zero).alias("n_children"),
        F.col("n_children").isNull().cast("long").alias("leaves"), (F.coalesce("members", zero) * F.col("upto_b")).alias("passed"), (F.col("upto_b") - F.col("upto_a")).alias("distinct"),
    )
    nodes = stored(nodes, "trie")
    sums = stored(_subtrees(nodes, ["members", "leaves", "passed", "distinct"]), "subtrees")
    # words of all members below the node's top, less those of the distinct prefixes
    saved = F.col("passed") - F.col("members") * F.col("upto_a") - F.col("distinct")
    full = nodes.select("seq", "a", "b", *NAME, "p1", "p2", "upto_a", "n_children").join(sums, NAME).withColumn("saved", saved)
    above = sums.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("least").alias("above"))
    end_hashes = stored(_end_hashes(ends), "end-hashes")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    root = stored(convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0"), "root")
    full = full.join(above, ["p1", "p2"], "left").join(end_hashes, NAME, "left")
    full = stored(full.withColumn("above", F.coalesce("above", root.select("conv_id").scalar())), "trie")

    rows = full.withColumn("depth", F.explode(F.sequence(F.col("a") + 1, F.col("b"))))
    rows = rows.join(prefixes.select("seq", "depth", (F.col("upto") - F.col("words")).alias("upto_d")), ["seq", "depth"])
    at_end = F.col("depth") == F.col("b")
    expanded = rows.select(
        F.col("least").alias("conv_id"), "depth",
        F.when(F.col("depth") > F.col("a") + 1, F.col("least")).otherwise(F.col("above")).alias("parent_conv_id"),
        F.col("members").alias("n_convs"), F.when(at_end, F.col("n_children")).otherwise(F.lit(1)).alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("saved") - (F.col("members") - 1) * (F.col("upto_d") - F.col("upto_a"))).alias("saved_tokens"),
        F.when(at_end, F.coalesce("ends_sha256", nothing)).otherwise(nothing).alias("ends_sha256"),
    )
    first = full.where("a = 0")
    totals = {"n_children": F.count(F.lit(1)), "n_leaves": F.coalesce(F.sum("leaves"), F.lit(1)), "saved_tokens": F.coalesce(F.sum("saved"), zero)}
    top_row = root.withColumns({c: first.agg(value).scalar() for c, value in totals.items()}).withColumns({
        "depth": zero, "parent_conv_id": F.lit(None).cast("long"),
        "ends_sha256": end_hashes.where("k1 = 0 and k2 = 0").agg(F.coalesce(F.max("ends_sha256"), nothing)).scalar(),
    })
    return stored(expanded.unionByName(top_row.select(*expanded.columns)), "prefix-nodes")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read_table(spark, sf_dir, "conversations"))


OP11_SQL = r"""
WITH turns AS (
  SELECT conv_id AS c, turn, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words,
    md5(len(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS pair
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT c, words, pair, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, pair) AS place FROM turns
), counted AS (
  SELECT c, count(*) AS turns, c - c % 20 AS base, CAST(xor(list_reduce(list_prepend(4294967295::BIGINT,
      flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END), 4294967295) % 4 AS BIGINT) AS head
  FROM own GROUP BY c
), convs AS (
  SELECT a.c, a.base, a.head, least(a.head, coalesce(b.turns, 0)) AS taken, least(a.head, coalesce(b.turns, 0)) + greatest(a.turns - a.head, 0) AS length
  FROM counted a LEFT JOIN counted b ON b.c = a.base
), rebuilt AS (
  SELECT convs.c, place AS d, words, pair, length FROM convs JOIN own ON own.c = convs.base AND place <= taken
  UNION ALL
  SELECT convs.c, place - head + taken AS d, words, pair, length FROM convs JOIN own ON own.c = convs.c AND place > head
), prefixes AS (
  SELECT c, d, length, words, md5(string_agg(pair, ',') OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING)) AS k FROM rebuilt
  UNION ALL
  SELECT c, 0, length, 0, 'root' FROM convs
), nodes AS (
  SELECT k, min(c) AS conv_id, max(d) AS depth, count(*) AS n_convs, max(words) AS words,
    string_agg(c, ',' ORDER BY c) FILTER (d = length) AS ends FROM prefixes GROUP BY k
), parents AS (
  SELECT n.k, p.k AS parent FROM nodes n JOIN prefixes p ON p.c = n.conv_id AND p.d = n.depth - 1
), children AS (
  SELECT parent AS k, count(*) AS n_children FROM parents GROUP BY parent
), below AS (
  SELECT p.k, sum(CASE WHEN c.k IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n.n_convs - 1) * n.words) AS saved_tokens
  FROM nodes n JOIN prefixes p ON p.c = n.conv_id AND p.d <= n.depth LEFT JOIN children c ON c.k = n.k GROUP BY p.k
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children,
  CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM nodes n JOIN below USING (k) LEFT JOIN children USING (k) LEFT JOIN parents p ON p.k = n.k LEFT JOIN nodes u ON u.k = p.parent
"""
