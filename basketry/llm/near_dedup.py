"""Operator 2: near-duplicate documents by HyperMinHash.

1. Every document's distinct 5-word shingles are hashed once (64 bits). The top 8 bits choose one of 256
   registers, which keeps the least of the other 56 bits as leading-zero count and 10 mantissa bits. Documents
   with equal shingle sets (128-bit fingerprint) are one class, represented by its smallest document id.
2. Bands of each class's registers are keys (42 of 6 registers; below 0.85, more of fewer); an empty register borrows from a filled one chosen by its
   number (densification), so a short text's bands are as selective as a long one's. In each bucket of equal keys
   the smallest class is the hub; every other member is compared with the hub only, so a bucket makes as many
   pairs as it has members.
3. The registers' agreement, corrected for chance collisions, estimates the Jaccard similarity; pairs below the
   threshold by more than five standard errors are dropped.
4. Each class's best hub is verified on full shingle sets. Where a hub and its members are then in several
   components, those of different components are compared with each other, in blocks of full sets within tasks (a large group is a grid of blocks): registers first, then the sets.
   Only links that join components leave the task, so no link between components is lost to the choice of hubs and
   a group gives at most as many rows as it has members.
5. Links become components by large-star / small-star steps.

Two sets at the threshold share all registers of at least one band but for about 3 pairs in 10**9 (2 at 0.8). Operator 2's
threshold is ``THRESHOLD``; ``near_duplicates`` takes others.

Cases: null or empty texts and texts of white space have no shingles, link with nothing and are their own
component; fewer than five words are one shingle; rows of one document id with different texts are versions,
each its own document with its own links (they share the id and so may share a component's name); an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm.graph import components
from basketry.llm.hashing import LOWER, chunks, mix, range_hashes, span_hashes, text_buffer, word_spans
from basketry.llm.scratch import as_row, of_row, read_table, ship, stored

SHINGLE = 5
THRESHOLD = 0.85
REGISTER_BITS = 8
REGISTERS = 1 << REGISTER_BITS
VALUE_BITS = 64 - REGISTER_BITS
MANTISSA_BITS = 10
#: Pairs at the threshold that share no band: so many at most.
MISSED = 4e-9
#: Members of a hub compared as one block: at most so many, with so many shingles in all; a task's share.
BLOCK_MEMBERS, BLOCK_SHINGLES, TASK_SHINGLES = 4000, 1_000_000, 2_000_000
STANDARD_ERRORS = 5.0

SKETCHED = "doc_id long, version string, n_shingles long, f1 long, f2 long, sketch binary"
CLASS = ["f1", "f2", "n_shingles"]


def shingle_sets(part: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each document of a chunk."""
    low = LOWER[part]
    starts, ends, first = word_spans(low, at)
    words = span_hashes(low, starts, ends)
    own_end = np.repeat(first[1:], np.diff(first))  # where each word's document ends
    begin = np.arange(len(words))
    keep = (begin + SHINGLE <= own_end) | (begin == np.repeat(first[:-1], np.diff(first)))
    begin = begin[keep]
    shingles = range_hashes(words, begin, np.minimum(begin + SHINGLE, own_end[keep]))
    border = np.searchsorted(begin, first)
    for a, b in zip(border[:-1], border[1:]):
        yield np.unique(shingles[a:b])


_FLOORS = (np.arange(REGISTERS, dtype=np.uint64)) << np.uint64(VALUE_BITS)
_VALUE = np.uint64((1 << VALUE_BITS) - 1)
_MARK = np.uint64(0x5851F42D4C957F2D)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """HyperMinHash registers (uint16; 0: empty) of each set: a float's exponent is the leading-zero count, and
    the top bits of its fraction are the mantissa."""
    least = np.zeros((len(sets), REGISTERS), np.uint64)
    full = np.zeros((len(sets), REGISTERS), bool)
    for i, s in enumerate(sets):
        if len(s):
            at = np.searchsorted(s, _FLOORS)
            least[i] = s[np.minimum(at, len(s) - 1)]
            full[i] = at < np.append(at[1:], len(s))
    floats = ((least & _VALUE) + np.uint64(1)).astype(np.float64).view(np.uint64)
    code = (floats >> np.uint64(52 - MANTISSA_BITS)) - np.uint64((1023 << MANTISSA_BITS) - 1)
    return np.where(full, code, np.uint64(0)).astype(np.uint16)


def fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offs = text_buffer(batch.column(1))
        for lo, hi, part, at in chunks(buf, offs):
            sets = list(shingle_sets(part, at))
            n = np.array([len(s) for s in sets], np.int64)
            f1 = fingerprints(sets)
            with np.errstate(over="ignore"):
                f2 = np.array([mix(s ^ _MARK).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(n), pa.array(f1), pa.array(f2), pa.array([r.tobytes() for r in registers(sets)], pa.binary())],
                ["doc_id", "version", "n_shingles", "f1", "f2", "sketch"],
            )


def sketches(docs: DataFrame) -> DataFrame:
    """``version`` is the md5 of the text (empty: null) and tells rows of one id apart."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), text, _version(text).alias("version")).mapInArrow(_sketch, SKETCHED)


def _version(text: Column) -> Column:
    return F.coalesce(F.md5(text), F.lit(""))


def _matrix(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint16).reshape(len(col), REGISTERS)


def _probes() -> np.ndarray:
    """For each register, the registers it tries to borrow from, in order."""
    n = np.arange(REGISTERS * PROBES, dtype=np.uint64).reshape(REGISTERS, PROBES)
    return (mix(n + np.uint64(99)) % np.uint64(REGISTERS)).astype(np.int64)


PROBES = 24
_PROBES = _probes()


def densified(rows: np.ndarray) -> np.ndarray:
    """Registers with the empty ones filled from others; what is left after all probes takes the next filled one."""
    out = rows.copy()
    doc, at = np.nonzero((rows == 0) & rows.any(1)[:, None])
    for k in range(PROBES):
        if not len(doc):
            return out
        got = rows[doc, _PROBES[at, k]]
        out[doc, at] = got
        doc, at = doc[got == 0], at[got == 0]
    filled = np.concatenate([rows, rows], axis=1) > 0
    for d in np.unique(doc):
        have = np.flatnonzero(filled[d])
        mine = at[doc == d]
        out[d, mine] = rows[d, have[np.searchsorted(have, mine)] % REGISTERS]
    return out


def banding(threshold: float) -> tuple[int, int]:
    """Number of bands and registers of each: as long as ``MISSED`` allows."""
    n = next((n for n in range(REGISTERS, 0, -1) if (1 - threshold**n) ** (REGISTERS // n) <= MISSED), 1)
    return REGISTERS // n, n


def _bands(threshold: float):
    bands, size = banding(threshold)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(size)], np.uint64)
        salt = mix(np.arange(bands, dtype=np.uint64) + np.uint64(1))
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            rows = densified(_matrix(batch.column(1)))[:, : bands * size].reshape(-1, bands, size)
            hashed = mix((rows.astype(np.uint64) * powers).sum(2, dtype=np.uint64) ^ salt)
            which, band = np.nonzero(rows.any(2))
            yield pa.RecordBatch.from_arrays([pa.array(keys[which]), pa.array(hashed[which, band].view(np.int64))], ["doc", "band"])

    return keyed


def expected_collisions(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Registers that two disjoint sets of n and m items are expected to share by chance: both least values fall
    between the same powers of two and then into the same of 2**MANTISSA_BITS cells."""
    level = np.arange(1, VALUE_BITS)[:, None]
    upper, lower = np.exp2(-(level - 1.0)) / REGISTERS, np.exp2(-(level * 1.0)) / REGISTERS

    def share(k):
        return np.exp(k * np.log1p(-lower)) - np.exp(k * np.log1p(-np.minimum(upper, 1 - 1e-12)))

    return REGISTERS * (share(n[None, :].astype(float)) * share(m[None, :].astype(float))).sum(0) / (1 << MANTISSA_BITS)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimate, and its standard error at the threshold: the registers in use are a
    sample without replacement of the union (at least the larger set), so short texts are measured almost in full."""
    used = np.maximum(((a > 0) | (b > 0)).sum(1), 1)
    same = ((a == b) & (a > 0)).sum(1)
    chance = np.minimum(expected_collisions(n, m), used - 1e-9)
    union = np.maximum((n + m) / (1 + threshold), used)
    rest = (union - used + 1) / union
    return np.maximum(same - chance, 0) / (used - chance), np.sqrt(threshold * (1 - threshold) / used * rest) + 0.5 / used


def _near(threshold: float):
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, hub, s, n, t, m = batch.columns
            n, m = n.to_numpy(), m.to_numpy()
            jaccard, error = estimate(_matrix(s), _matrix(t), n, m, threshold)
            size = np.minimum(n, m) / np.maximum(n, m)
            keep = (jaccard >= threshold - STANDARD_ERRORS * error) & (size >= threshold)
            yield pa.RecordBatch.from_arrays(
                [doc.filter(pa.array(keep)), hub.filter(pa.array(keep)), pa.array(jaccard[keep])], ["doc", "hub", "estimate"]
            )

    return kept


def near_by_sketch(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose estimate does not rule out the threshold."""
    left = classes.select(F.col("doc"), F.col("sketch").alias("s"), F.col("n").alias("n1"))
    right = classes.select(F.col("doc").alias("hub"), F.col("sketch").alias("t"), F.col("n").alias("n2"))
    both = pairs.join(left.hint("merge"), "doc").join(right.hint("merge"), "hub").select("doc", "hub", "s", "n1", "t", "n2")
    return both.mapInArrow(_near(threshold), "doc long, hub long, estimate double")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offs = text_buffer(batch.column(1))
        for lo, hi, part, at in chunks(buf, offs):
            sets = list(shingle_sets(part, at))
            mine = pa.array(fingerprints(sets) == batch.column(2).slice(lo, hi - lo).to_numpy(zero_copy_only=False))
            out = [batch.column(0).slice(lo, hi - lo).filter(mine), pa.array([s.tobytes() for s in sets], pa.binary()).filter(mine)]
            yield pa.RecordBatch.from_arrays(out, ["doc", "items"])


def _reach(x: np.ndarray, y: np.ndarray, threshold: float) -> bool:
    """Whether two sorted sets reach the threshold."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    common = int((y[at] == x).sum())
    return 100 * common >= round(100 * threshold) * (len(x) + len(y) - common)


def _linked(threshold: float):
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = zip(batch.column(2), batch.column(3))
            keep = [_reach(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64), threshold) for a, b in sides]
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["doc", "hub"])

    return kept


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``doc, items``: the shingle sets of the classes in ``wanted`` (``doc, id, f1``); of several texts with the class's
    id, the one whose fingerprint is ``f1``."""
    text = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    text = text.join(wanted.hint("merge"), "id").select("doc", "text", "f1")
    return stored(text.mapInArrow(_sets, "doc long, items binary"), "shingle-sets")


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``doc, hub`` whose full sets reach the threshold."""
    both = pairs.select("doc", "hub").join(sets.withColumnRenamed("items", "x").hint("merge"), "doc")
    both = both.join(sets.select(F.col("doc").alias("hub"), F.col("items").alias("y")).hint("merge"), "hub")
    return both.select("doc", "hub", "x", "y").mapInArrow(_linked(threshold), "doc long, hub long")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select("doc").unionByName(pairs.select(F.col("hub").alias("doc"))).distinct()


def _join_components(left: pd.DataFrame, right: pd.DataFrame, same: bool, threshold: float) -> Iterator[tuple[int, int]]:
    """Links between members of different components that join components not yet joined by this call."""
    sets = [[np.frombuffer(x, np.uint64) for x in side["items"]] for side in (left, right)]
    a, b = registers(sets[0]), registers(sets[1])
    n, m = (np.array([len(x) for x in side]) for side in sets)
    c, d = left["c"].to_numpy(), right["c"].to_numpy().copy()
    x, y = left["doc"].to_numpy(), right["doc"].to_numpy()
    root: dict[int, int] = {}

    def find(k: int) -> int:
        while k in root:
            k = root[k]
        return k

    for i in range(len(a)):
        j = np.flatnonzero((d != c[i]) & (np.minimum(m, n[i]) >= threshold * np.maximum(m, n[i])) & ((y > x[i]) | (not same)))
        if not len(j):
            continue
        jaccard, error = estimate(a[i][None], b[j], np.full(len(j), n[i]), m[j], threshold)
        for k in j[jaccard >= threshold - STANDARD_ERRORS * error]:
            one, two = find(c[i]), find(d[k])
            if one != two and _reach(sets[0][i], sets[1][k], threshold):
                root[max(one, two)] = min(one, two)
                yield int(x[i]), int(y[k])


def _compare_blocks(threshold: float):
    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int]] = []
        for (_, one, two), rows in pdf.groupby(["hub", "one", "two"], sort=False):
            left = rows[rows["block"] == one]
            found += _join_components(left, left if one == two else rows[rows["block"] == two], one == two, threshold)
        return pd.DataFrame(found, columns=["doc", "hub"], dtype=np.int64)

    return links


def _between_members(to_hub: DataFrame, found: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links that join the components which a hub and its members are still in."""
    sizes = sets.select("doc", (F.length("items") / 8).cast("long").alias("n"))
    members = to_hub.unionByName(to_hub.select(F.col("hub").alias("doc"), "hub").distinct())
    named = members.join(found.withColumnRenamed("node", "doc"), "doc", "left").join(sizes, "doc")
    named = named.select("hub", "doc", "n", F.coalesce("component", "doc").alias("c"))
    open_hubs = named.groupBy("hub").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    blocks = F.greatest(F.ceil(F.col("k") / BLOCK_MEMBERS), F.ceil(F.col("n") / BLOCK_SHINGLES)).cast("int")
    open_hubs = open_hubs.where("low < high").select("hub", blocks.alias("blocks"))
    rows = stored(named.join(open_hubs, "hub"), "open-groups")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 2
    parts = max(parts, -(-int(rows.agg(F.sum(F.col("n") * F.col("blocks"))).first()[0] or 0) // TASK_SHINGLES))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"one": F.least("block", "other"), "two": F.greatest("block", "other")})
    rows = rows.join(sets.hint("merge"), "doc").select("hub", "one", "two", "block", "doc", "c", "items")
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("hub", "one", "two"), F.lit(parts)))
    return dealt.groupBy("part").applyInPandas(_compare_blocks(threshold), "doc long, hub long").distinct()


def _classes(sketched: DataFrame) -> DataFrame:
    """``f1, f2, n_shingles, id, doc``: the classes, their smallest document id, and the number that links name them by:
    the id, or a hash of the class where that id already names another version's class."""
    of_class = stored(sketched.where("n_shingles > 0").groupBy(*CLASS).agg(F.min("doc_id").alias("id")), "classes")
    named = of_class.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct(*CLASS)).alias("named"))
    others = named.where("k > 1").select(F.col("id").alias("same"), "named")
    others = of_class.join(others, F.col("id") == F.col("same")).where(F.struct(*CLASS) != F.col("named")).select(*CLASS, F.xxhash64(*CLASS).alias("other"))
    return stored(of_class.join(others, CLASS, "left").select(*CLASS, "id", F.coalesce("other", "id").alias("doc")), "named-classes")


def linked_classes(docs: DataFrame, sketched: DataFrame, threshold: float) -> DataFrame:
    """``f1, f2, n_shingles, group, component``: the component of each class, as a number of its own (null without any
    document id) and by its smallest document id."""
    of_class = _classes(sketched)
    classes = sketched.select(*CLASS, "sketch", F.col("doc_id").alias("id")).join(of_class, [*CLASS, "id"])
    classes = stored(classes.select("doc", "sketch", F.col("n_shingles").alias("n")).dropDuplicates(["doc"]), "class-sketches")
    bands = classes.select("doc", "sketch").mapInArrow(_bands(threshold), "doc long, band long")
    shared = bands.groupBy("band").agg(F.min("doc").alias("hub"), F.max("doc").alias("last")).where("hub < last").select("band", "hub")
    to_hub = stored(bands.join(shared, "band").where("doc <> hub").select("doc", "hub").distinct(), "hubs")
    near = stored(near_by_sketch(to_hub, classes, threshold), "near")
    sets = full_sets(docs, of_class.select("doc", "id", "f1").join(_ends(to_hub), "doc"))
    best = near.groupBy("doc").agg(F.max_by("hub", F.struct("estimate", -F.col("hub"))).alias("hub"))
    links = stored(verified(best, sets, threshold), "links-best")
    found = components(links, "doc", "hub")
    rest = stored(_between_members(to_hub, found, sets, threshold), "links-members")
    if not rest.isEmpty():
        found = components(links.unionByName(rest), "doc", "hub")

    grouped = of_class.join(found.withColumnRenamed("node", "doc"), "doc", "left")
    grouped = stored(grouped.select(*CLASS, "id", F.coalesce("component", "doc").alias("group")), "grouped-classes")
    names = grouped.where("group is not null").groupBy("group").agg(F.min("id").alias("component"))
    return grouped.drop("id").join(names, "group", "left")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``; ``threshold`` in whole hundredths."""
    ship(docs.sparkSession)
    sketched = stored(sketches(docs), "sketches")
    out = sketched.drop("sketch").join(linked_classes(docs, sketched, threshold), CLASS, "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each component, all columns as they were: of its smallest id, the version whose md5 sorts first. Texts
    without shingles are told apart by id and text alone; rows without id stay."""
    ship(docs.sparkSession)
    sketched = stored(sketches(docs), "sketches")
    rows = sketched.drop("sketch").where("doc_id is not null").groupBy("doc_id", "version", *CLASS).agg(F.count(F.lit(1)).alias("k"))
    rows = rows.join(linked_classes(docs, sketched, threshold), CLASS, "left").select("doc_id", "version", "group", "k")
    rows = stored(rows, "versions")
    first = rows.where("group is not null").groupBy("group").agg(F.min(F.struct("doc_id", "version")).alias("first"))
    told = rows.join(first, "group", "left").withColumn("stays", F.col("first").isNull() | (F.struct("doc_id", "version") == F.col("first")))
    told = stored(told.select(F.col("doc_id").alias("id"), "version", "stays", "k"), "versions-told")
    again = told.where("stays and k > 1").select("id", "version")
    same = (of_row("doc_id").cast("long") == F.col("id")) & (_version(of_row("text").cast("string")) == F.col("version"))
    gone = told.where("not stays or k > 1").select("id", "version")
    left = as_row(docs).join(gone, same, "left_anti")
    if not again.isEmpty():
        once = as_row(docs).join(again, same).groupBy("id", "version").agg(F.first("_row").alias("_row"))
        left = left.unionByName(once.select("_row"))
    return left.select("_row.*")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
