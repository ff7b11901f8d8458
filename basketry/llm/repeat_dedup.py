"""Operator 9: words in passages of 35 words that occur more than once, found by level-wise doubling.

A window of 35 words can only be repeated if its parts are. The levels test parts of 9, then 18, then all 35
words; each extends only what was repeated at the level before:

* Level 9: of every 35-word window, the 9-word part with the least hash (a minimizer: the same in every copy of
  the window) is a key, about one key in 14 words. Windows whose key occurs only once are done.
* Level 18: of the surviving windows, the 18-word part with the least hash is the key.
* Level 35: the surviving windows themselves, by two independent 64-bit hashes.

Keys go through ``exchange.repeated_keys``; only the documents with surviving windows are read again, from a
table bucketed by document id, so their text is shuffled once.

Cases: a null text has no words; fewer than 35 words are kept whole; a row without document id is returned
unchanged and counts nowhere; repeated rows of an id are separate documents; a table without rows gives none;
other columns are passed over (``query``) or kept (``without_repeats``), whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm import exchange as X
from basketry.llm.hashing import chunks, sliding, span_hashes, text_buffer, whole_windows, word_spans, word_windows
from basketry.llm.scratch import as_row, bucketed, of_row, read_table, ship, stored

WINDOW = 35
LEVELS = (9, 18)

RESULT = "doc_id long, version string, n_words long, n_removed long, kept_sha256 string"


class _Chunk:
    """The words of a run of documents, and their windows."""

    def __init__(self, part: np.ndarray, at: np.ndarray, window: int):
        self.starts, self.ends, self.first = word_spans(part, at)
        self.part, self.window = part, window
        self.words = span_hashes(part, self.starts, self.ends)
        self.n = max(0, len(self.words) - window + 1)
        self.whole = whole_windows(self.first, self.n, window)

    def rows(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, positions, "right") - 1

    def least_parts(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each part of ``length`` words, and the least one of each window."""
        parts = word_windows(self.words, length)
        return parts, sliding(parts, self.window - length + 1)[: self.n]

    def border(self) -> np.ndarray:
        return np.minimum(self.first, self.n)

    def chosen(self, parts: np.ndarray, least: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
        """Positions of the parts that are the least one of a window in ``windows``."""
        if not self.n:
            return np.zeros(0, np.int64)
        pad = np.zeros(self.window - length, np.uint64)
        most = sliding(np.concatenate([pad, np.where(windows, least, np.uint64(0)), pad]), self.window - length + 1, np.maximum)
        return np.flatnonzero((most == parts) & (parts != 0))

    def second(self) -> "np.ndarray":
        return word_windows(span_hashes(self.part, self.starts, self.ends, 1), self.window, 1)


def _parsed(batch: pa.RecordBatch, window: int) -> Iterator[tuple[int, int, _Chunk]]:
    buf, offs = text_buffer(batch.column(1))
    for lo, hi, part, at in chunks(buf, offs):
        yield lo, hi, _Chunk(part, at, window)


def _known(batch: pa.RecordBatch, lo: int, hi: int) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint64) if x.is_valid else np.zeros(0, np.uint64) for x in batch.column(2)[lo:hi]]


def _first_level(buckets: int, window: int, length: int):
    def entries(batch):
        docs = batch.column(0).to_numpy()
        for lo, hi, c in _parsed(batch, window):
            parts, least = c.least_parts(length)
            at = c.chosen(parts, least, c.whole, length)
            yield X.distinct_entries(docs[lo:hi][c.rows(at)], X.codes_of(parts[at], buckets))

    return entries


def _next_level(buckets: int, window: int, length: int, longer: int):
    def entries(batch):
        docs = batch.column(0).to_numpy()
        for lo, hi, c in _parsed(batch, window):
            _, least = c.least_parts(length)
            alive = c.whole & X.held_by_row(X.codes_of(least, buckets), c.border(), _known(batch, lo, hi))
            parts, least = c.least_parts(longer)
            at = c.chosen(parts, least, alive, longer)
            yield X.distinct_entries(docs[lo:hi][c.rows(at)], X.codes_of(parts[at], buckets))

    return entries


def _last_level(buckets: int, window: int, length: int):
    def entries(batch):
        docs = batch.column(0).to_numpy()
        for lo, hi, c in _parsed(batch, window):
            _, least = c.least_parts(length)
            at = np.flatnonzero(c.whole & X.held_by_row(X.codes_of(least, buckets), c.border(), _known(batch, lo, hi)))
            yield X.distinct_entries(docs[lo:hi][c.rows(at)], word_windows(c.words, window)[at], c.second()[at])

    return entries


def _removed(batches: Iterator[pa.RecordBatch], window: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    """Documents that lose words, without them."""
    for batch in batches:
        for lo, hi, c in _parsed(batch, window):
            hit = c.whole & X.held_by_row(word_windows(c.words, window), c.border(), _known(batch, lo, hi))
            cover = np.zeros(len(c.words) + 1, np.int64)
            at = np.flatnonzero(hit)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + window, -1)
            keep = np.cumsum(cover)[:-1] == 0
            rows, n_words, n_removed, kept = [], [], [], []
            raw = c.part.tobytes()
            for r, (a, b) in enumerate(zip(c.first[:-1], c.first[1:])):
                if b > a and not keep[a:b].all():
                    words = raw[c.starts[a] : c.ends[b - 1]].split()
                    rows.append(lo + r)
                    n_words.append(b - a)
                    n_removed.append(int((~keep[a:b]).sum()))
                    kept.append(b" ".join(compress(words, keep[a:b])))
            take = pa.array(rows, pa.int64())
            out = [batch.column(0).take(take), batch.column(3).take(take), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                   pa.array([x.decode() for x in kept] if with_text else [hashlib.sha256(x).hexdigest() for x in kept], pa.string())]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "version", "n_words", "n_removed", "kept_sha256"])


def repeats_removed(docs: DataFrame, window: int = WINDOW, levels: tuple[int, int] = LEVELS, with_text: bool = False) -> DataFrame:
    """``doc_id, version, n_words, n_removed, kept_sha256`` of the documents that lose words; ``version`` is the md5
    of the text and tells rows of one id apart. ``with_text``: the last column holds the kept text itself."""
    ship(docs.sparkSession)
    spark = docs.sparkSession
    short, longer = (min(length, window) for length in levels)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null and text is not null")
    size, n = X.text_bytes(rows)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets, replies = X.bucket_count(size / 80, partitions), int(max(partitions, n // X.REPLY_DOCS))
    found = X.repeated_keys(rows, _first_level(buckets, window, short), buckets, replies)
    alive = rows.withColumn("version", F.md5("text")).join(found, rows.doc_id == found.doc).drop("doc")
    kind = RESULT if not with_text else RESULT.replace("kept_sha256", "kept_text")
    with bucketed(alive, "doc_id", "repeats") as alive:

        def again(entries_of, codes: DataFrame | None, wide: bool = False) -> DataFrame:
            side = alive if codes is None else alive.drop("codes").join(codes, F.col("doc_id") == F.col("doc"))
            return X.repeated_keys(side.select("doc_id", "text", "codes"), entries_of, buckets, replies, wide)

        codes = stored(again(_next_level(buckets, window, short, longer), None), "repeats-18")
        codes = stored(again(_last_level(buckets, window, longer), codes, wide=True), "repeats-35")
        last = alive.drop("codes").join(codes, F.col("doc_id") == F.col("doc")).select("doc_id", "text", "codes", "version")
        out = stored(last.mapInArrow(lambda it: _renamed(_removed(it, window, with_text), with_text), kind), "repeats-removed")
    return out.dropDuplicates(["doc_id", "version"])


def _renamed(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield b.rename_columns([*b.schema.names[:-1], "kept_text"]) if with_text else b


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = [(x.as_buffer().to_pybytes() if x.is_valid else b"").split() for x in batch.column(1)]
        digests = [hashlib.sha256(b" ".join(w)).hexdigest() for w in lists]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(list(map(len, lists)), pa.int64()), pa.array(digests, pa.string())],
            ["doc_id", "version", "n_words", "sha"],
        )


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for every row of ``docs``."""
    ship(docs.sparkSession)
    lost = repeats_removed(docs, window).select("doc_id", "version", "n_removed", "kept_sha256")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.md5(F.col("text").cast("string")).alias("version"))
    counted = rows.mapInArrow(_counted, "doc_id long, version string, n_words long, sha string")
    return counted.join(lost, ["doc_id", "version"], "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256")
    )


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the repeated words gone from ``text`` (kept words joined by one space) and ``n_chars`` set to
    the new length; a text that loses nothing stays as it is, byte for byte."""
    lost = repeats_removed(docs, window, with_text=True)
    lost = lost.select(F.col("doc_id").alias("_id"), F.col("version").alias("_version"), "kept_text")
    text = of_row("text").cast("string")
    out = as_row(docs).join(lost, (of_row("doc_id").cast("long") == F.col("_id")) & (F.md5(text) == F.col("_version")), "left")
    changed = {"text": F.coalesce("kept_text", text)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.coalesce(F.char_length("kept_text").cast("long"), of_row("n_chars"))
    return out.select(*((changed[c] if c in changed else of_row(c)).alias(c) for c in docs.columns))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents"))
