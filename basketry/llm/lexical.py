"""Operator 13: ranked lexical search by Block-Max MaxScore over shards of an inverted index.

1. Index. A task cuts its documents into shards of about ``SHARD_BYTES`` of text (at most 65,536 documents) and turns
   each into one row: a dictionary of 128-bit term hashes with document counts, and each term's postings in blocks of
   ``BLOCK``. A block holds its first document, the gaps and the occurrences in as few bytes each as they need, and, to
   bound what it can score, its most occurrences and its least ratio of document length to occurrences. These do not
   depend on the corpus, so the index is written in one pass, without a shuffle, and stays right as shards are added.
2. Statistics. Documents, terms and the query terms' document counts are sums over the shards.
3. Search. Items come in blocks of about ``ITEM_TERMS`` terms. A task keeps the best documents of each item over all its
   shards; the last one is the item's threshold. Within a shard the item's terms are ordered by their lists' greatest
   possible score. Lists are essential as long as those from there on could together reach the threshold: only their
   postings name candidates, and their partial scores already raise it. A list that is not essential is asked about the
   candidates alone: where a candidate's score, the maximum of the block it would be in and the bounds of the lists after
   it stay below the threshold, it is rejected and the block is not decoded. Only scores below the threshold are passed
   over, so ties are kept.
4. The tasks' best rows are merged: first within a share of the tasks, then over the shares.

Scores are integers: a term weighs w = floor(1000 ln((2N + 2) / (2 df + 1))), a document's m is 75 + (25 n N) div L, and
an occurrence count tf adds w ((10^9 tf) div (1000 tf + 12 m)), as often as the item has the term.

Cases: a text without terms (null, empty, marks only) is no document of the statistics and is never found; an item
without terms finds nothing; a very long text is one document of a shard of its own size; equal items (id and text) are
one, items that share an id but not the text are ranked each for itself; rows that repeat a ``doc_id`` are documents of
their own and rows without one come after those with one among equal scores; empty tables give no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketry.llm.hashing import LOWER, chunks, span_hashes, text_buffer, word_spans
from basketry.llm.scratch import read_table, ship, stored

TOP = 20
BLOCK = 128
SHARD_BYTES = 4 << 20
SHARD_DOCS = 1 << 16
#: Terms of the items that are searched at once.
ITEM_TERMS = 1 << 16
#: Shares of the tasks whose rows are merged first.
SHARES = 64

#: Every byte that belongs to no term: ASCII without letters and digits.
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

#: One row for each shard; the arrays are little-endian.
ARRAYS = {"ids": np.int64, "has_id": np.uint8, "lengths": np.int64, "first_hash": np.uint64, "second_hash": np.uint64, "df": np.uint32,
          "first_doc": np.uint16, "most": np.uint32, "least_ratio": np.float32, "widths": np.uint8, "payload": np.uint8}
INDEX = "n_docs long, n_terms long, " + ", ".join(f"{c} binary" for c in ARRAYS)


def terms_of(part: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both hashes of every term and the row it stands in."""
    low = LOWER[part]
    starts, ends, first = word_spans(low, offs, MARKS)
    return span_hashes(low, starts, ends), span_hashes(low, starts, ends, 1), np.repeat(np.arange(len(offs) - 1), np.diff(first))


def _grouped(h0: np.ndarray, h1: np.ndarray, doc: np.ndarray, tf: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(hashes, document, occurrences) sorted by term and document, each pair once; ``doc`` ascends on input."""
    order = np.argsort(h0, kind="stable")
    if np.any((h0[order][1:] == h0[order][:-1]) & (h1[order][1:] != h1[order][:-1])):
        order = np.lexsort((doc, h1, h0))
    h0, h1, doc = h0[order], h1[order], doc[order]
    new = np.ones(len(h0), bool)
    new[1:] = (h0[1:] != h0[:-1]) | (h1[1:] != h1[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    tf = np.diff(np.append(at, len(h0))) if tf is None else np.add.reduceat(tf[order], at) if len(at) else tf
    return h0[at], h1[at], doc[at], tf


def _least_width(values: np.ndarray) -> np.ndarray:
    return (values > 0).astype(np.int64) + (values > 0xFF) + 2 * (values > 0xFFFF)  # 0, 1, 2 or 4 bytes


def _scatter(payload: np.ndarray, places: np.ndarray, values: np.ndarray, widths: np.ndarray) -> None:
    for byte in range(4):
        own = widths > byte
        payload[places[own] + byte] = (values[own] >> (8 * byte)) & 0xFF


def _gather(payload: np.ndarray, places: np.ndarray, widths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(places), np.int64)
    for byte in range(int(widths.max(initial=0))):
        own = widths > byte
        out[own] |= payload[places[own] + byte].astype(np.int64) << (8 * byte)
    return out


class _Builder:
    """The documents of one shard, and its row."""

    def __init__(self):
        self.ids: list[np.ndarray] = []
        self.has: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        self.pairs: list[tuple[np.ndarray, ...]] = []
        self.n = self.bytes = 0

    def add(self, ids: np.ndarray, has: np.ndarray, part: np.ndarray, offs: np.ndarray) -> None:
        h0, h1, doc = terms_of(part, offs)
        n = np.bincount(doc, minlength=len(ids))
        kept = n > 0
        number = np.cumsum(kept) - 1 + self.n
        self.pairs.append(_grouped(h0, h1, number[doc]))
        self.ids.append(ids[kept])
        self.has.append(has[kept])
        self.lengths.append(n[kept])
        self.n += int(kept.sum())
        self.bytes += len(part)

    def row(self) -> pa.RecordBatch:
        h0, h1, doc, tf = _grouped(*(np.concatenate(x) for x in zip(*self.pairs)))
        lengths = np.concatenate(self.lengths)
        term = np.ones(len(h0), bool)
        term[1:] = (h0[1:] != h0[:-1]) | (h1[1:] != h1[:-1])
        begin = np.flatnonzero(term)
        df = np.diff(np.append(begin, len(h0)))
        # blocks: every BLOCK-th posting of a list begins one
        within = np.arange(len(h0)) - np.repeat(begin, df)
        heads = np.flatnonzero(within % BLOCK == 0)
        size = np.diff(np.append(heads, len(h0)))
        block = np.repeat(np.arange(len(heads)), size)
        gap = np.diff(doc, prepend=0)
        gap[heads] = 0
        most, widest = np.maximum.reduceat(tf, heads), np.maximum.reduceat(gap, heads)
        ratio = np.minimum.reduceat(lengths[doc] / tf, heads)
        gap_width, tf_width = _least_width(widest), _least_width(most - 1)  # occurrences are stored less one
        at = _starts(size, gap_width, tf_width)
        payload = np.zeros(int(at[-1]), np.uint8)
        inside = np.arange(len(h0)) - heads[block]
        _scatter(payload, at[block] + inside * gap_width[block], gap, gap_width[block])
        _scatter(payload, at[block] + size[block] * gap_width[block] + inside * tf_width[block], tf - 1, tf_width[block])
        arrays = {"ids": np.concatenate(self.ids), "has_id": np.concatenate(self.has), "lengths": lengths, "first_hash": h0[begin], "second_hash": h1[begin],
                  "df": df, "first_doc": doc[heads], "most": most, "least_ratio": np.nextafter(ratio.astype(np.float32), np.float32(0)),
                  "widths": gap_width << 4 | tf_width, "payload": payload}
        cells = [pa.array([self.n]), pa.array([int(lengths.sum())])]
        cells += [pa.array([arrays[c].astype(kind).tobytes()], pa.binary()) for c, kind in ARRAYS.items()]
        return pa.RecordBatch.from_arrays(cells, ["n_docs", "n_terms", *ARRAYS])


def _starts(size: np.ndarray, gap_width: np.ndarray, tf_width: np.ndarray) -> np.ndarray:
    """Where each block's bytes begin, and their end."""
    return np.concatenate([[0], np.cumsum(size * (gap_width + tf_width))])


def _indexed(batches: Iterator[pa.RecordBatch], shard_bytes: int, shard_docs: int) -> Iterator[pa.RecordBatch]:
    shard = _Builder()
    for batch in batches:
        ids, has = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False), batch.column(0).is_valid().to_numpy(zero_copy_only=False)
        buf, offs = text_buffer(batch.column(1))
        for lo, hi, part, at in chunks(buf, offs):
            for k in range(lo, hi, shard_docs):
                to = min(hi, k + shard_docs)
                if shard.n and (shard.n + to - k > shard_docs or shard.bytes + at[to - lo] - at[k - lo] > shard_bytes):
                    yield shard.row()
                    shard = _Builder()
                shard.add(ids[k:to], has[k:to], part[at[k - lo] : at[to - lo]], at[k - lo : to - lo + 1] - at[k - lo])
    if shard.n:
        yield shard.row()


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """The index of all terms of all documents, a row for each shard; the caller stores it."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("_text"))
    return rows.mapInArrow(lambda it: _indexed(it, shard_bytes, min(shard_docs, SHARD_DOCS)), INDEX)


@dataclass(frozen=True)
class Items:
    """A block of items: their ids, and each one's ``terms`` (positions among the sorted distinct ones) and their occurrences."""

    ids: list[int | None]
    first_hash: np.ndarray
    second_hash: np.ndarray
    terms: list[np.ndarray]
    counts: list[np.ndarray]


def _found(first: np.ndarray, second: np.ndarray, items: Items) -> np.ndarray:
    """Each item term's place in a shard's dictionary (sorted by both hashes), -1 where it has none."""
    at = np.searchsorted(first, items.first_hash)
    out = np.full(len(at), -1)
    todo = np.arange(len(at))
    while len(todo):  # a second round only where two terms share the first hash
        todo = todo[(at[todo] < len(first))]
        todo = todo[first[at[todo]] == items.first_hash[todo]]
        same = second[at[todo]] == items.second_hash[todo]
        out[todo[same]] = at[todo[same]]
        todo = todo[~same]
        at[todo] += 1
    return out


def _document_counts(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[pa.RecordBatch]:
    total = np.zeros(len(items.first_hash), np.int64)
    for batch in batches:
        for first, second, df in zip(*(batch.column(j) for j in range(3))):
            where = _found(np.frombuffer(first.as_py(), np.uint64), np.frombuffer(second.as_py(), np.uint64), items)
            total[where >= 0] += np.frombuffer(df.as_py(), np.uint32)[where[where >= 0]]
    own = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], ["term", "df"])


class Shard:
    """A shard opened for a corpus of ``n`` documents and ``length`` terms."""

    def __init__(self, arrays: dict[str, np.ndarray], n: int, length: int):
        self.ids, self.has_id, self.payload = arrays["ids"], arrays["has_id"].astype(bool), arrays["payload"]
        self.first_hash, self.second_hash = arrays["first_hash"], arrays["second_hash"]
        lengths, back = np.unique(arrays["lengths"], return_inverse=True)
        self.m = np.array([75 + 25 * int(x) * n // length for x in lengths], np.int64)[back]
        self.df, self.first_doc = arrays["df"].astype(np.int64), arrays["first_doc"].astype(np.int64)
        blocks = -(-self.df // BLOCK)
        self.block_at = np.concatenate([[0], np.cumsum(blocks)])
        self.size = np.full(len(self.first_doc), BLOCK, np.int64)
        self.size[self.block_at[1:] - 1] = self.df - (blocks - 1) * BLOCK
        self.gap_width, self.tf_width = arrays["widths"].astype(np.int64) >> 4, arrays["widths"].astype(np.int64) & 15
        self.at = _starts(self.size, self.gap_width, self.tf_width)
        # no posting of a block adds more: tf is at most ``most``, length / tf at least ``least_ratio``, m > 74 + 25 n N / L
        part = 1000 + 888 / arrays["most"] + 300 * (n / length) * arrays["least_ratio"].astype(float)
        self.bound = (1e9 / part * (1 + 1e-9)).astype(np.int64) + 1
        self.list_bound = np.maximum.reduceat(self.bound, self.block_at[:-1]) if len(blocks) else blocks
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.decoded = 0

    def decode(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of the postings of some blocks."""
        self.decoded += len(blocks)
        size = self.size[blocks]
        row = np.repeat(np.arange(len(blocks)), size)
        begin = np.cumsum(size) - size
        inside = np.arange(len(row)) - begin[row]
        gap_width, tf_width, at = self.gap_width[blocks], self.tf_width[blocks], self.at[blocks]
        walked = np.cumsum(_gather(self.payload, at[row] + inside * gap_width[row], gap_width[row]))
        doc = self.first_doc[blocks][row] + walked - walked[begin][row]
        tf = 1 + _gather(self.payload, (at + size * gap_width)[row] + inside * tf_width[row], tf_width[row])
        return doc, 1_000_000_000 * tf // (1000 * tf + 12 * self.m[doc])

    def whole(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        """A whole list, decoded once for all items."""
        if term not in self.lists:
            self.lists[term] = self.decode(np.arange(self.block_at[term], self.block_at[term + 1]))
        return self.lists[term]

    def some(self, term: int, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if term in self.lists:
            return self.lists[term]
        return self.decode(blocks)

    def search(self, terms: np.ndarray, weights: np.ndarray, best: np.ndarray, top: int, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents that may be among the ``top`` and their scores, given the ``best`` scores so far; ``score``: an
        array of zeros for the documents, given back as zeros."""
        bounds = weights * self.list_bound[terms]
        order = np.argsort(-bounds, kind="stable")
        terms, weights, bounds = terms[order], weights[order], bounds[order]
        rest = np.append(np.cumsum(bounds[::-1])[::-1], 0)  # what the lists from here on can add
        reach = self._threshold(best, best[:0], top)
        touched, k = [], 0
        while k < len(terms) and rest[k] >= reach:
            doc, impact = self.whole(int(terms[k]))
            score[doc] += weights[k] * impact
            touched.append(doc)
            k += 1
            reach = max(reach, self._threshold(best, score, top))
        found = np.flatnonzero(score + rest[k] >= reach) if touched else np.zeros(0, np.int64)
        found = found[score[found] > 0]
        sums = score[found]
        for doc in touched:
            score[doc] = 0
        for j in range(k, len(terms)):
            if not len(found):
                break
            lo, hi = self.block_at[terms[j]], self.block_at[terms[j] + 1]
            block = lo - 1 + np.searchsorted(self.first_doc[lo:hi], found, "right")
            adds = np.where(block >= lo, weights[j] * self.bound[block], 0)
            keep = sums + adds + rest[j + 1] >= reach
            found, sums, block = found[keep], sums[keep], block[keep]
            if not len(found):
                break
            doc, impact = self.some(int(terms[j]), np.unique(block[block >= lo]))
            if len(doc):
                place = np.minimum(np.searchsorted(doc, found), len(doc) - 1)
                sums = sums + np.where(doc[place] == found, weights[j] * impact[place], 0)
                reach = max(reach, self._threshold(best, sums, top))
        keep = sums >= reach
        return found[keep], sums[keep]

    @staticmethod
    def _threshold(best: np.ndarray, sums: np.ndarray, top: int) -> int:
        """The ``top``-th best of what is known so far, at least 1: scores never fall while lists are added."""
        known = np.concatenate([best, sums])
        return max(1, int(np.partition(known, len(known) - top)[len(known) - top])) if len(known) >= top else 1


def _searched(batches: Iterator[pa.RecordBatch], items: Items, weights: np.ndarray, n: int, length: int, top: int) -> Iterator[pa.RecordBatch]:
    kinds = list(ARRAYS.items())
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))] * len(items.terms)  # scores, ids, has id
    for batch in batches:
        for k in range(batch.num_rows):
            shard = Shard({c: np.frombuffer(batch.column(j)[k].as_buffer(), kind) for j, (c, kind) in enumerate(kinds)}, n, length)
            where = _found(shard.first_hash, shard.second_hash, items)
            score = np.zeros(len(shard.ids), np.int64)
            for i, (terms, counts) in enumerate(zip(items.terms, items.counts)):
                here = (where[terms] >= 0) & (weights[terms] > 0)
                if not here.any():
                    continue
                doc, sums = shard.search(where[terms][here], (weights[terms] * counts)[here], best[i][0], top, score)
                if len(doc):
                    s, d, h = (np.concatenate(x) for x in zip(best[i], (sums, shard.ids[doc], shard.has_id[doc])))
                    order = np.lexsort((d, ~h, -s))[:top]
                    best[i] = s[order], d[order], h[order]
    s, d, h = (np.concatenate([b[j] for b in best]) for j in range(3))
    item = np.repeat(np.arange(len(best)), [len(b[0]) for b in best])
    cells = [pa.array(item), pa.array(items.ids, pa.int64()).take(pa.array(item)), pa.array(d, mask=~h), pa.array(s)]
    yield pa.RecordBatch.from_arrays(cells, ["item", "item_id", "doc_id", "score"])


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offs = text_buffer(batch.column(1))
        cells, sizes = [], []
        for lo, hi, part, at in chunks(buf, offs):
            h0, h1, row = terms_of(part, at)
            for k in range(hi - lo):
                own = slice(*np.searchsorted(row, [k, k + 1]))
                a, b, _, tf = _grouped(h0[own], h1[own], np.zeros(own.stop - own.start, np.int64))
                cells.append(np.concatenate([a, b, tf.astype(np.uint64)]).tobytes())
                sizes.append(len(a))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells, pa.binary()), pa.array(sizes, pa.int64())], ["item_id", "text", "terms", "size"])


def _opened(rows: list) -> Items:
    """A block of items from its rows."""
    each = [np.frombuffer(r["terms"], np.uint64).reshape(3, -1) for r in rows]
    pairs = np.concatenate([e[:2].T for e in each])
    distinct, back = np.unique(pairs, axis=0, return_inverse=True)
    return Items([r["item_id"] for r in rows], distinct[:, 0].copy(), distinct[:, 1].copy(), np.split(back.ravel(), np.cumsum([e.shape[1] for e in each])[:-1]), [e[2].astype(np.int64) for e in each])


FOUND = "item_id long, rank int, doc_id long, score long"


def search(index: DataFrame, items: DataFrame, top: int = TOP, item_terms: int = ITEM_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score`` of each item's ``top`` best documents with a score above 0."""
    spark = index.sparkSession
    ship(spark)
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    asked = stored(asked.mapInArrow(_item_terms, "item_id long, text string, terms binary, size long").where("size > 0"), "items")
    n, length = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    blocks = max(1, -(-(asked.agg(F.sum("size")).first()[0] or 0) // item_terms))
    out = spark.createDataFrame([], FOUND)
    if not n:
        return out
    for b in range(blocks):  # a block's terms are bounded; each is one pass over the shards
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).select("item_id", "terms").collect()
        if not rows:
            continue
        block = _opened(rows)
        counts = index.select("first_hash", "second_hash", "df").mapInArrow(lambda it, block=block: _document_counts(it, block), "term long, df long")
        weights = np.zeros(len(block.first_hash), np.int64)
        for term, df in counts.groupBy("term").agg(F.sum("df")).collect():
            weights[term] = math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))
        kind = "item long, item_id long, doc_id long, score long"
        found = index.select(*ARRAYS).mapInArrow(lambda it, block=block, w=weights: _searched(it, block, w, n, length, top), kind)
        order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        found = found.withColumn("share", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SHARES)))
        for keys in (["item", "share"], ["item"]):
            rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
            found = found.withColumn("rank", rank).where(F.col("rank") <= top)
        found = found.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = out.unionByName(stored(found, "ranked") if blocks > 1 else found)
    return out


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = stored(build_index(read_table(spark, sf_dir, "documents")), "lexical-index")
    return search(index, read_table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents
), full_docs AS (
  SELECT row, doc_id, len(t) AS n, t FROM docs WHERE len(t) > 0
), corpus AS (
  SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM full_docs
), items AS (
  SELECT row_number() OVER () AS item, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark)
), asked AS (
  SELECT item, term, count(*) AS times FROM (
    SELECT item, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM items
  ) GROUP BY item, term
), postings AS (
  SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(t) AS term FROM full_docs) GROUP BY row, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM postings, corpus WHERE term IN (SELECT term FROM asked) GROUP BY term, n_docs
), scored AS (
  SELECT item, row, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN full_docs USING (row), corpus GROUP BY item, row
), ranked AS (
  SELECT item, row, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank
  FROM scored JOIN full_docs USING (row) WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked JOIN items USING (item) JOIN full_docs USING (row) WHERE rank <= 20
"""
