"""Operator 5: bytes covered by a 50-byte string that starts in a smaller document too, by suffix sorting.

1. Filter: of every 50-byte window, the 24-byte part with the least hash is its anchor (the same in every copy of
   the window). Windows whose anchor no other document has are done.
2. A segment is a run of windows with one anchor: at most some 76 bytes. Documents with an equal segment (anchor
   and 64-bit hash of its bytes) need no comparison: all but the smallest lose the whole segment.
3. Where an anchor has segments of different bytes, their smallest documents send the bytes to one group. There
   a suffix array is built in two stages: the suffixes smaller than their successors are sorted directly, all
   others are induced from them by a scan over the buckets of first bytes. Common prefixes of neighbours tell the
   windows that are equal, and the smallest document of each.
4. An anchor with more than ``HOT_SEGMENTS`` different segments is resolved exactly by a grouped minimum over its
   windows instead, so that no group grows without bound.

Texts are read from a table bucketed by document id, so they are shuffled once. Each step's shuffle files go when the step
is written, so the disk holds the texts, what is still to be read and one step's shuffles.

Cases: null text is empty; texts under 50 bytes are kept; a row without document id is returned unchanged and
counts nowhere; rows of one id are the same document, so none of them loses to another; an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import ExitStack

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm import exchange as X
from basketry.llm.hashing import byte_windows, chunks, mix, sliding, span_hashes, text_buffer, whole_windows
from basketry.llm.scratch import bucketed, read_table, ship, shuffles_freed, stored, stored_within

WINDOW = 50
ANCHOR = 24
HOT_SEGMENTS = 20_000
GROUP_SEGMENTS = 20_000

SEGMENTS = "code long, doc long, version string, start long, seg binary"
FOUND = "doc long, version string, starts binary"
RESULT = "doc_id long, version string, n_removed long, n_spans long, kept_sha256 string"


class _Chunk:
    def __init__(self, part: np.ndarray, at: np.ndarray, window: int, anchor: int):
        self.part, self.at, self.window = part, at, window
        self.parts = byte_windows(part, anchor)
        self.n = max(0, len(part) - window + 1)
        self.whole = whole_windows(at, self.n, window)
        self.least = sliding(self.parts, window - anchor + 1)[: self.n]
        self.width = window - anchor + 1

    def chosen(self) -> np.ndarray:
        if not self.n:
            return np.zeros(0, np.int64)
        pad = np.zeros(self.width - 1, np.uint64)
        most = sliding(np.concatenate([pad, np.where(self.whole, self.least, np.uint64(0)), pad]), self.width, np.maximum)
        return np.flatnonzero((most == self.parts) & (self.parts != 0))

    def rows(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.at, positions, "right") - 1

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """First window and window after the last of each run with one anchor within one document."""
        if not self.n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        begin = np.ones(self.n, bool)
        begin[1:] = (self.least[1:] != self.least[:-1]) | (self.whole[1:] != self.whole[:-1])
        inner = self.at[1:-1]
        begin[inner[inner < self.n]] = True
        first = np.flatnonzero(begin)
        last = np.append(first[1:], self.n)
        ok = self.whole[first]
        return first[ok], last[ok]


def _parsed(batch: pa.RecordBatch, window: int, anchor: int):
    buf, offs = text_buffer(batch.column(1))
    for lo, hi, part, at in chunks(buf, offs):
        yield lo, hi, _Chunk(part, at, window, anchor)


def _blobs(col: pa.Array, kind=np.uint64) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) if x.is_valid else np.zeros(0, kind) for x in col]


def _anchors(buckets: int, window: int, anchor: int):
    def entries(batch):
        docs = batch.column(0).to_numpy()
        for lo, hi, c in _parsed(batch, window, anchor):
            at = c.chosen()
            yield X.distinct_entries(docs[lo:hi][c.rows(at)], X.codes_of(c.parts[at], buckets))

    return entries


def _live_runs(c: _Chunk, known: list[np.ndarray], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs whose anchor other documents have: first window, end, anchor code, hash of the segment's bytes."""
    first, last = c.runs()
    codes = X.codes_of(c.least[first], buckets)
    alive = X.held_by_row(X.low_bits(codes), np.searchsorted(first, c.at), known)
    first, last, codes = first[alive], last[alive], codes[alive]
    return first, last, codes, span_hashes(c.part, first, last + (c.window - 1)) if len(c.part) else codes


#: A segment's name in replies: the lowest bit is 0 if the document loses it, 1 if it shall send its bytes.
def _tags(codes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return mix(mix(codes) ^ hashes) & ~np.uint64(1)


def _segments_sent(buckets: int, window: int, anchor: int):
    def entries(batch):
        docs = batch.column(0).to_numpy()
        known = _blobs(batch.column(2), np.uint32)
        for lo, hi, c in _parsed(batch, window, anchor):
            first, _, codes, hashes = _live_runs(c, known[lo:hi], buckets)
            yield X.distinct_entries(docs[lo:hi][c.rows(first)], codes, hashes)

    return entries


def _send(parts: list[tuple], reply_buckets: int) -> Iterator[pa.RecordBatch]:
    """Of the flush's documents with an equal segment only the smallest asks; the others lose it."""
    docs, codes, hashes, _ = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((docs, hashes, codes))
    docs, codes, hashes = docs[order], codes[order], hashes[order]
    new = np.ones(len(codes), bool)
    new[1:] = (codes[1:] != codes[:-1]) | (hashes[1:] != hashes[:-1])
    low = docs[np.flatnonzero(new)][np.cumsum(new) - 1]
    lose = docs != low
    if lose.any():
        yield X.told_rows(docs[lose], _tags(codes[lose], hashes[lose]), reply_buckets)
    yield X.entry_rows((codes[new] >> np.uint64(32)).astype(np.int64), docs[new], X.low_bits(codes[new]), hashes[new])


def _judge(pdf: pd.DataFrame, reply_buckets: int) -> pd.DataFrame:
    bucket = int(pdf["bucket"].iloc[0])
    if bucket < 0:
        return X.passed(pdf)
    docs = np.concatenate([X.unpack_docs(x) for x in pdf["docs"]])
    codes = np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["keys"]]).astype(np.uint64) | np.uint64(bucket) << np.uint64(32)
    hashes = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["extra"]])
    order = np.lexsort((docs, hashes, codes))
    docs, codes, hashes = docs[order], codes[order], hashes[order]
    new = np.ones(len(codes), bool)
    new[1:] = (codes[1:] != codes[:-1]) | (hashes[1:] != hashes[:-1])
    low = docs[np.flatnonzero(new)][np.cumsum(new) - 1]
    lose = docs != low
    own_c, own_h, own_d = codes[new], hashes[new], docs[new]
    begin = np.ones(len(own_c), bool)
    begin[1:] = own_c[1:] != own_c[:-1]
    size = np.diff(np.append(np.flatnonzero(begin), len(own_c)))
    several = (size > 1)[np.cumsum(begin) - 1]
    tags = np.concatenate([_tags(codes[lose], hashes[lose]), _tags(own_c[several], own_h[several]) | np.uint64(1)])
    return X.reply_rows(np.concatenate([docs[lose], own_d[several]]), tags, reply_buckets)


def _segments(batches: Iterator[pa.RecordBatch], buckets: int, window: int, anchor: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the segments that a document shall send."""
    for batch in batches:
        known, told = _blobs(batch.column(2), np.uint32), _blobs(batch.column(3))
        for lo, hi, c in _parsed(batch, window, anchor):
            first, last, codes, hashes = _live_runs(c, known[lo:hi], buckets)
            border = np.searchsorted(first, c.at)
            send = np.flatnonzero(X.held_by_row(_tags(codes, hashes) | np.uint64(1), border, told[lo:hi]))
            row = c.rows(first[send])
            raw = c.part.tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array(codes[send].view(np.int64)), batch.column(0).take(pa.array(lo + row)), batch.column(4).take(pa.array(lo + row)),
                 pa.array(first[send] - c.at[row]), pa.array([raw[a : b + window - 1] for a, b in zip(first[send], last[send])], pa.binary())],
                ["code", "doc", "version", "start", "seg"],
            )


def suffix_array(segments: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two-stage suffix sorting of segments, each ended by a symbol below all bytes, by their first ``window`` bytes.

    Suffixes shorter than ``window`` are left out unless a longer one is induced from them. Returns the text's
    symbols (byte + 1; 0 ends a segment), the sorted suffixes, and the start of each segment.
    """
    sizes = np.fromiter(map(len, segments), np.int64, len(segments)) + 1
    begin = np.cumsum(sizes) - sizes
    text = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8).astype(np.int16) + 1
    text[begin + sizes - 1] = 0
    n = len(text)
    # smaller than the successor: the next different symbol is larger; a segment's end is the smallest there is
    change = np.flatnonzero(np.append(text[1:] != text[:-1], True))
    grows = np.append(text[1:][change[:-1]] > text[:-1][change[:-1]], False)
    small = np.repeat(grows, np.diff(np.append(-1, change)))
    ends = text == 0
    small |= ends  # sorted directly, like all others that nothing can induce
    # the last suffix of a segment that counts, and on to the next that is sorted directly
    direct = np.flatnonzero(small)
    last = direct[np.searchsorted(direct, begin + np.maximum(sizes - 1 - window, 0))]
    needed = np.arange(n) <= np.repeat(last, sizes)
    direct = direct[needed[direct]]
    raw = b"\0".join(segments) + b"\0"
    stop = np.minimum(np.repeat(begin + sizes - 1, sizes)[direct], direct + window)
    keys = [raw[a:b] for a, b in zip(direct.tolist(), stop.tolist())]
    direct = direct[sorted(range(len(direct)), key=keys.__getitem__)]
    count = np.bincount(text[needed], minlength=258)
    n = int(count.sum())
    tail = np.cumsum(count)
    head = tail - count
    of_direct = text[direct]
    first = np.searchsorted(of_direct, np.arange(258))
    after = np.searchsorted(of_direct, np.arange(258), "right")
    out = np.empty(n, np.int64)
    filled = head.copy()

    def induce(block: np.ndarray, symbol: int) -> np.ndarray:
        """Suffixes one longer than those of the block, appended to their buckets; those of the same bucket."""
        before = block[block > 0] - 1
        before = before[~small[before]]
        symbols = text[before]
        order = np.argsort(symbols, kind="stable")
        before, symbols = before[order], symbols[order]
        edge = np.flatnonzero(np.append(True, symbols[1:] != symbols[:-1])) if len(symbols) else []
        same = before[:0]
        for a, b in zip(edge, np.append(edge[1:], len(symbols)) if len(edge) else []):
            s = symbols[a]
            out[filled[s] : filled[s] + b - a] = before[a:b]
            filled[s] += b - a
            if s == symbol:
                same = before[a:b]
        return same

    for symbol in np.flatnonzero(count):
        block = out[head[symbol] : filled[symbol]].copy()
        while len(block):
            block = induce(block, symbol)
        own = direct[first[symbol] : after[symbol]]
        out[tail[symbol] - len(own) : tail[symbol]] = own
        if len(own):
            induce(own, -1)
    return text, out, begin


def common_prefixes(text: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """Length, up to ``limit``, of the common prefix of each suffix and the one before it, within a segment."""
    lcp = np.zeros(len(order), np.int64)
    active = np.arange(1, len(order))
    padded = np.concatenate([text, np.zeros(limit, text.dtype)])
    for k in range(limit):
        a, b = padded[order[active] + k], padded[order[active - 1] + k]
        active = active[(a == b) & (a > 0)]
        lcp[active] = k + 1
        if not len(active):
            break
    return lcp


def smaller_owner(segments: list[bytes], docs: np.ndarray, window: int) -> list[np.ndarray]:
    """For each segment, the starts of its windows that a segment of a smaller document holds as well."""
    text, order, begin = suffix_array(segments, window)
    lcp = common_prefixes(text, order, window)
    group = np.cumsum(lcp < window) - 1
    owner = np.searchsorted(begin, order, "right") - 1
    sizes = np.append(begin[1:], len(text)) - begin - 1
    full = order - begin[owner] + window <= sizes[owner]
    low = np.full(group[-1] + 1, np.iinfo(np.int64).max)
    np.minimum.at(low, group[full], docs[owner[full]])
    hit = full & (low[group] < docs[owner])
    at, own = order[hit], owner[hit]
    by = np.lexsort((at, own))
    at, own = at[by], own[by]
    edge = np.searchsorted(own, np.arange(len(segments) + 1))
    return [at[a:b] - begin[i] for i, (a, b) in enumerate(zip(edge[:-1], edge[1:]))]


def _resolve(pdf: pd.DataFrame, window: int) -> pd.DataFrame:
    starts = smaller_owner(list(pdf["seg"]), pdf["doc"].to_numpy(), window)
    blobs = [(s + a).astype(np.int64).tobytes() for s, a in zip(starts, pdf["start"])]
    out = pd.DataFrame({"doc": pdf["doc"], "version": pdf["version"], "starts": blobs})
    return out[[len(s) > 0 for s in starts]]


def _windows_of(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, at, keys = [], [], []
        for r, (start, seg) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
            for k in range(len(seg) - window + 1):
                row.append(r)
                at.append(start + k)
                keys.append(seg[k : k + window])
        take = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(at, pa.int64()), pa.array(keys, pa.binary())], ["doc", "version", "start", "bytes"])


def resolved(segments: DataFrame, window: int = WINDOW, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """``doc, version, starts``: the windows of each segment that a smaller document holds too."""
    spark = segments.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = int(max(4 * partitions, -(-segments.count() // GROUP_SEGMENTS)))
    hot = segments.groupBy("code").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_segments).select("code")
    hot = stored(hot, "hot-anchors")
    any_hot = not hot.isEmpty()
    # at most one row per ``hot_segments`` segments; the segments' bytes are shuffled once, by their group
    cool = segments.join(F.broadcast(hot), "code", "left_anti") if any_hot else segments
    cool = cool.withColumn("group", F.pmod(F.xxhash64("code"), F.lit(groups)))
    sorted_ = cool.groupBy("group").applyInPandas(lambda pdf: _resolve(pdf, window), FOUND)
    if not any_hot:
        return sorted_
    windows = segments.join(F.broadcast(hot), "code", "left_semi").select("doc", "version", "start", "seg")
    windows = windows.mapInArrow(lambda it: _windows_of(it, window), "doc long, version string, start long, bytes binary")
    low = windows.groupBy("bytes").agg(F.min("doc").alias("low"))
    rest = windows.join(low, "bytes").where("low < doc").select("doc", "version", F.col("start"))
    rest = rest.mapInArrow(_as_blobs, FOUND)
    return sorted_.unionByName(rest)


def _as_blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([int(x).to_bytes(8, "little") for x in b.column(2).to_pylist()], pa.binary())], ["doc", "version", "starts"])


def _removed(batches: Iterator[pa.RecordBatch], buckets: int, window: int, anchor: int) -> Iterator[pa.RecordBatch]:
    import hashlib

    for batch in batches:
        known, told = _blobs(batch.column(2), np.uint32), _blobs(batch.column(3))
        starts = [np.frombuffer(b"".join(x or []), np.int64) for x in batch.column(5).to_pylist()]
        for lo, hi, c in _parsed(batch, window, anchor):
            first, last, codes, hashes = _live_runs(c, known[lo:hi], buckets)
            lose = X.held_by_row(_tags(codes, hashes), np.searchsorted(first, c.at), told[lo:hi])
            cover = np.zeros(len(c.part) + 1, np.int64)
            np.add.at(cover, first[lose], 1)
            np.add.at(cover, last[lose] + (window - 1), -1)
            for r in range(lo, hi):
                if len(starts[r]):
                    np.add.at(cover, starts[r] + c.at[r - lo], 1)
                    np.add.at(cover, starts[r] + c.at[r - lo] + window, -1)
            gone = np.cumsum(cover)[:-1] > 0
            rows, removed, spans, digest = [], [], [], []
            for r, (a, b) in enumerate(zip(c.at[:-1], c.at[1:])):
                g = gone[a:b]
                if g.any():
                    rows.append(lo + r)
                    removed.append(int(g.sum()))
                    spans.append(int(g[0]) + int((g[1:] & ~g[:-1]).sum()))
                    digest.append(hashlib.sha256(c.part[a:b][~g].tobytes()).hexdigest())
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(4).take(take), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string())],
                ["doc_id", "version", "n_removed", "n_spans", "kept_sha256"],
            )


def shared_bytes_removed(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """``doc_id, version, n_removed, n_spans, kept_sha256`` of the documents that lose bytes."""
    ship(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null and text is not null")
    size, n = X.text_bytes(rows)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets, replies = X.bucket_count(size / 14, partitions), int(max(partitions, n // X.REPLY_DOCS))
    with shuffles_freed(spark), ExitStack() as held:
        # the anchors' shuffles are gone before the texts are shuffled
        found = X.repeated_keys(rows, _anchors(buckets, window, anchor), buckets, replies, other_doc=True, narrow=True)
        with bucketed(found, "doc", "anchors") as found:
            alive = rows.withColumn("version", F.md5("text")).join(found, rows.doc_id == found.doc)
            alive = held.enter_context(bucketed(alive.select("doc_id", "text", "codes", "version"), "doc_id", "suffixes", "zstd"))
        sent = alive.select("doc_id", "text", "codes").mapInArrow(
            lambda it: X.gather(it, _segments_sent(buckets, window, anchor), lambda parts: _send(parts, replies)), X.ENTRIES
        )
        told = sent.groupBy("bucket").applyInPandas(lambda pdf: _judge(pdf, replies), "bucket long, docs binary, keys binary")
        with stored_within(told, "segments-judged") as told:
            told = stored(X.by_document(told).select("doc", F.col("codes").alias("told")), "segment-replies")
        both = alive.join(told, F.col("doc_id") == F.col("doc")).select("doc_id", "text", "codes", "told", "version")
        segments = stored(both.mapInArrow(lambda it: _segments(it, buckets, window, anchor), SEGMENTS), "segments")
        # by document alone, as the texts lie: they are not shuffled again; a text's own starts are picked after the join
        starts = resolved(segments, window, hot_segments).groupBy("doc").agg(F.collect_list(F.struct("version", "starts")).alias("found"))
        starts = stored(starts.withColumnRenamed("doc", "owner"), "segment-starts")
        last = both.join(starts, F.col("doc_id") == F.col("owner"), "left")
        own = F.transform(F.filter("found", lambda s: s["version"] == F.col("version")), lambda s: s["starts"]).alias("starts")
        last = last.select("doc_id", "text", "codes", "told", "version", own)
        out = stored(last.mapInArrow(lambda it: _removed(it, buckets, window, anchor), RESULT), "bytes-removed")
    return out.dropDuplicates(["doc_id", "version"])


def remove_shared_bytes(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row of ``docs``."""
    lost = shared_bytes_removed(docs, window)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long"), F.octet_length(text).cast("long").alias("n_bytes"), F.md5(text).alias("version"), F.sha2(text, 256).alias("sha")
    )
    return rows.join(lost, ["doc_id", "version"], "left").select(
        "doc_id", "n_bytes", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_removed", "n_spans")),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
    )


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_shared_bytes(read_table(spark, sf_dir, "documents"))
