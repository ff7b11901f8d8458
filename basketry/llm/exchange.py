"""Which keys of a corpus occur more than once: a packed exchange between documents.

A map task gathers (document, key) entries, deals them to buckets by key and sends each bucket's entries as one
row of byte strings, about 5 bytes an entry instead of a row an entry. A key that several documents of the same
task hold is known to be repeated: those documents get their reply at once and the key is sent on only once, so
a key in a third of all documents costs one entry a task. A second exchange gathers the replies of a document.

Two reducers are offered: ``repeated_keys`` (keys seen at least twice) and, in ``suffix_dedup``, one that also
compares what is found around a key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.hashing import mix

#: Entries that a map task gathers before it sends them.
FLUSH_ENTRIES = 1_500_000
#: Entries a bucket should have at most.
BUCKET_ENTRIES = 1_000_000
#: Documents whose replies are gathered in one group.
REPLY_DOCS = 4_000

ENTRIES = "bucket long, docs binary, keys binary, extra binary"
REPLY = "doc long, codes binary"

ANY = np.int64(np.iinfo(np.int64).min)  # stands for "several documents of one task"


def pack_ints(values: np.ndarray) -> bytes:
    """int64 values as first value and differences in the narrowest type that holds them."""
    if not len(values):
        return b""
    step = np.diff(values)
    for kind in (np.uint8, np.uint16, np.uint32):
        if not len(step) or (step.min() >= 0 and step.max() <= np.iinfo(kind).max):
            return np.dtype(kind).char.encode() + values[:1].tobytes() + step.astype(kind).tobytes()
    return b"q" + values.tobytes()


def unpack_ints(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, np.int64)
    kind = raw[:1].decode()
    if kind == "q":
        return np.frombuffer(raw, np.int64, offset=1)
    first = np.frombuffer(raw, np.int64, 1, offset=1)
    return np.concatenate([first, first + np.cumsum(np.frombuffer(raw, kind, offset=9), dtype=np.int64)])


def pack_docs(docs: np.ndarray) -> bytes:
    """Sorted documents, the ``ANY`` entries (which sort first) as a count."""
    known = int(np.searchsorted(docs, ANY, "right"))
    return np.uint32(known).tobytes() + pack_ints(docs[known:])


def unpack_docs(raw: bytes) -> np.ndarray:
    known = int(np.frombuffer(raw, np.uint32, 1)[0])
    return np.concatenate([np.full(known, ANY), unpack_ints(raw[4:])])


def codes_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket in the upper 32 bits and the key's lower 32 bits: a filter's key. Different keys may share a code;
    a filter then keeps a few candidates more."""
    return ((keys >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | (keys & np.uint64(0xFFFFFFFF))


def low_bits(codes: np.ndarray) -> np.ndarray:
    return (codes & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def bucket_count(entries: float, partitions: int) -> int:
    return int(max(2 * partitions, -(-entries // BUCKET_ENTRIES)))


def entry_rows(bucket: np.ndarray, docs: np.ndarray, keys: np.ndarray, extra: np.ndarray) -> pa.RecordBatch:
    """One row per bucket; within it by document. ``extra`` may be empty."""
    order = np.lexsort((docs, bucket))
    bucket, docs, keys = bucket[order], docs[order], keys[order]
    extra = extra[order] if len(extra) else extra
    cut = np.flatnonzero(np.diff(bucket)) + 1
    edges = np.concatenate([[0], cut, [len(bucket)]]) if len(bucket) else np.zeros(1, np.int64)
    spans = list(zip(edges[:-1], edges[1:]))
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[edges[:-1]], pa.int64()), pa.array([pack_docs(docs[a:b]) for a, b in spans], pa.binary()),
         pa.array([keys[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([extra[a:b].tobytes() for a, b in spans], pa.binary())],
        ["bucket", "docs", "keys", "extra"],
    )


def _send(parts: list[tuple], buckets: int, reply_buckets: int, wide: bool, other_doc: bool, narrow: bool = False) -> Iterator[pa.RecordBatch]:
    """Entries of one flush: (docs, codes, extra, several). A key's reply needs no exchange if two documents (or,
    unless ``other_doc``, two places of one document) of the flush hold it."""
    docs, codes, extra, several = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((docs, extra, codes)) if wide else np.lexsort((docs, codes))
    docs, codes, extra, several = docs[order], codes[order], extra[order], several[order]
    new = np.ones(len(codes), bool)
    new[1:] = codes[1:] != codes[:-1]
    if wide:
        new[1:] |= extra[1:] != extra[:-1]
    group = np.cumsum(new) - 1
    first, last = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(codes)) - 1
    known = docs[first] != docs[last]
    if not other_doc:
        known |= np.logical_or.reduceat(several, first) | (first != last)
    told = known[group]
    if told.any():
        yield told_rows(docs[told], low_bits(codes[told]) if narrow else codes[told], reply_buckets)
    ask = np.where(known, ANY, docs[first])
    own, more = codes[first], extra[first]
    bucket = ((own >> np.uint64(32)) if not wide else own % np.uint64(buckets)).astype(np.int64)
    keys = own if wide else low_bits(own)
    yield entry_rows(bucket, ask, keys, more if wide else more[:0])


def told_rows(docs: np.ndarray, codes: np.ndarray, reply_buckets: int) -> pa.RecordBatch:
    """Replies that a map task can give itself; they pass the reducer under negative buckets."""
    return entry_rows(-1 - (mix_docs(docs) % np.uint64(reply_buckets)).astype(np.int64), docs, codes, codes[:0])


def mix_docs(docs: np.ndarray) -> np.ndarray:
    return mix(docs.astype(np.int64).view(np.uint64))


def gather(batches: Iterator[pa.RecordBatch], entries_of: Callable, send: Callable) -> Iterator[pa.RecordBatch]:
    """``send`` of the entries of a task, some ``FLUSH_ENTRIES`` at a time."""
    parts, n = [], 0
    for batch in batches:
        for entry in entries_of(batch):
            parts.append(entry)
            n += len(entry[0])
            if n >= FLUSH_ENTRIES:
                yield from send(parts)
                parts, n = [], 0
    if n:
        yield from send(parts)


def passed(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"bucket": -1 - pdf["bucket"], "docs": pdf["docs"], "keys": pdf["keys"]})


def _judge(pdf: pd.DataFrame, wide: bool, other_doc: bool, reply_buckets: int, narrow: bool = False) -> pd.DataFrame:
    """Replies for one bucket of keys; a bucket of replies passes through."""
    bucket = int(pdf["bucket"].iloc[0])
    if bucket < 0:
        return passed(pdf)
    docs = np.concatenate([unpack_docs(x) for x in pdf["docs"]])
    if wide:
        codes = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["keys"]])
        extra = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["extra"]])
        order = np.lexsort((extra, codes))
        codes, extra, docs = codes[order], extra[order], docs[order]
    else:
        codes = np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["keys"]])
        order = np.argsort(codes, kind="stable")
        codes, docs = codes[order], docs[order]
    new = np.ones(len(codes), bool)
    new[1:] = codes[1:] != codes[:-1]
    if wide:
        new[1:] |= extra[1:] != extra[:-1]
    first = np.flatnonzero(new)
    low, high = np.minimum.reduceat(docs, first), np.maximum.reduceat(docs, first)
    repeated = (low != high) | (low == ANY)
    if not other_doc:
        repeated |= np.diff(np.append(first, len(codes))) > 1
    told = repeated[np.cumsum(new) - 1] & (docs != ANY)
    codes, docs = codes[told] if narrow else codes[told].astype(np.uint64), docs[told]
    if not wide and not narrow:
        codes |= np.uint64(bucket) << np.uint64(32)
    return reply_rows(docs, codes, reply_buckets)


def reply_rows(docs: np.ndarray, codes: np.ndarray, reply_buckets: int) -> pd.DataFrame:
    to = (mix_docs(docs) % np.uint64(reply_buckets)).astype(np.int64)
    order = np.lexsort((docs, to))
    to, docs, codes = to[order], docs[order], codes[order]
    edges = np.concatenate([[0], np.flatnonzero(np.diff(to)) + 1, [len(to)]]) if len(to) else np.zeros(1, np.int64)
    spans = list(zip(edges[:-1], edges[1:]))
    return pd.DataFrame({
        "bucket": to[edges[:-1]], "docs": [pack_docs(docs[a:b]) for a, b in spans], "keys": [codes[a:b].tobytes() for a, b in spans],
    }).astype({"bucket": np.int64})


def _by_document(pdf: pd.DataFrame, kind: type = np.uint64) -> pd.DataFrame:
    docs = np.concatenate([unpack_docs(x) for x in pdf["docs"]])
    codes = np.concatenate([np.frombuffer(x, kind) for x in pdf["keys"]])
    order = np.lexsort((codes, docs))
    docs, codes = docs[order], codes[order]
    edges = np.concatenate([[0], np.flatnonzero(np.diff(docs)) + 1, [len(docs)]])
    return pd.DataFrame({"doc": docs[edges[:-1]], "codes": [np.unique(codes[a:b]).tobytes() for a, b in zip(edges[:-1], edges[1:])]})


def by_document(replies: DataFrame, kind: type = np.uint64) -> DataFrame:
    """``doc, codes``: one row per document with the sorted codes it was told."""
    return replies.groupBy("bucket").applyInPandas(lambda pdf: _by_document(pdf, kind), REPLY)


def repeated_keys(
    rows: DataFrame, entries_of: Callable, buckets: int, reply_buckets: int, wide: bool = False, other_doc: bool = False,
    narrow: bool = False,
) -> DataFrame:
    """``doc, codes``: of the keys each document sent, the codes of those that are repeated.

    ``entries_of(batch)`` yields (documents int64, codes uint64, second keys uint64 or zeros, several bool) with at
    most one entry for a document and key; ``several`` says that the document holds the key at two places.
    ``wide``: keys are two 64-bit values, compared in full; otherwise they are ``codes_of`` codes. ``other_doc``:
    only keys that two documents hold count as repeated. ``narrow`` (not with ``wide``): replies are the codes'
    ``low_bits``, half as long; a filter within one document then keeps a few candidates more.
    """
    sent = rows.mapInArrow(
        lambda it: gather(it, entries_of, lambda parts: _send(parts, buckets, reply_buckets, wide, other_doc, narrow)), ENTRIES
    )
    replies = sent.groupBy("bucket").applyInPandas(
        lambda pdf: _judge(pdf, wide, other_doc, reply_buckets, narrow), "bucket long, docs binary, keys binary"
    )
    return by_document(replies, np.uint32 if narrow else np.uint64)


def distinct_entries(docs: np.ndarray, codes: np.ndarray, extra: np.ndarray | None = None) -> tuple:
    """One entry for each document and key, and whether the document holds the key at several places."""
    wide = extra is not None
    order = np.lexsort((extra, codes, docs)) if wide else np.lexsort((codes, docs))
    docs, codes = docs[order], codes[order]
    extra = extra[order] if wide else np.zeros(len(codes), np.uint64)
    new = np.ones(len(codes), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (codes[1:] != codes[:-1]) | (extra[1:] != extra[:-1])
    first = np.flatnonzero(new)
    return docs[first], codes[first], extra[first], np.diff(np.append(first, len(codes))) > 1


def held(codes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which codes are among the sorted ``known`` ones."""
    if not len(known):
        return np.zeros(len(codes), bool)
    at = np.searchsorted(known, codes)
    at[at == len(known)] = 0
    return known[at] == codes


def held_by_row(codes: np.ndarray, border: np.ndarray, known: list[np.ndarray]) -> np.ndarray:
    """``held`` of each row's own codes; row r has ``codes[border[r]:border[r + 1]]``."""
    out = np.zeros(len(codes), bool)
    for a, b, k in zip(border[:-1], border[1:], known):
        if b > a and len(k):
            out[a:b] = held(codes[a:b], k)
    return out


def text_bytes(docs: DataFrame) -> tuple[int, int]:
    """Bytes of text and rows of a table; sizes buckets and nothing else."""
    n, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.col("text").cast("string")))).first()
    return int(size or 0), int(n)
