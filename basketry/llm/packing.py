"""Operator 6: best-fit-decreasing packing of token sequences.

1. Tokenise every document once. A document longer than the window is cut into full windows; what is left over
   (1 to window - 1 ids) is one more piece. Only piece descriptions leave the task, never ids.
2. Deal the pieces by hash into groups of about ``group_pieces`` pieces, so no task grows with the input.
3. In each group, full pieces are sequences of their own. The rest go, longest first, into the open sequence
   with the least sufficient room. A segment tree over the remaining capacities finds it in log2(window) steps.

Cases: null text is empty (one piece, the end id alone); an empty table gives no rows; repeated rows of a
document id are packed as separate documents; other columns are ignored, whatever their names; equal lengths
are taken in order of document id and start.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm.hashing import LOWER, SPACE, chunks, span_hashes, text_buffer, word_spans
from basketry.llm.scratch import read_table, ship, stored

WINDOW = 2048
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
GROUP_PIECES = 50_000
#: Words kept with their ids in each Python worker; beyond that the table starts anew.
CACHED_WORDS = 600_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECES + ", sequence_id long, offset long"


class _Words(dict):
    """Hash of a word (64 bits) -> row in the table of ids; new words go to the tokenizer in one call a chunk."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer = tokenizer
        self.new: list[int] = []
        self.ids = np.zeros(0, np.uint32)
        self.at = np.zeros(1, np.int64)

    def __missing__(self, word: int) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n

    def tokens(self, part: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words of a chunk in order, and the number of ids of each document."""
        starts, ends, first = word_spans(part, at)
        place, words = pd.factorize(span_hashes(part, starts, ends))
        rows = np.fromiter(map(self.__getitem__, words.tolist()), np.int64, len(words))
        if self.new:
            seen = np.empty(len(words), np.int64)
            seen[place[::-1]] = np.arange(len(place))[::-1]
            where = seen[rows >= len(self) - len(self.new)]
            raw = part.tobytes()
            text = [raw[a:b].decode() for a, b in zip(starts[where].tolist(), ends[where].tolist())]
            found = [e.ids for e in self.tokenizer.encode_batch(text, add_special_tokens=False)]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))])
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes)])
            self.new = []
        own, begin = _spread(self.at[rows], self.at[rows + 1] - self.at[rows])
        table, sizes = self.ids[own], np.diff(begin)  # the chunk's own words: small enough for the cache
        pick, upto = _spread(begin[place], sizes[place])
        return table[pick], np.diff(upto[first])


def _spread(start: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The indexes start, start + 1, ... of each run one after the other, and where each run begins (and the end)."""
    upto = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=upto[1:])
    index = np.repeat(start - upto[:-1], sizes)
    index += np.arange(len(index))
    return index, upto


#: A mark between a letter and white space is a token of its own to the tokenizer, and it lowers its input: apart
#: from their marks and in lower case, words have far fewer different spellings.
_MARK = np.isin(np.arange(256), list(b".,;:!?"))


def spelled_once(part: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chunk with fewer different words and the same ids; a chunk that may hold a special token stays as it is."""
    if b"<|" in part.tobytes():
        return part, at
    low = LOWER[part]
    letter = (low >= 97) & (low <= 122)
    marks = np.flatnonzero(letter[:-2] & _MARK[low[1:-1]] & SPACE[low[2:]]) + 1
    return np.insert(low, marks, 32), at + np.searchsorted(marks, at)


_kept: dict[str | None, _Words] = {}


def _words(path: str | None) -> _Words:
    """The worker's word table; a reused worker keeps it from task to task."""
    have = _kept.get(path)
    if have is None or len(have) > CACHED_WORDS:
        have = _kept[path] = _Words(_tokenizer(path))
    return have


def _tokenizer(path: str | None):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    return Tokenizer.from_file(path)


def _cut(batches: Iterator[pa.RecordBatch], path: str | None, window: int, end_id: int) -> Iterator[pa.RecordBatch]:
    last = np.uint32(end_id).astype("<u4").tobytes()
    for batch in batches:
        keys = batch.column(0)
        buf, offs = text_buffer(batch.column(1))
        for lo, hi, part, at in chunks(buf, offs):
            ids, sizes = _words(path).tokens(*spelled_once(part, at))
            ids = ids.astype("<u4", copy=False)
            rows, start, length, crc, total, begin = [], [], [], [], [], 0
            for r, n in enumerate(sizes.tolist()):
                own = memoryview(ids[begin : begin + n]).cast("B")
                begin += n
                for s in range(0, n + 1, window):
                    size = min(window, n + 1 - s)
                    c = zlib.crc32(own[4 * s : 4 * (s + size)])
                    rows.append(lo + r)
                    start.append(s)
                    length.append(size)
                    crc.append(zlib.crc32(last, c) if s + size == n + 1 else c)
                    total.append(n + 1)
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(rows, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(total, pa.int64())],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )


def token_pieces(docs: DataFrame, tokenizer_path: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: full windows of each document in order, then the rest."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        lambda it: _cut(it, tokenizer_path, window, end_id), PIECES
    )


class Rooms:
    """Open sequences by remaining capacity: a segment tree whose node is set if a capacity below it is in use."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.tree = bytearray(2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def tightest(self, length: int) -> int:
        """The smallest capacity of at least ``length`` that an open sequence has; -1 if none has."""
        node = self.leaves + length
        if self.tree[node]:
            return length
        while node > 1 and not (node % 2 == 0 and self.tree[node + 1]):
            node //= 2
        if node <= 1:
            return -1
        node += 1
        while node < self.leaves:
            node = 2 * node if self.tree[2 * node] else 2 * node + 1
        return node - self.leaves

    def put(self, capacity: int, sequence: int) -> None:
        self.open[capacity].append(sequence)
        node = self.leaves + capacity
        while node and not self.tree[node]:
            self.tree[node] = 1
            node //= 2

    def take(self, capacity: int) -> int:
        sequence = self.open[capacity].pop()
        if not self.open[capacity]:
            node = self.leaves + capacity
            self.tree[node] = 0
            node //= 2
            while node and not (self.tree[2 * node] or self.tree[2 * node + 1]):
                self.tree[node] = 0
                node //= 2
        return sequence


def best_fit(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each length; ``lengths`` come longest first."""
    rooms, sequence, offset, used = Rooms(window), [], [], 0
    for n in lengths.tolist():
        room = rooms.tightest(n) if n < window else -1
        if room < 0:
            room, s, used = window, used, used + 1
        else:
            s = rooms.take(room)
        sequence.append(s)
        offset.append(window - room)
        if room > n:
            rooms.put(room - n, s)
    return np.array(sequence, np.int64), np.array(offset, np.int64)


def _pack_group(pdf: pd.DataFrame, window: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
    sequence, offset = best_fit(pdf["length"].to_numpy(), window)
    pdf["sequence_id"] = pdf["group"].to_numpy() * (1 << 32) + sequence
    pdf["offset"] = offset
    return pdf[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "known"]]


def pack(pieces: DataFrame, window: int = WINDOW, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; each group of about ``group_pieces`` pieces is packed alone. A piece's
    group comes from its place in the stored table as well, so equal pieces are dealt like different ones."""
    pieces = stored(pieces, "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))
    place = F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id())
    dealt = pieces.withColumn("group", F.pmod(place, F.lit(groups)))
    # pandas has no null integer: a missing id travels as 0 and a mark
    dealt = dealt.withColumns({"known": F.col("doc_id").isNotNull(), "doc_id": F.coalesce("doc_id", F.lit(0))})
    packed = dealt.groupBy("group").applyInPandas(lambda pdf: _pack_group(pdf, window), PACKED + ", known boolean")
    return packed.withColumn("doc_id", F.when(F.col("known"), F.col("doc_id"))).drop("known")


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    return pack(token_pieces(docs, tokenizer_path))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))
