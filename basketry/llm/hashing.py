"""Vectorised word and window hashing over Arrow text columns.

A chunk is a run of whole documents from one Arrow batch, seen as one byte array with offsets. Hashes are
polynomials modulo 2**64 over random byte values; a window's hash comes from two prefix sums, so its cost does
not depend on the window's length. All functions run inside tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that separate words: space and 0x09-0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: A-Z to a-z, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

CHUNK_BYTES = 1 << 20


def _byte_values(seed: int) -> np.ndarray:
    raw = b"".join(hashlib.sha256(f"byte {seed} {i}".encode()).digest()[:8] for i in range(256))
    return np.frombuffer(raw, np.uint64) | np.uint64(1)


#: One table of byte values and two multipliers (bytes, words) for each of two independent hashes.
BYTES = [_byte_values(0), _byte_values(1)]
BASES = [0x9E3779B97F4A7C15, 0xD1342543DE82EF95]
WORD_BASES = [0xBF58476D1CE4E5B9, 0x94D049BB133111EB]

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_table(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i < n; kept per worker and grown as needed."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK_BYTES + 4096)
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
        if size <= 8 * CHUNK_BYTES:
            _powers[base] = have
    return have[0][:n], have[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser, so that any bits of the result can serve as a key."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes and int64 offsets (null: empty), without copying a document."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    t = pa.types
    if not (t.is_string(col.type) or t.is_large_string(col.type) or t.is_binary(col.type)):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("" if not t.is_binary(col.type) else b"")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = t.is_large_string(col.type)
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[o[0] : o[-1]], o - o[0]


def chunks(buf: np.ndarray, offs: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of whole documents of about ``limit`` bytes; a
    longer document is a chunk of its own."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def word_spans(buf: np.ndarray, offs: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the index of each document's first word (one more at the end). ``between``:
    for each byte, whether it separates words."""
    if len(buf) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    space = between[buf]
    start, end = ~space, ~space
    first = offs[:-1][offs[:-1] < offs[1:]]  # a document's first byte always starts anew
    inner = first[first > 0]
    keep = start[inner].copy()
    last = end[inner - 1].copy()
    start[1:] &= space[:-1]
    end[:-1] &= space[1:]
    start[inner] = keep
    end[inner - 1] = last
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offs)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hash of the bytes of each span."""
    up, down = _power_table(BASES[which], len(buf) + 1)
    prefix = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(BYTES[which][buf] * up[:-1], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts])


def byte_windows(buf: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """Hash of the ``length`` bytes from each position; the caller drops windows that cross documents."""
    n = len(buf) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _power_table(BASES[which], len(buf) + 1)
    prefix = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(BYTES[which][buf] * up[:-1], out=prefix[1:])
    return mix((prefix[length:] - prefix[:n]) * down[:n])


def word_windows(words: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """Hash of the ``length`` words (given as hashes) from each word."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _power_table(WORD_BASES[which], len(words) + 1)
    prefix = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[:-1], out=prefix[1:])
    return mix((prefix[length:] - prefix[:n]) * down[:n])


def whole_windows(first: np.ndarray, n: int, length: int) -> np.ndarray:
    """Which of the n windows lie in one document; ``first``: index of each document's first item, and the end."""
    ok = np.ones(max(n, 0), bool)
    for k in first[1:-1]:  # windows that begin less than ``length`` items before a border cross it
        ok[max(0, k - length + 1) : k] = False
    return ok


def sliding(values: np.ndarray, width: int, op=np.minimum) -> np.ndarray:
    """``op`` over each ``width`` consecutive values, in log2(width) passes."""
    out, have = values, 1
    while have < width and len(out):
        step = min(have, width - have)
        out = op(out[:-step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out


def range_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of the words from each start up to its end (both are indexes of words)."""
    up, down = _power_table(WORD_BASES[which], len(words) + 1)
    prefix = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[:-1], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts])
