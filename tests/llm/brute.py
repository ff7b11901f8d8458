"""Plain versions of the operators, straight from their definitions, for small tables."""

from __future__ import annotations

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, n=5):
    w = WORD.findall(lowered(text))
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def components(rows, hundredths=85):
    """doc_id -> (n_shingles, component_id); texts are linked from that similarity on."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for a in ids:
        for b in ids:
            if a < b:
                n = len(sets[a] & sets[b])
                if 100 * n >= hundredths * (len(sets[a]) + len(sets[b]) - n):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def without_repeats(rows, window=35):
    """(doc_id, n_words, n_removed, kept_sha256) of each row."""
    rows = [(i, WORD.findall(t or "")) for i, t in rows]
    seen = collections.Counter(tuple(w[k : k + window]) for _, w in rows for k in range(len(w) - window + 1))
    out = []
    for i, w in rows:
        keep = [True] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                keep[k : k + window] = [False] * window
        kept = " ".join(x for x, y in zip(w, keep) if y)
        out.append((i, len(w), keep.count(False), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def without_shared_bytes(rows, window=50):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row."""
    rows = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in rows:
        for k in range(len(b) - window + 1):
            first[b[k : k + window]] = min(first.get(b[k : k + window], i), i)
    out = []
    for i, b in rows:
        gone = bytearray(len(b))
        for k in range(len(b) - window + 1):
            if first[b[k : k + window]] < i:
                gone[k : k + window] = b"\1" * window
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)
