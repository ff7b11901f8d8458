"""The packed exchange in one process, with many small flushes as well as one, against a plain count."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from basketry.llm import exchange as X
from basketry.llm import suffix_dedup as S


def exchanged(tasks, send, judge):
    """doc -> codes it is told, for entry batches of several map tasks."""
    sent = []
    for batches in tasks:
        sent += [b.to_pandas() for b in X.gather(iter(batches), lambda entry: [entry], send)]
    replies = pd.concat([judge(g) for _, g in pd.concat(sent).groupby("bucket")])
    told = pd.concat([X._by_document(g) for _, g in replies.groupby("bucket")]) if len(replies) else pd.DataFrame({"doc": [], "codes": []})
    return {int(d): set(np.frombuffer(c, np.uint64).tolist()) for d, c in zip(told["doc"], told["codes"])}


def random_tasks(seed, wide):
    rnd = random.Random(seed)
    tasks, flat = [], []
    for task in range(3):
        batches = []
        for b in range(4):
            rows = []
            for doc in range(task * 100 + b * 10, task * 100 + b * 10 + 8):
                for _ in range(rnd.randrange(6)):
                    key = 7 if rnd.random() < 0.3 else rnd.randrange(1, 60)  # one key in a third of all entries
                    rows.append((doc, key << 33 | key, rnd.randrange(2) if wide else 0))
            flat += rows
            d, c, e = (np.array(x, t) for x, t in zip(zip(*rows), (np.int64, np.uint64, np.uint64)))
            batches.append(X.distinct_entries(d, X.codes_of(c, 5) if not wide else c, e if wide else None))
        tasks.append(batches)
    return tasks, flat


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("other_doc", [False, True])
@pytest.mark.parametrize("flush", [1, 15, 10**9])
def test_repeated_keys(monkeypatch, wide, other_doc, flush):
    monkeypatch.setattr(X, "FLUSH_ENTRIES", flush)
    tasks, flat = random_tasks(flush + wide, wide)
    got = exchanged(tasks, lambda p: X._send(p, 5, 3, wide, other_doc), lambda g: X._judge(g, wide, other_doc, 3))
    places = {}
    for doc, key, extra in flat:
        places.setdefault((key, extra), []).append(doc)
    want = {}
    for (key, extra), docs in places.items():
        if len(set(docs)) > 1 or (not other_doc and len(docs) > 1):
            code = key if wide else int(X.codes_of(np.array([key], np.uint64), 5)[0])
            for d in docs:
                want.setdefault(d, set()).add(code)
    assert got == want


@pytest.mark.parametrize("flush", [1, 15, 10**9])
def test_segments_are_told_apart(monkeypatch, flush):
    monkeypatch.setattr(X, "FLUSH_ENTRIES", flush)
    tasks, flat = random_tasks(flush, True)
    got = exchanged(tasks, lambda p: S._send(p, 3), lambda g: S._judge(g, 3))
    owners = {}
    for doc, key, extra in flat:
        owners.setdefault(key, {}).setdefault(extra, set()).add(doc)
    want = {}
    for key, kinds in owners.items():
        for extra, docs in kinds.items():
            tag = int(S._tags(np.array([key], np.uint64), np.array([extra], np.uint64))[0])
            for d in docs - {min(docs)}:
                want.setdefault(d, set()).add(tag)  # loses the segment
            if len(kinds) > 1:
                want.setdefault(min(docs), set()).add(tag | 1)  # sends its bytes
    assert got == want


def test_packed_integers():
    for values in ([], [5], [1, 1, 2], [0, 300], [0, 70_000], [0, 2**40], [-5, 3], [9, 2]):
        v = np.array(values, np.int64)
        assert X.unpack_ints(X.pack_ints(v)).tolist() == values
    docs = np.array([X.ANY, X.ANY, -3, 4, 4])
    assert X.unpack_docs(X.pack_docs(docs)).tolist() == docs.tolist()
    assert isinstance(X.entry_rows(np.zeros(0, np.int64), docs[:0], np.zeros(0, np.uint64), np.zeros(0, np.uint64)), pa.RecordBatch)


@pytest.mark.parametrize("flush", [1, 15, 10**9])
def test_narrow_replies_name_the_same_keys(monkeypatch, flush):
    monkeypatch.setattr(X, "FLUSH_ENTRIES", flush)
    tasks, _ = random_tasks(flush, False)
    sent = [b.to_pandas() for batches in tasks for b in X.gather(iter(batches), lambda entry: [entry], lambda p: X._send(p, 5, 3, False, True, True))]
    replies = pd.concat([X._judge(g, False, True, 3, True) for _, g in pd.concat(sent).groupby("bucket")])
    told = pd.concat([X._by_document(g, np.uint32) for _, g in replies.groupby("bucket")])
    got = {int(d): set(np.frombuffer(c, np.uint32).tolist()) for d, c in zip(told["doc"], told["codes"])}
    whole = exchanged(tasks, lambda p: X._send(p, 5, 3, False, True), lambda g: X._judge(g, False, True, 3))
    assert got == {d: {c & 0xFFFFFFFF for c in codes} for d, codes in whole.items()}
