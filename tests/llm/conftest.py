from __future__ import annotations

import random

import pytest

#: Names that the operators use inside; documents may have them as well.
CLASHING = "doc long, codes string, version string, bucket int, hub string, score string, label int, kept_text string, _row int, copy int"


def prose(rnd: random.Random, n: int, vocabulary: int = 4000) -> str:
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


def odd_rows(seed: int = 3) -> list[tuple]:
    """(doc_id, text): nulls, empty, blank and very long texts, copies, near copies, shared passages, equal rows."""
    rnd = random.Random(seed)
    base, passage = prose(rnd, 300), prose(rnd, 60)
    rows = [(None, None), (None, "a text without id " + passage), (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "One"), (6, "two words")]
    rows += [(10, base), (11, base), (12, base.upper()), (13, base.replace("w", "W", 3))]
    words = base.split()
    for k in range(14, 40):  # near copies with more and more changes
        w = list(words)
        for _ in range(k - 13):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    for k in range(40, 52):
        rows.append((k, prose(rnd, rnd.randrange(5, 90)) + " " + passage + "\n" + prose(rnd, rnd.randrange(0, 40))))
    rows += [(52, passage + " " + passage), (53, prose(rnd, 34)), (54, prose(rnd, 40)), (55, "é" * 200), (56, "é" * 200 + "a"), (57, "ab" * 300)]
    rows += [(60, prose(rnd, 30_000)), (61, "z" * 150_000)]
    rows += [(70, rows[-3][1]), (71, prose(rnd, 200)), (71, prose(rnd, 50) + " " + passage), (80, prose(rnd, 7)), (80, prose(rnd, 7))]
    return rows + [rows[20], rows[-1]]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, "en", "s", len(t or ""), None, "c", "v", 1, "h", "s", 0, "k", 5, 6) for i, t in odd_rows()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + CLASHING).repartition(5)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("doc_id = -1")
