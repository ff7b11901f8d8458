"""Operator 8: which files govern their directory."""

from __future__ import annotations

import random
import textwrap

import duckdb

from basketry.llm import license_scan as L
from tests.conftest import SF_CHECK
from tests.llm.conftest import prose


def test_whole_licence_texts_govern(spark):
    flat = textwrap.fill(L.WHOLE[0][1], 76)  # no line of it is near a template
    mit, bsd = (t.replace("(c)", "\n\nCopyright (c) 2020 Some One\n\n").split("\n\n") for t in (dict(L.WHOLE)[k] for k in ("MIT", "BSD-3-Clause")))
    mit, bsd = ("\n\n".join(textwrap.fill(x, 76) for x in t) for t in (mit, bsd))
    long = prose(random.Random(1), 3000)
    line = "Licensed under the Apache License, Version 2.0"
    files = [
        ("a/LICENSE", mit), ("a/x.py", "code"), ("a/b/y.py", "code"), ("c/terms", flat), ("c/x.py", "code"), ("d/COPYING.txt", bsd), ("d/x.py", "code"), ("e/ours", bsd),
        ("e/x.py", "code"), ("f/COPYING", f"{line}\n{long}"), ("f/x.py", "code"), ("g/short.py", f"{line}\n{prose(random.Random(2), 30)}"), ("g/x.py", "code"),
        ("h/license.py", f"{line}\n{long}"), ("h/x.py", "code"), ("i/long.py", f"{mit}\n{long}"), ("i/x.py", "code"), ("j/LICENSE", long), ("j/x.py", "code"),
    ]
    out = L.scan(spark.createDataFrame(files, "path string, text string")).collect()
    got = {r.path: r.licence for r in out}
    assert len(out) == len(files) and got["a/LICENSE"] == got["i/long.py"] == "MIT" and got["g/short.py"] == "Apache-2.0"
    want = {"a": "MIT", "a/b": "MIT", "c": "MIT", "d": "BSD-3-Clause", "e": "BSD-3-Clause", "f": "Apache-2.0", "g": None, "h": None, "i": None, "j": None}
    assert {p.rsplit("/", 1)[0]: v for p, v in got.items() if p.endswith(("/x.py", "/y.py"))} == want


def test_whole_texts_of_near_relatives(spark):
    """A two-clause text is no three-clause text with a clause left out; half a text is none."""
    known = dict(L.WHOLE)
    files = [(f"{k}/x", t) for k, t in known.items()] + [("half/x", known["BSD-2-Clause"][: len(known["BSD-2-Clause"]) // 2])]
    got = {r.path: r.whole_licence for r in L.whole_texts(L.notices(spark.createDataFrame(files, "path string, text string"), "path"), "path").collect()}
    assert got == {f"{k}/x": k for k in known}


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_CHECK}/documents.parquet'")
    cursor = con.execute(L.OP8_SQL)
    names = [c[0] for c in cursor.description]
    got = L.op8_license_scan(spark, SF_CHECK)
    assert sorted(names) == sorted(got.columns)
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=str) == sorted(cursor.fetchall(), key=str)
