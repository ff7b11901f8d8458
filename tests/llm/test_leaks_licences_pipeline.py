"""Operators 1 and 8 against plain versions; native plans; the pipeline stage by stage."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from basketry.llm import decontaminate as D
from basketry.llm import license_scan as L
from tests.conftest import SF_CHECK, SF_SMALL
from tests.llm import brute
from tests.llm.conftest import odd_rows, prose
from tests.llm.test_packing_topk import check_pieces

PYTHON = ["MapInArrow", "MapInPandas", "PythonUDF", "ArrowEval", "FlatMapGroups", "CartesianProduct", "NestedLoop"]


def plain_template(text):
    """Words and template of form INSIDE; a word's first letter is marked where the operator takes it for a name."""
    text = re.sub(r"(?<=\d)[.,:/](?=\d)", "", text or "")
    text = re.sub(rf"(?i)(?<=[0-9])(?=(?:{'|'.join(D.UNITS)})(?![^\W_]))", " ", text)
    text = re.sub(r"(?<=[a-zà-ÿ0-9]) (?=[A-ZÀ-Þ][a-zà-ÿ])|(?<=[a-zà-ÿ0-9],) (?=[A-ZÀ-Þ][a-zà-ÿ])", " \ue000", text)
    raw, canon = [], []
    for w in re.sub(r"[^\w\s\ue000]+|_", " ", text).split():
        v = w.lstrip("\ue000").lower()
        if v in D.NUMBERS and canon and canon[-1] == D.NUMBER and raw[-1].lstrip("\ue000").lower().split("\ue001")[-1] in D.NUMBERS:
            raw[-1] += "\ue001" + w
            continue
        kind = D.NUMBER if re.match(r"\d", v) or v in D.NUMBERS else D.UNIT if canon and canon[-1] == D.NUMBER and v in D.UNITS else None
        raw.append(w)
        canon.append(kind or (D.NAME if w[0] == "\ue000" else v))
    return raw, canon


def plain_leaks(docs, items):
    """(doc_id, item_id, windows found): shares of windows found anywhere, slots aside."""
    out = set()
    for d, t in docs:
        _, words = plain_template(t)
        for i, u in items:
            _, asked = plain_template(u)
            n = min(D.WINDOW, len(asked))
            windows = {tuple(asked[k : k + n]) for k in range(len(asked) - n + 1)} if asked else set()
            searched = {w for w in windows if any(x[0] != "<" for x in w)}
            have = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if n else set()
            if searched and len(searched & have) / len(searched) >= D.MIN_SHARE:
                out.add((d, i, len(searched & have)))
    return out


def test_leaks_of_a_table(spark):
    docs, items = (spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id, r.windows_found) for r in D.leaks(docs, items).collect()}
    want = plain_leaks([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert got == want and got


def test_reparameterised_questions_and_inconsistent_slots(spark):
    ask = "If Ann had 5 km to walk, then Bob and Ann walk 5 km in 2 hours, how far does Ann walk per hour on that day"
    rest = prose(random.Random(2), 30)
    docs = [
        (1, f"{rest} {ask} {rest}"),
        (2, f"{rest} {ask.replace('Ann', 'Sue').replace('Bob', 'Tim').replace('5', '7.5').replace('2 hours', '3 hours')} {rest}"),
        (3, f"{rest} {ask.replace('Ann', 'Sue', 1).replace('Ann', 'Eve', 1).replace('5', '8', 1)} {rest}"),
        (4, rest), (5, ask.replace("5 km", "6 miles")), (6, "how far does Ann walk"),
    ]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(7, ask), (8, None), (9, ""), (10, "5 km"), (None, ask), (7, ask)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in D.leaks(docs, items).collect()}
    assert set(got) == {(1, 7), (2, 7), (5, 7)}  # 3 gives Ann two names and 5 two numbers
    assert got[5, 7].share == 1.0 and got[1, 7].share > 0.9 and got[1, 7].slot_conflicts == 0 and got[2, 7].slots >= 3


def test_leaks_of_odd_rows(odd, empty, spark):
    passage = next(t for i, t in odd_rows() if i == 53)
    items = spark.createDataFrame([(1, passage, "x"), (2, None, "x"), (3, "one two three", "x")], "item_id long, text string, doc_id string")
    assert {(r.doc_id, r.item_id) for r in D.leaks(odd, items).collect()} == {(53, 1)}
    out = D.without_leaks(odd, items)
    assert out.columns == odd.columns and out.count() == len(odd_rows()) - 1
    assert D.leaks(empty, items).count() == 0 and D.leaks(odd, items.where("item_id = 0")).count() == 0


def test_native_plans(spark):
    docs, items = (spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    for df in (D.leaks(docs, items), D.window_matches(docs, D.item_windows(items)), L.scan(L.document_files(docs)), L.sentences(L.notices(L.document_files(docs), "path"), "path")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not [x for x in PYTHON if x in plan]


def plain_terms(text):
    words = [x for x in re.split(r"[^\w]+|_", text.lower()) if x]
    return words + ["spdx:" + x for x in re.findall(L._SPDX, text.lower())]


def plain_licences(sentences):
    """sentence -> (licence, cosine) by the definition."""
    marked, known = set(sentences), L.template_rows()
    every = marked | {t for _, _, t, _, _ in known}
    split = {s: Counter(plain_terms(s)) for s in every}
    having = Counter(x for c in split.values() for x in c)
    weight = {s: {x: (1 + math.log(n)) * (math.log((1 + len(every)) / (1 + having[x])) + 1) for x, n in c.items()} for s, c in split.items()}
    norm = {s: math.sqrt(sum(v * v for v in w.values())) for s, w in weight.items()}
    out = {}
    for s in marked:
        near = []
        for _, name, t, tell, bars in known:
            if all(set(x.split("|")) & set(split[s]) for x in tell) and not set(bars) & set(split[s]):
                near.append((-round(sum(v * weight[t].get(x, 0) for x, v in weight[s].items()) / norm[s] / norm[t], 9), name))
        if near and -min(near)[0] >= L.MIN_COSINE:
            out[s] = (min(near)[1], -min(near)[0])
    return out


def plain_scan(files):
    """(path, own licence, licence, inherited from) of each row, straight from the definition (whole texts aside)."""
    def pieces(text):
        cut = lambda t: [x.strip(" ") for x in re.split(r"[\n\r\u2028]+", re.sub(r"([.!?])\s+", r"\1\n", t))]
        return [[x for x in cut(t) if re.search(L.MARKS, x)] for t in (text, re.sub(r"\s*[\n\r\u2028]+[\s#/*;!<>-]*", " ", text))]

    cut = {(p, t): pieces(t) if re.search(L.MARKS, t) else [[], []] for p, t in ((p, t or "") for p, t in files if p is not None)}
    near = plain_licences({x for both in cut.values() for kind in both for x in kind})
    own, governs = {}, {}
    size = lambda x: len([w for w in re.split(r"[^\w]+|_", x) if w])
    for (p, t), both in cut.items():
        hits = [(-near[x][1], k, i, near[x][0]) for k, kind in enumerate(both) for i, x in enumerate(kind) if x in near]
        if hits:
            own[p] = (min(hits)[3], -min(hits)[0])
            share = max(sum(size(x) for x in kind if x in near) for kind in both) / size(t)
            if share >= L.FILE_SHARE or re.search(L.FILE_NAMES.replace("(?i)", ""), p.split("/")[-1], re.I):
                governs.setdefault("/".join(p.split("/")[:-1]), []).append((-own[p][1], p, own[p][0]))
    out = []
    for p, _ in files:
        if p is None or p in own:
            out.append((p, *((own[p][0],) * 2 if p in own else (None, None)), None))
            continue
        parts = p.split("/")[:-1]
        up = next((d for d in ("/".join(parts[:k]) for k in range(len(parts), -1, -1)) if d in governs), None)
        out.append((p, None, min(governs[up])[2] if up is not None else None, up))
    return sorted(out, key=str)


def test_licences_of_a_table_by_the_definition(spark):
    files = L.document_files(spark.read.parquet(f"{SF_CHECK}/documents.parquet"))
    got = sorted((tuple(r) for r in L.scan(files).select("path", "own_licence", "licence", "inherited_from").collect()), key=str)
    assert got == plain_scan([(r.path, r.text) for r in files.collect()])


def test_kinds_of_licences_are_told_apart(spark):
    """Headers that share most of their words with another licence's."""
    gnu = "{0} is free software; you can redistribute it and/or modify\n{2} it under the terms of the GNU {1}General Public License as published by\n{2} the Free Software Foundation; "
    gnu += "either version {3} of the License, or\n{2} (at your option) any later version.\n"
    want = {
        "gpl2": ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"), "gpl2+": ("GPL-2.0", "# " + gnu.format("This program", "", "#", 2)),
        "gpl3+": ("GPL-3.0", " * " + gnu.format("This program", "", " *", 3)), "agpl": ("AGPL-3.0", "// " + gnu.format("This program", "Affero ", "//", 3)),
        "lgpl": ("LGPL-2.1", gnu.format("This library", "Lesser ", "", "2.1")), "lgpl3": ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
        "spdx2": ("GPL-2.0", "/* SPDX-License-Identifier: GPL-2.0-only */"), "spdxbsd": ("BSD-2-Clause", "# SPDX-License-Identifier: BSD-2-Clause"),
        "sa": ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"), "sa2": ("CC-BY-SA-4.0", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License"),
        "by": ("CC-BY-4.0", "Licensed under CC BY 4.0"), "nc": ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), "isc": ("ISC", "Released under the ISC License."),
        "bsd2": ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"), "bsd3": ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
        "none1": (None, "SPDX-License-Identifier: EUPL-1.2"), "none2": (None, "Licensed under the Apache License, Version 1.1"), "none3": (None, "Licensed under CC BY 2.0"),
        "none4": (None, "under the terms of the GNU General Public License"), "mit": ("MIT", "Released under the MIT License"), "mpl": ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    }
    files = spark.createDataFrame([(f"{k}/x", t) for k, (_, t) in want.items()], "path string, text string")
    assert {r.path[:-2]: r.own_licence for r in L.scan(files).collect()} == {k: v for k, (v, _) in want.items()}


def test_licence_cosines(spark):
    rnd = random.Random(1)
    said = ["Released under the MIT License.", "released under MIT licence", "This work is licensed under the GNU General Public License, version 3.",
            "All rights reserved, copyright someone", "Licensed under CC BY-NC 4.0.", "Licence: Apache License 2.0", prose(rnd, 20) + " license"]
    different = spark.createDataFrame([(s,) for s in said], "sentence string")
    got = {r.sentence: (r.licence, r.cosine) for r in L.matched_sentences(different, L.templates(spark)).collect()}
    want = plain_licences(said)
    assert {s: v[0] for s, v in got.items() if s in said} == {s: v[0] for s, v in want.items()}
    assert all(got[s][1] == pytest.approx(want[s][1], abs=1e-6) for s in want)


def test_inheritance_along_directories(spark):
    long = prose(random.Random(1), 100)
    files = [
        ("a/LICENSE", "Released under the MIT License."), ("a/x.py", "code"), ("a/b/y.py", "code"), ("a/b/c/LICENSE", "Licensed under the Apache License, Version 2.0."),
        ("a/b/c/z.py", None), ("a/b/c/d/e/w.py", ""), ("a/b/own.py", long + "\nLicensed under CC BY-NC 4.0.\n" + long), ("a/b/near.py", "code"), ("q/r.py", "code"),
        ("q/s/LICENSE", "This work is licensed under the GNU General Public License, version 3"), (None, "Released under the MIT License."), ("ab/u.py", "x"), ("a/x.py", "code"),
        ("t/L1", "Released under the MIT License"), ("t/L2", "Licensed under the Apache License, Version 2.0"), ("t/v.py", "x"), ("LONE", "x"),
    ]
    df = spark.createDataFrame([(p, t, "x") for p, t in files], "path string, text string, licence string")
    out = L.scan(df).collect()
    got = {r.path: (r.licence, r.inherited_from, r.levels_up) for r in out}
    assert len(out) == len(files)
    assert got["a/x.py"] == ("MIT", "a", 0) and got["a/b/y.py"] == ("MIT", "a", 1) and got["a/b/near.py"] == ("MIT", "a", 1)
    assert got["a/b/c/z.py"] == ("Apache-2.0", "a/b/c", 0) and got["a/b/c/d/e/w.py"] == ("Apache-2.0", "a/b/c", 2)
    assert got["a/b/own.py"] == ("CC-BY-NC-4.0", None, None) and got["q/r.py"] == got["ab/u.py"] == got["LONE"] == got[None] == (None, None, None)
    assert got["t/v.py"][0] in ("MIT", "Apache-2.0") and got["t/v.py"][1:] == ("t", 0)
    assert L.scan(df.where("path = 'none'")).count() == 0


def test_licences_of_a_table(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    found = {r.doc_id for r in L.op8_license_scan(spark, SF_CHECK).where("own_licence is not null").collect()}
    pattern = "Licensed under|This work is licensed|Released under the MIT"
    assert found == {r.doc_id for r in docs.where(docs.text.rlike(pattern)).collect()} and found


def test_stages_on_odd_rows(odd, empty, spark):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, SF_SMALL).columns == odd.columns, name
        assert stage(spark, empty, SF_SMALL).count() == 0, name


def test_pipeline_keeps_clean_documents(spark):
    assert corpus_pipeline.ORACLE_SQL is None
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    # plain stages: languages that are recognised, one document of each component, words of repeats gone, no leaks
    rows = [(i, t) for i, t in rows if t and any(map(str.isalpha, t))]
    kept = {i for i, (_, c) in brute.components(rows, round(100 * corpus_pipeline.NEAR)).items() if i == c}
    rows = [(i, t) for i, t in rows if i in kept]
    lost = {i: n for i, _, n, _ in brute.without_repeats(rows)}
    counts = Counter(tuple(w[k : k + 35]) for _, w in ((i, brute.WORD.findall(t)) for i, t in rows) for k in range(len(w) - 34))
    texts = []
    for i, t in rows:
        w = brute.WORD.findall(t)
        keep = [True] * len(w)
        for k in range(len(w) - 34):
            if counts[tuple(w[k : k + 35])] > 1:
                keep[k : k + 35] = [False] * 35
        texts.append((i, t if not lost[i] else " ".join(x for x, y in zip(w, keep) if y)))
    leaked = {d for d, _, _ in plain_leaks(texts, items)}
    texts = [(i, t) for i, t in texts if i not in leaked]
    check_pieces(corpus_pipeline.run(spark, SF_SMALL).collect(), texts)


def test_one_document_of_each_group_stays(spark, odd):
    """As many rows as components, each with the smallest id of its own; equal rows are one."""
    texts = dict(enumerate(sorted({(i, t) for i, t in odd_rows() if i is not None}, key=lambda r: (r[0], r[1] or ""))))
    found = brute.components([(k, t) for k, (_, t) in texts.items()], round(100 * corpus_pipeline.NEAR))
    out = corpus_pipeline.drop_near_duplicates(spark, odd, SF_SMALL)
    got = [r.doc_id for r in out.collect()]
    want = [texts[c][0] for c in {c for _, c in found.values()}]
    assert sorted(i for i in got if i is not None) == sorted(want) and got.count(None) == 2
