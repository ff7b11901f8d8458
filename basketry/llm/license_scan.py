"""Operator 8 [native]: licence scan by sparse TF-IDF cosine, then inheritance along directories.

1. A text is cut into sentences twice: by lines and full stops, and by full stops alone after its lines are joined without
   the marks that begin a comment, for a notice that is wrapped. Sentences that name a licence, a copyright or a known
   licence's own word are candidates; so every template's sentences are. Terms are lowered runs of letters and digits, and
   an SPDX identifier as a whole. A term's weight is (1 + ln count) * ln((1 + n) / (1 + n having it)) + 1, with n counted
   over all different candidate sentences of the input and the templates.
2. Candidates and templates are joined on terms (sparse vectors as rows), which gives the cosine of each
   different sentence to each template. A template counts only for a sentence that has its telling terms (the version, the
   SPDX identifier) and none of those that tell another licence ("lesser", "affero", "sharealike", another identifier). The
   best such template with a cosine of at least ``MIN_COSINE`` is the sentence's licence (ties: the licence that sorts
   first); a file's own licence is that of its best sentence (ties: the earliest), or that of the whole text of ``WHOLE`` it
   shares ``WHOLE_SHARE`` of its and of that text's words with, which is then also its cosine.
3. A licence file is one with a licence of its own that is named like one (``FILE_NAMES``), or of whose words
   ``FILE_SHARE`` stand in matched sentences, or a whole licence text, however long it is: it governs the directory it is
   in and all below. A file without a licence of its own inherits from the nearest ancestor directory that has a
   licence file: its ancestors are joined to the governed directories. Of several in one directory the surest
   counts (ties: the path that sorts first).

Texts are read once: those that hold a licence word are stored, all later steps work on them and on paths. Equal sentences
are matched once, so a licence line in a third of all files is one row of the join. Governed
directories are sent to all tasks only if Spark finds them small; a big directory's files are joined by its path.

Cases: null or empty texts have no licence of their own but inherit; a very long text is split like any other; rows without
a path neither inherit nor govern; rows that share a path are one file with several texts, and are repeated in the result; a
licence that no template tells (an unknown version or identifier) is none; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm.scratch import read_table, stored

MIN_COSINE = 0.55
FILE_SHARE = 0.5
WHOLE_SHARE = 0.8
#: LICENSE, COPYING.LESSER, LICENCE-MIT.txt, NOTICE, but not license.py.
FILE_NAMES = r"(?i)^(?:un)?(?:licen[cs]es?|copying|notice)(?:[-_.](?!(?:.*\.)?(?:py|js|ts|c|h|cc|cpp|hpp|cs|java|go|rs|rb|sh|php|json|ya?ml|xml|toml)$).*)?$"

#: The usual short notices of public licences, each with terms that tell it from others ("a|b": one of them).
TEMPLATES = [
    ("MIT", "Released under the MIT License", "mit"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "granted charge person"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "granted fee purpose"),
    ("ISC", "Released under the ISC License", "isc"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0", "apache 2"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2", "general|gpl public|gpl 2|v2"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
     "Free Software Foundation; either version 2 of the License, or (at your option) any later version", "general public 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3", "general|gpl public|gpl 3|v3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3", "general public 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
     "Free Software Foundation, either version 3 of the License, or (at your option) any later version", "general public 3"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
     "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version", "lesser 2 1"),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1", "lesser|lgpl 2 1"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3", "lesser|lgpl 3|v3"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
     "the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "affero 3"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3", "affero|agpl 3|v3"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License", "bsd 2 clause"),
    ("BSD-2-Clause", "Licensed under the Simplified BSD License", "bsd simplified"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License", "bsd 3 clause"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD License", "bsd"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mozilla|mpl 2"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "eclipse|epl 2"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0", "by|attribution 4"),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License", "attribution 4"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0", "by|attribution sa|sharealike|alike 4"),
    ("CC-BY-SA-4.0", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License", "attribution sharealike|alike 4"),
    ("CC-BY-SA-3.0", "This work is licensed under the Creative Commons Attribution-ShareAlike 3.0 Unported License, CC BY-SA 3.0", "by|attribution sa|sharealike|alike 3"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0", "by|attribution nc|noncommercial|commercial 4"),
    ("CC-BY-NC-4.0", "This work is licensed under the Creative Commons Attribution NonCommercial 4.0 International License", "attribution noncommercial|commercial 4"),
    ("CC-BY-NC-SA-4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License, CC BY-NC-SA 4.0",
     "by|attribution nc|noncommercial|commercial sa|sharealike|alike 4"),
    ("CC-BY-ND-4.0", "This work is licensed under the Creative Commons Attribution-NoDerivatives 4.0 International License, CC BY-ND 4.0",
     "by|attribution nd|noderivatives|noderivs 4"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal", "cc0 1"),
    ("Unlicense", "This is free and unencumbered software released into the public domain", "unencumbered"),
]
#: SPDX identifiers and the licence they name.
SPDX = {
    "mit": "MIT", "isc": "ISC", "apache-2.0": "Apache-2.0", "gpl-2.0": "GPL-2.0", "gpl-2.0+": "GPL-2.0", "gpl-2.0-only": "GPL-2.0", "gpl-2.0-or-later": "GPL-2.0",
    "gpl-3.0": "GPL-3.0", "gpl-3.0+": "GPL-3.0", "gpl-3.0-only": "GPL-3.0", "gpl-3.0-or-later": "GPL-3.0", "lgpl-2.1": "LGPL-2.1", "lgpl-2.1+": "LGPL-2.1",
    "lgpl-2.1-only": "LGPL-2.1", "lgpl-2.1-or-later": "LGPL-2.1", "lgpl-3.0": "LGPL-3.0", "lgpl-3.0-only": "LGPL-3.0", "lgpl-3.0-or-later": "LGPL-3.0",
    "agpl-3.0": "AGPL-3.0", "agpl-3.0-only": "AGPL-3.0", "agpl-3.0-or-later": "AGPL-3.0", "bsd-2-clause": "BSD-2-Clause", "bsd-3-clause": "BSD-3-Clause",
    "mpl-2.0": "MPL-2.0", "epl-2.0": "EPL-2.0", "cc-by-4.0": "CC-BY-4.0", "cc-by-sa-4.0": "CC-BY-SA-4.0", "cc-by-sa-3.0": "CC-BY-SA-3.0", "cc-by-nc-4.0": "CC-BY-NC-4.0",
    "cc-by-nc-sa-4.0": "CC-BY-NC-SA-4.0", "cc-by-nd-4.0": "CC-BY-ND-4.0", "cc0-1.0": "CC0-1.0", "unlicense": "Unlicense",
}
#: Terms that a licence of another family or kind has, so a template without them does not tell it.
OTHERS = ["spdx", "lesser", "lgpl", "library", "affero", "agpl", "gpl", "general", "apache", "mozilla", "mpl", "eclipse", "epl", "bsd", "isc", "mit", "cc0",
          "nc", "noncommercial", "commercial", "sa", "sharealike", "alike", "nd", "noderivatives", "noderivs"]

#: Whole licence texts.
_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED '
    "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
WHOLE = [
    ("MIT", "MIT License Copyright (c) Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, '
     "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
     "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial "
     'portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
     "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE "
     "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
     "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "ISC License Copyright (c) Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     'granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR '
     "DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR "
     "BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER "
     "IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", "BSD 2-Clause License Copyright (c) All rights reserved. Redistribution and use in source and binary forms, with or without "
     "modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
     "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this "
     "list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. " + _AS_IS),
    ("BSD-3-Clause", "BSD 3-Clause License Copyright (c) All rights reserved. Redistribution and use in source and binary forms, with or without "
     "modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
     "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this "
     "list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the "
     "name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without "
     "specific prior written permission. " + _AS_IS),
]

#: Words of a file from which it is too long to share ``WHOLE_SHARE`` with a whole licence text.
LONGEST_WHOLE = int(max(len(re.findall(r"[^\W_]+", t)) for _, t in WHOLE) / WHOLE_SHARE)

#: What any candidate sentence holds.
MARKS = r"(?i)licen[cs]e|copyright|\bspdx\b|public domain|creative commons|hereby granted|redistribut|\bcc0\b|\bcc by\b"

_FULL_STOP = r"([.!?])\s+"
_LINE_END = r"[\n\r\x{2028}]+"
_COMMENT = r"\s*[\n\r\x{2028}]+[\s#/*;!<>-]*"
_SPDX = r"spdx-license-identifier:\s*\(?\s*([a-z0-9.+-]*[a-z0-9+])"


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def terms(text: Column) -> Column:
    """Words, and SPDX identifiers as one term each."""
    named = F.transform(F.regexp_extract_all(F.lower(text), F.lit(_SPDX), 1), lambda t: F.concat(F.lit("spdx:"), t))
    return F.concat(words(text), named)


def notices(files: DataFrame, key: str) -> DataFrame:
    """``key, n_words, short, found`` of the files whose text holds a licence word: its number of words, the text itself if it
    is short enough to be a whole licence text, and its candidate sentences (``joined, at, sentence``), by lines first, then
    of its joined lines. The one pass over whole texts."""
    rows = files.select(key, F.col("text").cast("string").alias("text")).where(F.col("text").rlike(MARKS))
    cut = lambda text: F.split(F.regexp_replace(text, F.lit(_FULL_STOP), F.lit("$1\n")), _LINE_END)
    by_line = F.transform(cut(F.col("text")), lambda s, i: F.struct(F.lit(False).alias("joined"), i.alias("at"), F.trim(s).alias("sentence")))
    joined = cut(F.regexp_replace("text", F.lit(_COMMENT), F.lit(" ")))
    joined = F.transform(joined, lambda s, i: F.struct(F.lit(True).alias("joined"), (i + 1_000_000_000).alias("at"), F.trim(s).alias("sentence")))
    found = F.filter(F.concat(by_line, joined), lambda x: x["sentence"].rlike(MARKS))
    n = F.size(words(F.col("text")))
    return rows.select(key, n.alias("n_words"), F.when(n.between(1, LONGEST_WHOLE), F.col("text")).alias("short"), found.alias("found"))


def sentences(noticed: DataFrame, key: str) -> DataFrame:
    """``key, n_words, joined, at, sentence`` of ``notices``."""
    return noticed.select(key, "n_words", F.inline("found"))


def template_rows() -> list[tuple[int, str, str, list[str], list[str]]]:
    """Number, licence, sentence, telling terms and barred terms of every template. A template bars the terms of ``OTHERS``
    that neither its sentence nor its telling terms hold; where another licence's template has only more of them, it is
    told by those."""
    rows = [(licence, text, tell.split()) for licence, text, tell in TEMPLATES]
    rows += [(licence, f"SPDX-License-Identifier: {name}", [f"spdx:{name}"]) for name, licence in SPDX.items()]
    out = []
    for i, (licence, text, tell) in enumerate(rows):
        own = set(re.findall(r"[a-z0-9]+", text.lower())) | {x for t in tell for x in t.split("|")}
        bars = [] if tell[0].startswith("spdx:") else [x for x in OTHERS if x not in own]
        out.append((i, licence, text, tell, bars))
    return out


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(template_rows(), "template int, licence string, sentence string, tell array<string>, bars array<string>")


def told(held: Column, tell: Column, bars: Column) -> Column:
    """Whether a sentence's terms have all telling terms and none of the barred ones."""
    return F.forall(tell, lambda t: F.arrays_overlap(F.split(t, r"\|"), held)) & (F.size(F.array_intersect(bars, held)) == 0)


def matched_sentences(different: DataFrame, known: DataFrame) -> DataFrame:
    """``sentence, licence, cosine`` of the different sentences that are near a template that tells them."""
    both = different.select("sentence").unionByName(known.select("sentence")).distinct()
    counted = both.select("sentence", F.explode(terms(F.col("sentence"))).alias("term")).groupBy("sentence", "term").agg(F.count(F.lit(1)).alias("n"))
    counted = stored(counted, "sentence-terms")
    total = both.agg(F.count(F.lit(1)).alias("total"))
    having = counted.groupBy("term").agg(F.count(F.lit(1)).alias("having")).withColumn("total", F.lit(total.first()["total"]))
    weight = (1 + F.log("n")) * (F.log((1 + F.col("total")) / (1 + F.col("having"))) + 1)
    vectors = stored(counted.join(having, "term").select("sentence", "term", weight.alias("w")), "sentence-vectors")
    norms = vectors.groupBy("sentence").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    right = known.join(vectors, "sentence").join(norms, "sentence").select("template", "licence", "term", (F.col("w") / F.col("norm")).alias("v"))
    dots = vectors.join(right, "term").groupBy("sentence", "template", "licence").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    dots = dots.join(norms.hint("merge"), "sentence").withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 9)).where(F.col("cosine") >= MIN_COSINE)
    rules = known.select("template", "tell", "bars")
    dots = dots.join(rules, "template").where(told(terms(F.col("sentence")), F.col("tell"), F.col("bars")))
    best = dots.groupBy("sentence").agg(F.min(F.struct((-F.col("cosine")).alias("d"), F.col("licence"))).alias("b"))
    return best.select("sentence", F.col("b.licence").alias("licence"), (-F.col("b.d")).alias("cosine"))


def own_licences(noticed: DataFrame, key: str) -> DataFrame:
    """``key, own_licence, own_cosine, share`` of the files that have a licence sentence; ``share`` of a file's words stand in
    such sentences, taken by lines or by joined lines, whichever are more."""
    found = sentences(noticed, key)
    near = matched_sentences(found.select("sentence").distinct(), templates(noticed.sparkSession))
    size = F.size(words(F.col("sentence")))
    matched = F.greatest(F.sum(F.when(F.col("joined"), size).otherwise(0)), F.sum(F.when(F.col("joined"), 0).otherwise(size)))
    best = found.join(near.hint("merge"), "sentence").groupBy(key).agg(
        F.min(F.struct((-F.col("cosine")).alias("d"), "at", "licence")).alias("b"), (matched / F.max("n_words")).alias("share"))
    return best.select(key, F.col("b.licence").alias("own_licence"), (-F.col("b.d")).alias("own_cosine"), "share")


def whole_texts(noticed: DataFrame, key: str) -> DataFrame:
    """``key, whole_licence, whole_share`` of the files that are a whole licence text: of the longer one's words, file or
    licence, the other has that share."""
    spark = noticed.sparkSession
    known = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(WHOLE)], "whole int, text string").select("whole", F.explode(words(F.col("text"))).alias("term"))
    known = known.groupBy("whole", "term").agg(F.count(F.lit(1)).alias("m"))
    sizes = F.array(*(F.lit(len(re.findall(r"[^\W_]+", t))) for _, t in WHOLE))
    rows = noticed.where("short is not null").select(key, "short", "n_words").distinct().select(key, "short", "n_words", F.explode(words(F.col("short"))).alias("term"))
    rows = rows.groupBy(key, "short", "n_words", "term").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(known), "term")
    longer = F.greatest(F.col("n_words"), F.element_at(sizes, F.col("whole") + 1))
    share = rows.groupBy(key, "short", "n_words", "whole").agg(F.sum(F.least("n", "m")).alias("both")).withColumn("share", F.col("both") / longer)
    licence = F.element_at(F.array(*(F.lit(x) for x, _ in WHOLE)), F.col("whole") + 1)
    best = share.where(F.col("share") >= WHOLE_SHARE).groupBy(key).agg(F.min(F.struct((-F.col("share")).alias("d"), licence.alias("licence"))).alias("b"))
    return best.select(key, F.col("b.licence").alias("whole_licence"), (-F.col("b.d")).alias("whole_share"))


def ancestors(path: Column) -> Column:
    """The directories a path lies in, from the top."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def scan(files: DataFrame) -> DataFrame:
    """``path, own_licence, own_cosine, licence, inherited_from, levels_up`` for every row of ``files`` (``path, text``);
    ``inherited_from`` is the governing directory and ``levels_up`` how far above the file's directory it is."""
    files = files.select(F.col("path").cast("string"), F.col("text").cast("string"))
    noticed = stored(notices(files.where("path is not null"), "path"), "licence-notices")
    own = own_licences(noticed, "path").join(whole_texts(noticed, "path").hint("merge"), "path", "full")
    own = stored(own.select(
        "path", F.coalesce("whole_licence", "own_licence").alias("own_licence"), F.coalesce("whole_share", "own_cosine").alias("own_cosine"),
        (F.col("whole_licence").isNotNull() | (F.col("share") >= FILE_SHARE)).alias("governs"),
    ), "own-licences")
    # one row a file on both sides: their names compress well, so Spark would take them for small and send them to all tasks
    rows = files.select("path").join(own.drop("governs").hint("merge"), "path", "left")
    directory = F.array_join(F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1), "/")
    named = F.element_at(F.split("path", "/"), -1).rlike(FILE_NAMES)
    governing = own.where(F.coalesce("governs", F.lit(False)) | named).withColumn("dir", directory)
    governing = governing.groupBy("dir").agg(F.min(F.struct((-F.col("own_cosine")).alias("d"), "path", "own_licence")).alias("b"))
    governing = stored(governing.select("dir", F.col("b.own_licence").alias("governed_by")), "governed")
    lost = rows.where(F.col("path").isNotNull() & F.col("own_licence").isNull()).select("path").distinct()
    above = lost.select("path", F.posexplode(ancestors(F.col("path"))).alias("depth", "dir")).join(governing, "dir")
    near = above.groupBy("path").agg(F.max(F.struct("depth", "dir", "governed_by")).alias("b"))
    near = near.select("path", F.col("b.governed_by").alias("governed_by"), F.col("b.dir").alias("inherited_from"), F.col("b.depth").alias("depth"))
    out = rows.join(near.hint("merge"), "path", "left").withColumn("licence", F.coalesce("own_licence", "governed_by"))
    levels = (F.size(F.split("path", "/")) - 1 - F.col("depth")).alias("levels_up")
    return out.select("path", "own_licence", "own_cosine", "licence", "inherited_from", levels)


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as files: ``<source>/<hundred of the id>/<id>``."""
    doc = F.col("doc_id").cast("long")
    path = F.concat_ws("/", F.coalesce(F.col("source").cast("string"), F.lit("unknown")), F.floor(doc / 100).cast("string"), doc.cast("string"))
    return docs.select(doc.alias("doc_id"), F.when(doc.isNotNull(), path).alias("path"), F.col("text"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = document_files(read_table(spark, sf_dir, "documents"))
    found = scan(files)
    return found.withColumn("doc_id", F.element_at(F.split("path", "/"), -1).cast("long"))


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _rows(rows: list[tuple]) -> str:
    """Rows of a VALUES clause; lists become lists of strings."""
    def cell(x) -> str:
        return "[" + ", ".join(map(_literal, x)) + "]::VARCHAR[]" if isinstance(x, list) else str(x) if isinstance(x, int) else _literal(x)

    return ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)


def _sql() -> str:
    """The query in SQL. Documents' files are named by their ids, so no file governs by its name."""
    def split(text: str) -> str:
        return f"list_filter(string_split_regex(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"

    def cut(text: str) -> str:
        return f"string_split_regex(regexp_replace({text}, {_literal(_FULL_STOP)}, '\\1' || chr(10), 'g'), {_literal(_LINE_END)})"

    joined = f"regexp_replace(text, {_literal(_COMMENT)}, ' ', 'g')"
    spdx = f"list_transform(regexp_extract_all(lower(sentence), {_literal(_SPDX)}, 1), lambda x: 'spdx:' || x)"
    whole = [(i, licence, text) for i, (licence, text) in enumerate(WHOLE)]
    return f"""
WITH files AS (
  SELECT doc_id, text, CASE WHEN doc_id IS NOT NULL THEN concat_ws('/', coalesce(source, 'unknown'), CAST(floor(doc_id / 100) AS BIGINT), doc_id) END AS path FROM documents
), noticed AS (
  SELECT row_number() OVER () AS file, path, text, len({split('text')}) AS n_words FROM files WHERE path IS NOT NULL AND regexp_matches(text, {_literal(MARKS)})
), pieces AS (
  SELECT file, path, n_words, 0 AS joined, trim(unnest(l)) AS sentence, generate_subscripts(l, 1) AS pos FROM (SELECT *, {cut('text')} AS l FROM noticed)
  UNION ALL
  SELECT file, path, n_words, 1, trim(unnest(l)), generate_subscripts(l, 1) + 1000000000 FROM (SELECT *, {cut(joined)} AS l FROM noticed)
), found AS (
  SELECT * FROM pieces WHERE regexp_matches(sentence, {_literal(MARKS)})
), known(template, licence, sentence, tell, bars) AS (VALUES {_rows(template_rows())}
), every AS (
  SELECT sentence, list_concat({split('sentence')}, {spdx}) AS held FROM (SELECT sentence FROM found UNION SELECT sentence FROM known)
), counted AS (
  SELECT sentence, term, count(*) AS n FROM (SELECT sentence, unnest(held) AS term FROM every) GROUP BY ALL
), vectors AS (
  SELECT sentence, term, (1 + ln(n)) * (ln((1 + (SELECT count(*) FROM every)) / (1 + having_it)) + 1) AS w
  FROM counted JOIN (SELECT term, count(*) AS having_it FROM counted GROUP BY term) USING (term)
), norms AS (
  SELECT sentence, sqrt(sum(w * w)) AS norm FROM vectors GROUP BY sentence
), sides AS (
  SELECT template, licence, term, w / norm AS v FROM known JOIN vectors USING (sentence) JOIN norms USING (sentence)
), dots AS (
  SELECT sentence, template, licence, sum(w * v) AS dot FROM vectors JOIN sides USING (term) GROUP BY ALL
), cosines AS (
  SELECT dots.sentence, dots.licence, round(dot / norm, 9) AS cosine, held, tell, bars
  FROM dots JOIN norms USING (sentence) JOIN every USING (sentence) JOIN known ON known.template = dots.template
), near AS (
  SELECT sentence, min({{'d': -cosine, 'licence': licence}}) AS b FROM cosines
  WHERE cosine >= {MIN_COSINE} AND list_bool_and(list_transform(tell, lambda t: list_has_any(string_split(t, '|'), held))) AND len(list_intersect(bars, held)) = 0
  GROUP BY sentence
), by_sentence AS (
  SELECT path, min({{'d': b.d, 'at': pos, 'licence': b.licence}}) AS best,
    greatest(sum(CASE WHEN joined = 1 THEN len({split('sentence')}) ELSE 0 END), sum(CASE WHEN joined = 0 THEN len({split('sentence')}) ELSE 0 END)) / max(n_words) AS share
  FROM found JOIN near USING (sentence) GROUP BY path
), wholes(whole, licence, text) AS (VALUES {_rows(whole)}
), whole_terms AS (
  SELECT whole, licence, size, term, count(*) AS m FROM (SELECT whole, licence, len(t) AS size, unnest(t) AS term FROM (SELECT whole, licence, {split('text')} AS t FROM wholes)) GROUP BY ALL
), short_terms AS (
  SELECT path, text, n_words, term, count(*) AS n FROM (
    SELECT path, text, n_words, unnest({split('text')}) AS term FROM (SELECT DISTINCT path, text, n_words FROM noticed WHERE n_words BETWEEN 1 AND {LONGEST_WHOLE}))
  GROUP BY ALL
), shares AS (
  SELECT path, licence, sum(least(n, m)) / greatest(n_words, size) AS share FROM short_terms JOIN whole_terms USING (term) GROUP BY path, text, n_words, whole, licence, size
), by_whole AS (
  SELECT path, min({{'d': -share, 'licence': licence}}) AS best FROM shares WHERE share >= {WHOLE_SHARE} GROUP BY path
), own AS (
  SELECT path, coalesce(w.best.licence, s.best.licence) AS own_licence, coalesce(-w.best.d, -s.best.d) AS own_cosine, w.best IS NOT NULL OR coalesce(s.share >= {FILE_SHARE}, false) AS governs
  FROM by_sentence s FULL JOIN by_whole w USING (path)
), governing AS (
  SELECT dir, min({{'d': -own_cosine, 'path': path, 'licence': own_licence}}).licence AS governed_by
  FROM (SELECT *, array_to_string(string_split(path, '/')[:-2], '/') AS dir FROM own WHERE governs) GROUP BY dir
), above AS (
  SELECT path, depth, array_to_string(string_split(path, '/')[1:depth], '/') AS dir
  FROM (SELECT path, unnest(range(0, len(string_split(path, '/')))) AS depth FROM (SELECT DISTINCT path FROM files WHERE path IS NOT NULL AND path NOT IN (SELECT path FROM own)))
), heirs AS (
  SELECT path, max({{'depth': depth, 'dir': dir, 'governed_by': governed_by}}) AS b FROM above JOIN governing USING (dir) GROUP BY path
)
SELECT f.path, own_licence, own_cosine, coalesce(own_licence, b.governed_by) AS licence, b.dir AS inherited_from,
  CAST(len(string_split(f.path, '/')) - 1 - b.depth AS INTEGER) AS levels_up, CAST(string_split(f.path, '/')[-1] AS BIGINT) AS doc_id
FROM files f LEFT JOIN own USING (path) LEFT JOIN heirs USING (path)
"""


OP8_SQL = _sql()
