"""Operators 3, 4 and 10: held-out accuracy, and the parts they are made of against plain versions."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.llm import language, quality, toxicity
from basketry.llm.hashing import span_hashes
from basketry.llm.labelled import bounded_sample, held_out
from basketry.llm.lexicon_trie import NONE, Lexicon, allowed
from tests.conftest import SF_CHECK
from tests.llm.conftest import odd_rows, prose


def table(spark, name):
    return spark.read.parquet(f"{SF_CHECK}/{name}.parquet")


def flat(text: str):
    b = np.frombuffer(text.encode(), np.uint8)
    return b, np.array([0, len(b)])


def test_folds_and_sample(spark):
    import zlib

    rows = spark.range(3000).select(F.col("id").alias("doc_id"))
    got = {r.doc_id for r in rows.where(held_out(F.col("doc_id"))).collect()}
    assert got == {i for i in range(3000) if zlib.crc32(str(i).encode()) % 5 == 0}
    n = bounded_sample(rows, 500).count()
    assert 400 < n < 600 and bounded_sample(rows.repartition(7), 500).count() == n
    assert bounded_sample(rows, 3000).count() == 3000


def test_language_of_a_table(spark):
    docs = table(spark, "documents")
    got = docs.select("doc_id", "lang").join(language.identify(docs), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.95
    assert got.score.between(0, 1).all()
    # neither the language nor the source is an input: without them the held-out rows get the same answer
    model = language.learn(docs)
    blind = docs.withColumns({"lang": F.lit("xx"), "source": F.lit(None)})
    named = language.with_language(blind.select("doc_id", "text"), model, ["doc_id"]).toPandas().set_index("doc_id")
    assert (named.loc[got.doc_id, "lang_pred"].values == got.lang_pred.values).all()


def test_language_of_odd_rows(odd, empty, spark):
    got = language.identify(odd).collect()
    assert len(got) == len(odd_rows())
    for r in got:
        assert 0 <= r.score <= 1 and r.lang_pred in ("en", "und")
    by = {r.doc_id: r.lang_pred for r in got}
    assert by[1] == by[2] == by[3] == "und" and by[4] == "en" and by[55] == "en"  # é is a letter
    letters = spark.createDataFrame([(1, "12 34 !?", "en"), (2, "x", "en"), (3, "漢字", "en"), (4, "٣٤", "en")], "doc_id long, text string, lang string")
    assert {r.doc_id: r.lang_pred for r in language.identify(letters.repartition(1)).collect()} == {1: "und", 2: "en", 3: "en", 4: "und"}
    assert language.identify(empty).count() == 0
    nothing = language.identify(odd.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred", "score").distinct().collect()
    assert [tuple(r) for r in nothing] == [("und", 0.0)]
    kept = language.accepted(odd, language.learn(odd))
    assert kept.columns == odd.columns and {1, 2, 3}.isdisjoint({r.doc_id for r in kept.collect()})


def test_kernel_is_the_share_of_common_ngrams():
    def grams(t):
        b = t.lower().encode()
        return {b[k : k + n] for n in range(1, 5) for k in range(len(b) - n + 1)}

    texts = ["the cat sat", "The hat", "ñandú y más", "q"]
    seen = np.concatenate([language.presence(*flat(t)) for t in texts])
    for i, t in enumerate(texts):
        for j, u in enumerate(texts):
            a, b = grams(t), grams(u)
            want = len(a & b) / np.sqrt(len(a) * len(b))
            got = (seen[i] & seen[j]).sum() / np.sqrt(seen[i].sum() * seen[j].sum())
            assert got == pytest.approx(want, abs=0.02)  # 32768 slots: few n-grams share one


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@pytest.mark.parametrize("letters", ["abc", "abcdeiotz1", "дурак漢字éa"])
def test_two_tries_find_the_nearest_term(letters):
    rnd = random.Random(5)
    terms = sorted({"".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 15))) for _ in range(40)})
    words = ["", *terms, "".join(rnd.choice(letters) for _ in range(300))]
    for _ in range(600):
        w = list(rnd.choice(terms))
        for _ in range(rnd.randrange(4)):
            k, kind = rnd.randrange(len(w) + 1), rnd.randrange(3)
            if kind == 0:
                w.insert(k, rnd.choice(letters + "x"))
            elif w and kind == 1:
                del w[min(k, len(w) - 1)]
            elif w:
                w[min(k, len(w) - 1)] = rnd.choice(letters + "x")
        words.append("".join(w))
    got = Lexicon(terms).nearest(words)
    assert (got != NONE).sum() > 300
    for w, d in zip(words, got):
        assert d == min((levenshtein(w, t) for t in terms if w and levenshtein(w, t) <= allowed(t)), default=NONE), w
    assert Lexicon([]).nearest(["a"]).tolist() == [NONE] and len(Lexicon(terms).nearest([])) == 0


def test_large_lexicon_stays_linear():
    rnd = random.Random(6)
    terms = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12)) for _ in range(5000)]
    big = Lexicon(terms)
    assert sum(x.nbytes for x in (big.code, big.ends, big.reach, big.n_children, big.first_child)) < 24 * 12 * 5000
    words = [t[:5] + t[6:] for t in terms[:40]] + [t[:3] + "zz" + t[5:] for t in terms[40:80]] + ["nothinglikeit"]
    assert (big.nearest(words) != NONE).tolist() == [True] * 80 + [False]


def test_matcher_keeps_what_it_knows():
    matcher = toxicity.Matcher(Lexicon(["dunderhead"]), np.zeros(0, np.uint64))
    text, at = flat("dunderhead dunderheed other ok dunderhead")
    starts, ends, _ = toxicity.words_of(text, at)
    hashes = span_hashes(text, starts, ends)
    assert matcher.distances(text, starts, ends, hashes).tolist() == [0, 1, NONE, NONE, 0]
    matcher.lexicon = None  # every word is known by now
    assert matcher.distances(text, starts, ends, hashes).tolist() == [0, 1, NONE, NONE, 0]
    blind = toxicity.Matcher(Lexicon(["dunderhead"]), np.sort(hashes[1:2]))
    assert blind.distances(text, starts, ends, hashes).tolist() == [0, NONE, NONE, NONE, 0]


def test_quotations_and_words():
    text = 'He said "you idiot" and left. “scum” «moron» idiot "open idiot\nidiot" a 5" pipe idiot he said "ok" „idiot“ « idiot » ("idiot")'
    raw = text.encode()
    places = [i for i in range(len(raw)) if raw[i : i + 5] in (b"idiot", b"moron") or raw[i : i + 4] == b"scum"]
    part, at = flat(text)
    assert toxicity.quoted(part, at, np.array(places)).tolist() == [True, True, True, False, False, False, False, True, True, True]
    two = np.frombuffer(b'say "idiotidiot" end', np.uint8)  # the border between documents ends the line
    assert toxicity.quoted(two, np.array([0, 10, 20]), np.array([5, 10])).tolist() == [False, False]
    starts, ends, _ = toxicity.words_of(*flat("“scum”, l0ser! sh*t *** a@b – don't «x»"))
    assert [r.decode() for r in ("“scum”, l0ser! sh*t *** a@b – don't «x»".encode()[a:b] for a, b in zip(starts, ends))] == [
        "scum", "l0ser", "sh*t", "a@b", "don't", "x"]


def test_context_windows_tell_reports_from_abuse(spark):
    """The same insults beside reporting words are clean, alone they are toxic: only the windows differ."""
    rnd = random.Random(7)
    docs, labels = [], []
    for i in range(900):
        words = prose(rnd, 60, 400).split()
        kind = i % 3
        if kind:
            k = rnd.randrange(5, 55)
            insult = rnd.choice(["wretchling", "scoundrelly", "dunderhead"])
            words[k:k] = ["insulted", "as", insult, "reportedly"] if kind == 1 else [insult]
        docs.append((i, " ".join(words)))
        labels.append((i, int(kind == 2)))
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    # quoted or reported insults lower a word's own share, so the lexicon asks less of it here
    old, toxicity.MIN_SHARE = toxicity.MIN_SHARE, 0.4
    try:
        model = toxicity.learn(docs, labels)
        assert len(model.context) and model.context_weights.min() < -1
        got = toxicity.scored(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    finally:
        toxicity.MIN_SHARE = old
    assert (got.toxic == got.predicted).mean() > 0.95


def test_few_clean_contexts_do_not_exempt_a_misspelling(spark):
    rows = [(b"dunderheed", 0, 1), (b"thunderhead", 0, 40), (b"dunderhead", 20, 0), (b"dunderhaed", 5, 1)]
    counted = spark.createDataFrame(rows, "word binary, toxic long, clean long")
    words = [r[0] for r in rows]
    offs = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    hashes = span_hashes(np.frombuffer(b"".join(words), np.uint8), offs[:-1], offs[1:])
    assert toxicity.exempt_words(counted).tolist() == [hashes[1]]


def labelled(spark, seed=1, n=700):
    rnd = random.Random(seed)
    bad = ["wretchling", "scoundrelly", "dunderhead"]
    docs, labels = [], []
    for i in range(n):
        words = prose(rnd, rnd.randrange(20, 80), 300).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(rnd.randrange(2, 5)):
                words.insert(rnd.randrange(len(words)), rnd.choice(bad))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_learns_words_misspellings_and_quotation(spark):
    docs, labels = labelled(spark)
    got = toxicity.scored(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.toxic == got.predicted).mean() > 0.98 and got.score.between(0, 1).all()
    rest = prose(random.Random(8), 40, 300)
    more = spark.createDataFrame(
        [(9001, f"{rest} wretchlng dunderheed scoundrely {rest}"), (9002, f"{rest} dunderhead wretchling {rest}"),
         (9003, f'{rest} "dunderhead wretchling" {rest}'), (9004, rest)], "doc_id long, text string")
    s = {r.doc_id: r.score for r in toxicity.scored(docs.unionByName(more), labels).where("doc_id > 9000").collect()}
    assert s[9002] > 0.5 and s[9001] > s[9004] and s[9002] > s[9003]


def test_toxicity_of_a_table(spark):
    labels = table(spark, "labels")
    got = toxicity.scored(table(spark, "documents"), labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.toxic == got.predicted).mean() > 0.85 and got[got.toxic == 1].score.mean() > got[got.toxic == 0].score.mean()


def test_scores_of_odd_rows(odd, empty, spark):
    labels = spark.createDataFrame([(10, 1, 0), (11, 0, 1), (12, None, None), (None, 1, 1), (14, 1, 0), (14, 0, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    for scored in (toxicity.scored, quality.scored):
        got = scored(odd, labels).collect()
        assert len(got) == len(odd_rows()) and all(0 <= r.score <= 1 for r in got)
        none = scored(odd, labels.where("doc_id = -1")).select("score").distinct().collect()
        assert len(none) == 1
        assert scored(empty, labels).count() == 0


def test_quality_of_a_table(spark):
    labels = table(spark, "labels")
    got = quality.scored(table(spark, "documents"), labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.quality == got.predicted).mean() > 0.93
    rank = got.score.rank()
    ones = (got.quality == 1).sum()
    auc = (rank[got.quality == 1].sum() - ones * (ones + 1) / 2) / ones / (len(got) - ones)
    assert auc > 0.95


def test_attention_gradients_are_right():
    rnd = np.random.default_rng(3)
    border = np.array([0, 3, 4, 9])
    x, y = rnd.normal(size=(9, quality.FEATURES)), np.array([1.0, 0.0, 1.0])
    old = quality.EPOCHS, quality.DECAY
    quality.EPOCHS, quality.DECAY = 1, 0.0
    try:
        model, moved = quality.Model(), quality.Model().learn(x, border, y)
        z = np.clip((x - moved.mean) / moved.scale, -8, 8)

        def loss(m):
            p = m._forward(z, border)["y"]
            return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

        for key in model.p:  # the first step of Adam goes against the sign of the gradient
            step = moved.p[key] - model.p[key]
            flat_index = np.unravel_index(np.abs(step).argmax(), step.shape)
            plus, minus = quality.Model(), quality.Model()
            plus.p[key][flat_index] += 1e-5
            minus.p[key][flat_index] -= 1e-5
            slope = (loss(plus) - loss(minus)) / 2e-5
            assert abs(slope) < 1e-9 or np.sign(slope) == -np.sign(step[flat_index])
    finally:
        quality.EPOCHS, quality.DECAY = old


def test_passages_cover_every_word():
    text = prose(random.Random(1), 200)
    both = np.frombuffer((text + "" + "A B.").encode(), np.uint8)
    x, border = quality.passages(both, np.array([0, len(text.encode()), len(text.encode()), len(both)]))
    assert border.tolist() == [0, 4, 5, 6] and (x[4] == 0).all()
    assert np.round(np.expm1(x[:, -1] * 4)).astype(int).tolist() == [64, 64, 64, 8, 0, 2]


def test_stage_rejects_what_no_language_looks_like(spark):
    docs = table(spark, "documents").select("doc_id", "text", "lang", "source")
    model = language.learn(docs)
    rnd = random.Random(2)
    alphabets = ["abcdefghijklmnopqrstuvwxyz    ", "bcdfghjklmnpqrstvwxz0123456789  ", "абвгдежзиклмнопрстуфхц   "]
    noise = [(10_000 + k, "".join(rnd.choice(alphabets[k % 3]) for _ in range(2500)), "en", None) for k in range(12)]
    planted = docs.unionByName(spark.createDataFrame(noise, docs.schema))
    kept = {r.doc_id for r in language.accepted(planted, model).select("doc_id").collect()}
    assert not any(i >= 10_000 for i in kept)
    held = [r.doc_id for r in docs.where(held_out(F.col("doc_id"))).collect()]
    assert sum(i in kept for i in held) >= 0.99 * len(held)
    blind = language.accepted(docs.drop("lang"), model).count()
    assert blind == len([i for i in kept if i < 10_000])
    unnamed = docs.withColumn("lang", F.lit(None).cast("string"))
    assert language.accepted(unnamed, language.learn(unnamed)).count() == docs.where("text rlike '[A-Za-z]'").count()


def test_samples_are_bounded_whatever_repeats(spark):
    rows = spark.range(4000).select(F.when(F.col("id") < 1500, None).otherwise(F.lit(7)).cast("long").alias("doc_id"), F.lit("a b").alias("text"), F.lit("en").alias("lang"))
    assert bounded_sample(rows, 100, ("doc_id", "text", "lang")).count() <= 2
    model = language.learn(rows, sample=100)
    assert model.languages == ["en"] and model.landmarks.shape[1] <= 2
    from basketry.llm.labelled import labelled_sample

    labels = spark.createDataFrame([(i, 1) for i in range(50)], "doc_id long, toxic int")
    many = labelled_sample(rows, labels, "toxic", 40).collect()
    assert len(many) <= 1 and all(r.text == "a b" for r in many)
