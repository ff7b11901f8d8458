"""Operator 1: names wherever they stand, copies in other case."""

from __future__ import annotations

import random

from basketry.llm import decontaminate as D
from tests.llm.conftest import prose

ASK = "Ann has 5 apples. Bob has 3 apples. Ann gives Bob 2 apples. How many apples has Ann?"


def leaked(spark, items, docs):
    docs = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    items = spark.createDataFrame(list(items.items()), "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in D.leaks(docs, items).collect()}


def test_names_that_open_sentences_or_follow_marks(spark):
    rest = prose(random.Random(2), 30)
    other = ASK.replace("Ann", "Sue").replace("Bob", "Tim").replace("5", "9").replace("3", "4")
    docs = {1: f"{rest}. {other} {rest}", 2: f"{rest}\n{other.replace('. ', chr(10))}", 3: rest, 4: other.replace("Sue", "Eve", 1).replace("Tim", "Joe", 1)}
    docs[5] = f'{rest} The Hague. "{other}"'
    got = leaked(spark, {7: ASK}, docs)
    assert set(got) == {(1, 7), (2, 7), (5, 7)}  # 4 gives Ann and Bob two names
    assert got[1, 7].share == 1.0 and got[1, 7].slot_conflicts == 0


def test_copies_in_other_case(spark):
    rest = prose(random.Random(2), 30)
    dense = "Then Ann met Bob and Eve while Joe saw Tim and Sue near Max before Ann and Joe left for Rome with Bob and Eve"
    docs = {1: f"{rest} {dense.lower()} {rest}", 2: dense.upper(), 3: f"{rest} {dense.title()}", 4: dense.lower().replace("joe", "kim")}
    got = leaked(spark, {7: dense}, docs)
    assert set(got) == {(1, 7), (2, 7), (3, 7)} and all(r.share == 1.0 for r in got.values())


WALK = "A train runs for five hours at 80 km per hour, then twenty-five km more than the other train, which left Rome at six in the morning"


def test_number_words_and_attached_units(spark):
    rest = prose(random.Random(2), 30)
    docs = {
        1: f"{rest} {WALK.replace('five hours', 'seven hours').replace('80 km', '95km').replace('twenty-five', 'one hundred and').replace(' and ', ' ')} {rest}",
        2: f"{rest} {WALK.replace('five hours', '7 hours').replace('80 km', '95 km').replace('twenty-five km', '30km').replace('six', '9')}",
        3: WALK.upper(), 4: f"{rest} {WALK.replace('km', 'apples').replace('hours', 'pears')}",
    }
    got = leaked(spark, {7: WALK}, docs)
    assert {1, 2, 3} <= {d for d, _ in got} and all(got[d, 7].slot_conflicts == 0 for d in (1, 2, 3))


def test_two_values_made_one_are_a_conflict(spark):
    rest = prose(random.Random(3), 30)
    ask = "if Ann has 4 pears and gives Bob 3 of them while Eve eats 2 in the morning then how many has Ann at noon"
    merged = ask.replace("Bob", "Ann").replace("Eve", "Ann").replace("3", "4").replace("2", "4")
    renamed = ask.replace("Ann", "Kim").replace("Bob", "Joe").replace("4", "9")
    got = leaked(spark, {7: ask}, {1: f"{rest} {merged}", 2: f"{rest} {renamed}", 3: ask})
    assert set(got) == {(2, 7), (3, 7)}


def test_many_pivots_are_joined_back_by_document(spark, monkeypatch):
    rest = prose(random.Random(2), 30)
    docs = [(1, f"{rest} {WALK} {rest}"), (2, WALK.replace("five", "nine")), (2, rest), (3, rest), (4, WALK.lower()), (4, f"x {WALK}"), (None, WALK), (5, None), (6, "")]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(7, WALK), (8, ASK), (9, rest)], "item_id long, text string")
    want = sorted(map(str, D.leaks(docs, items).collect()))
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    plan = D.window_matches(docs, D.item_windows(items))._jdf.queryExecution().analyzed().toString()
    assert "xxhash64" in plan
    assert sorted(map(str, D.leaks(docs, items).collect())) == want and len(want) == 6
