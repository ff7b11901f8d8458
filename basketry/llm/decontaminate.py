"""Operator 1 [native]: benchmark decontamination by template canonicalisation.

1. Words keep their letters and digits only. A word that starts with a digit becomes ``<num>``, and so do number words, a
   run of them as one ("twenty-five"); a unit after a number, also one written to it ("5km"), becomes ``<unit>``, a name
   ``<name>``; all others are lowered. What stood there is the slot's value. Every text has three
   forms: names are the capitalised words inside sentences (``INSIDE``), all capitalised words wherever they stand
   (``ANYWHERE``), or none (``FOLDED``, for copies in other case). Windows meet windows of the same form.
2. Every ``WINDOW`` consecutive template words of a benchmark item (all of them, if it has fewer) are a window;
   its ordinary word that is rarest in the benchmark (ties: the longest) is the pivot. Documents' words are hash-joined to the pivots, and the windows around
   the words found are hash-joined to the items' windows as strings, so equality is exact.
3. Windows of one document and item with the same offset between the texts are one alignment. A slot value of the
   item must stand for one value throughout an alignment, and a value of the document for one of the item (a question with
   other numbers or names substitutes them one for one); windows of alignments that break this in more than ``MAX_CONFLICT``
   of the item's values don't count.
4. A document leaks an item if at least ``MIN_SHARE`` of the item's different windows are found in it, as windows of
   form ``INSIDE`` or, if these don't suffice, in any form.

All of this is DataFrame functions. Pivots and windows of the benchmark are sent to all tasks if there are at
most ``BROADCAST_ROWS``; beyond that the documents' words are shuffled one by one, without their text, and what is found is
joined back to the texts by document.

Cases: null or empty texts and items match nothing; a very long text is one row until a window of it is found; an item without ordinary words has no pivot and is not
searched; repeated rows of an id, document or item, count once; rows without id are never reported nor removed;
an empty table gives no rows; other columns are ignored (``leaks``) or kept (``without_leaks``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm.scratch import as_row, of_row, read_table, stored

WINDOW = 8
MIN_SHARE = 0.5
MAX_CONFLICT = 0.2
BROADCAST_ROWS = 200_000

INSIDE, ANYWHERE, FOLDED = 0, 1, 2
NUMBER, UNIT, NAME = "<num>", "<unit>", "<name>"
UNITS = (
    "km cm mm m kg g mg lb lbs oz ml l liters litres liter litre miles mile feet foot ft inches inch yards yard hours "
    "hour hr hrs minutes minute min seconds second sec days day weeks week months month years year dollars dollar usd "
    "eur euros euro cents cent percent degrees degree mph kmh kwh watts watt volts volt"
).split()
#: Number words; a hundred and more only count after another one.
NUMBERS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
    "eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen"
).split()
#: Put before a name inside a sentence, before any other capitalised word, and between the words of one number;
#: private-use characters that no text has.
_MARK, _OTHER, _JOIN = "\ue000", "\ue002", "\ue001"


def _one_of(words: list[str]) -> str:
    """An expression for one of the words, by their first letters."""
    by = {}
    for w in words:
        by.setdefault(w[0], []).append(w[1:])
    return "(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by.items()) + ")"


_NUMBER, _UNIT = _one_of(NUMBERS), _one_of(UNITS)


def _words(text: Column) -> Column:
    """The text's words, letters and digits only, single blanks between them, apart from the marks before capitalised words
    and between number words. Marks inside a number go, so that it stays one word; a unit written to it is parted."""
    number = F.regexp_replace(text, r"(?<=[0-9])[.,:/](?=[0-9])", "")
    number = F.regexp_replace(number, rf"(?i)(?<=[0-9])(?={_UNIT}(?![\p{{L}}\p{{N}}]))", " ")
    text = F.when(text.rlike(r"[0-9](?:[.,:/][0-9]|[a-zA-Z])"), number).otherwise(text)
    text = F.regexp_replace(text, r" (?<=[\p{Ll}\p{N}] |[\p{Ll}\p{N}], )(?=\p{Lu}\p{Ll})", " " + _MARK)
    text = F.trim(F.regexp_replace(text, rf"[^\p{{L}}\p{{N}}{_MARK}]+", " "))
    pair = rf"(?<![^ {_MARK}])({_NUMBER}) {_MARK}?(?={_NUMBER}(?![^ ]))"
    joined = F.regexp_replace(text, "(?i)" + pair, "$1" + _JOIN)
    text = F.when(F.lower(text).rlike(rf"(?:^| {_MARK}?){_NUMBER} {_MARK}?{_NUMBER}(?![^ ])"), joined).otherwise(text)
    return F.regexp_replace(text, r"(?<![^ ])(?=\p{Lu}\p{Ll})", _OTHER)


def _template(words: Column) -> Column:
    """The same words, as many of them, lowered, with placeholders for numbers and units; capitalised words are still marked."""
    text = F.regexp_replace(F.lower(words), rf"(^| )[{_MARK}{_OTHER}]?(?:[0-9]|{_NUMBER}(?![^ {_JOIN}]))[^ ]*", "$1" + NUMBER)
    return F.regexp_replace(text, rf"{NUMBER} [{_MARK}{_OTHER}]?{_UNIT}(?![^ ])", f"{NUMBER} {UNIT}")


def templated(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``key, raw, forms``: the words as written (with their marks) and, for each form, the template words: arrays of equal
    length (one empty word for a text without words)."""
    rows = rows.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("t")).where(F.col(key).isNotNull() & F.col("t").isNotNull())
    # a filter on the words would make Spark clean every text twice
    rows = rows.select(key, _words(F.col("t")).alias("w")).select(key, "w", _template(F.col("w")).alias("c"))
    inside = F.translate(F.regexp_replace("c", rf"{_MARK}[^ ]+", NAME), _OTHER, "")
    anywhere = F.regexp_replace("c", rf"[{_MARK}{_OTHER}][^ ]+", NAME)
    forms = F.array(*(F.split(c, " ") for c in (inside, anywhere, F.translate("c", _MARK + _OTHER, ""))))
    return rows.select(key, F.split("w", " ").alias("raw"), forms.alias("forms"))


def _slice(words: str, start: str) -> Column:
    return F.expr(f"slice({words}, greatest({start}, 0) + 1, size)")


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``item_id, form, at, size, template, folded, raw, canon, pivot, shift``: each window of each item in each form;
    ``shift`` words in, the pivot; ``folded`` is the same window's template of that form."""
    rows = templated(items, "item_id", "text").dropDuplicates(["item_id", "raw"])
    rows = rows.select("item_id", "raw", F.element_at("forms", FOLDED + 1).alias("folded"), F.posexplode("forms").alias("form", "canon"))
    words = rows.select("form", F.explode("canon").alias("word"))
    often = words.groupBy("form", "word").agg(F.count(F.lit(1)).alias("often")).where(~F.col("word").isin(NUMBER, UNIT, NAME, ""))
    rows = rows.withColumn("size", F.least(F.lit(window), F.size("canon")))
    rows = rows.withColumn("at", F.explode(F.sequence(F.lit(0), F.size("canon") - F.col("size"))))
    sliced = (_slice(c, "at").alias(c) for c in ("canon", "raw", "folded"))
    rows = rows.select("item_id", "form", "at", "size", *sliced).withColumn("folded", F.array_join("folded", " "))
    key = ["item_id", "form", "at", "raw", "canon"]
    pivots = rows.select(*key, F.posexplode("canon").alias("shift", "word")).join(often, ["form", "word"])
    first = F.min(F.struct("often", (-F.length("word")).alias("short"), "word", "shift")).alias("b")
    pivots = pivots.groupBy(*key).agg(first).select(*key, F.col("b.word").alias("pivot"), F.col("b.shift").alias("shift"))
    return rows.join(pivots, key).withColumn("template", F.array_join("canon", " "))


def _small(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _value(word: Column) -> Column:
    """A word without its marks."""
    return F.translate(word, _JOIN + _MARK + _OTHER, " ")


def window_matches(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """``doc_id, item_id, form, at, template, folded, place, slots``: each item window found in a document, at which
    word, and its slots."""
    pivots = stored(windows.select("form", "pivot", "shift", "size").distinct(), "pivots")
    spot = ["doc_id", "form", "place", "size"]
    fits = (F.col("place") >= 0) & (F.col("place") + F.col("size") <= F.size(F.element_at("forms", F.col("form") + 1)))
    # explode_outer: before a plain explode Spark filters on the array's size and so makes every template twice
    words = templated(docs, "doc_id", "text")
    # an ordinary word is the same in every form that has it
    each = F.posexplode_outer(F.element_at("forms", FOLDED + 1)).alias("p", "pivot")
    place = F.expr("p - shift").alias("place")
    if pivots.count() <= BROADCAST_ROWS:
        found = words.select("doc_id", "raw", "forms", each).join(F.broadcast(pivots), "pivot").select("doc_id", "form", place, "size", "raw", "forms")
    else:
        text = F.xxhash64("raw").alias("text")
        spots = words.select("doc_id", text, each).join(pivots, "pivot").select("doc_id", "text", "form", place, "size").where("place >= 0").distinct()
        found = spots.join(words.withColumn("text", text), ["doc_id", "text"])
    found = found.where(fits).select(*spot, "raw", F.element_at("forms", F.col("form") + 1).alias("canon"))
    found = found.select("doc_id", "form", "place", _slice("raw", "place").alias("written"), _slice("canon", "place").alias("canon"))
    found = found.select("doc_id", "form", "place", "written", F.array_join("canon", " ").alias("template"))
    sides = windows.select("item_id", "form", "at", "template", "folded", "canon", F.col("raw").alias("asked"))
    hits = found.join(_small(sides), ["form", "template"]).dropDuplicates(["doc_id", "item_id", "form", "at", "template", "folded", "place"])
    slots = F.filter(
        F.zip_with("asked", F.zip_with("written", "canon", lambda w, c: F.struct(w.alias("w"), c.alias("c"))), lambda a, x: F.struct(_value(a).alias("asked"), _value(x["w"]).alias("written"), x["c"].alias("c"))),
        lambda x: x["c"].isin(NUMBER, UNIT, NAME),
    )
    return hits.select("doc_id", "item_id", "form", "at", "template", "folded", "place", slots.alias("slots"))


def leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, min_share: float = MIN_SHARE) -> DataFrame:
    """``doc_id, item_id, windows_found, windows_total, share, slots, slot_conflicts``: one row per leaked pair."""
    windows = stored(item_windows(items, window), "item-windows")
    inside = F.when(F.col("form") == INSIDE, F.col("template"))
    total = windows.groupBy("item_id").agg(F.count_distinct(inside).alias("total"), F.count_distinct("folded").alias("total_any"))
    hits = stored(window_matches(docs, windows), "window-matches").withColumn("line", F.col("place") - F.col("at"))
    line = ["doc_id", "item_id", "form", "line"]
    values = hits.select(*line, F.explode("slots").alias("s")).select(*line, "s.asked", "s.written").distinct()
    sides = F.array(*(F.struct(F.lit(c == "asked").alias("of_item"), F.col(c).alias("value")) for c in ("asked", "written")))
    values = values.select(*line, F.explode(sides).alias("v")).groupBy(*line, "v").agg(F.count(F.lit(1)).alias("n"))
    lines = values.groupBy(*line).agg(F.count_if("v.of_item").alias("slots"), F.count_if(F.col("n") > 1).alias("slot_conflicts"))
    sound = hits.drop("slots").join(lines, line, "left").fillna(0, ["slots", "slot_conflicts"])
    sound = sound.where(F.col("slot_conflicts") <= MAX_CONFLICT * F.col("slots"))
    own = {c: F.when(F.col("form") == INSIDE, F.col(c)) for c in ("slots", "slot_conflicts")}
    pairs = sound.groupBy("doc_id", "item_id").agg(
        F.count_distinct(inside).alias("found"), F.count_distinct("folded").alias("found_any"), *(F.max(v).alias(c) for c, v in own.items()),
        *(F.max(c).alias(f"{c}_any") for c in own),
    )
    pairs = pairs.join(_small(total), "item_id")
    enough = (F.col("total") > 0) & (F.col("found") >= min_share * F.col("total"))
    told = {n: F.when(enough, F.col(c)).otherwise(F.col(f"{c}_any")) for n, c in
            (("windows_found", "found"), ("windows_total", "total"), ("slots", "slots"), ("slot_conflicts", "slot_conflicts"))}
    pairs = pairs.select("doc_id", "item_id", *(v.alias(n) for n, v in told.items())).withColumn("share", F.col("windows_found") / F.col("windows_total"))
    return pairs.where(F.col("share") >= min_share).select("doc_id", "item_id", "windows_found", "windows_total", "share", "slots", "slot_conflicts")


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that leak no item, all columns as they were."""
    found = leaks(docs, items).select(F.col("doc_id").alias("_leaked")).distinct()
    return as_row(docs).join(found, of_row("doc_id").cast("long") == F.col("_leaked"), "left_anti").select("_row.*")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
