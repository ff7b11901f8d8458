"""Operator 12: secrets found by one combined deterministic automaton.

1. Every rule's expression goes into one automaton (``automaton.compiled``): subset construction over byte classes,
   minimisation, transition arrays. It reads the texts backwards, so a state's tags say which rules have a match that
   begins at this byte; all rules are answered by one pass over the bytes.
2. A task cuts its texts into lanes of ``LANE`` bytes and moves all lanes by one byte at a time (one array lookup). A
   lane begins in the start state; where the lane before it ended in another state, it is read again from that one
   until the states agree, so matches across lanes are found as well. Texts are apart by a byte class that leads
   every state back to the start.
3. From the leftmost begin of each rule, the automaton of the rules read forwards gives the longest end and where the
   rule's value begins; the next begin counts after that end. A match whose value is shorter than the rule asks for is
   dropped after that, so it still covers its text.

A rule is ``head`` and ``value``: the expression is both in a row, ``least`` is the fewest characters of the value.
``hex`` asks for its length in the expression itself: a run of hex digits always ends where no more follow, so short
runs can neither hide nor shorten long ones.

Cases: a null or empty text has no spans; a text of any length is scanned whole, in one task and as bytes of its
batch; offsets are code points, ends exclusive; repeated rows and rows without ``doc_id`` are scanned like any other;
spans of different rules may overlap, those of one rule never do; an empty table gives no rows; other columns are
passed over (``secret_spans``) or kept (``redacted``), whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm.automaton import Automaton, compiled
from basketry.llm.hashing import chunks, text_buffer
from basketry.llm.scratch import as_row, of_row, read_table, ship

LANE = 256


@dataclass(frozen=True)
class Rule:
    kind: str
    head: str
    value: str
    least: int = 1
    fold: bool = False  # letters of the head in either case


#: The base rules, then public formats of other credentials.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]+", 8, True),
    Rule("access", "", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", "", r"[0-9a-f]{32,}", 32),
)
RULES = BASE + (
    Rule("private_key", "", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", "", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", "", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("web_token", "", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30),
    Rule("google", "", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("stripe", "", r"[rs]k_live_[A-Za-z0-9]+", 32),
)

SPANS = "array<struct<kind:string,start:long,end:long>>"


class Scanner:
    """The two automata of a set of rules, and spans of texts by them."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        whole = tuple((r.head + r.value if not r.fold else _folded(r), False) for r in rules)
        heads = tuple((r.head, r.fold) for r in rules if r.head)
        self.back = compiled(whole, backwards=True, anywhere=True)
        self.ahead = compiled(whole + heads)
        self.klass, self.step, self.tags = self.ahead.klass.tolist(), self.ahead.step.tolist(), self.ahead.tags.tolist()
        with_head = [k for k, r in enumerate(rules) if r.head]
        self.head_bit = {k: 1 << (len(rules) + j) for j, k in enumerate(with_head)}

    def spans(self, part: np.ndarray, offs: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """(start, rule, end) of each text, as bytes of the text."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offs) - 1)]
        at, tags = begins(self.back, part, offs)
        if not len(at):
            return out
        rows = np.searchsorted(offs, at, "right") - 1
        for k, rule in enumerate(self.rules):
            own = np.flatnonzero(tags >> k & 1)
            cuts = np.flatnonzero(np.diff(rows[own], prepend=-1))
            for lo, hi in zip(cuts, np.append(cuts[1:], len(own))):
                row, places, i = int(rows[own[lo]]), at[own[lo:hi]], 0
                text = part[offs[row] : offs[row + 1]].tobytes()
                places = (places - offs[row]).tolist()
                while i < len(places):
                    end, value = self.longest(text, places[i], k)
                    if sum(b & 0xC0 != 0x80 for b in text[value : min(end, value + 4 * rule.least)]) >= rule.least:
                        out[row].append((places[i], k, end))
                    i = bisect_left(places, end, i + 1)
        for found in out:
            found.sort()
        return out

    def longest(self, text: bytes, start: int, rule: int) -> tuple[int, int]:
        """Where the longest match of the rule from ``start`` ends and where its value begins."""
        bit, head, step, klass, tags, dead = 1 << rule, self.head_bit.get(rule, 0), self.step, self.klass, self.tags, self.ahead.dead
        state, end, value, i = 0, start, start, start
        for i in range(start, len(text)):
            state = step[state][klass[text[i]]]
            if state == dead:
                break
            tag = tags[state]
            if tag & bit:
                end = i + 1
            if tag & head:
                value = i + 1
        return end, value


def _folded(rule: Rule) -> str:
    """The rule's expression with the letters of its head in either case."""
    out, inside, i = "", False, 0
    while i < len(rule.head):
        c = rule.head[i]
        if c == "\\":
            width = 4 if rule.head[i + 1] == "x" else 2
            out, i = out + rule.head[i : i + width], i + width
            continue
        inside = c == "[" or inside and c != "]"
        out += c if inside or not c.isalpha() else f"[{c.lower()}{c.upper()}]"
        i += 1
    return out + rule.value


def begins(automaton: Automaton, part: np.ndarray, offs: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, np.ndarray]:
    """Bytes at which a rule matches, ascending, with the tags of those rules: one pass from the last byte to the first."""
    reset, classes = automaton.reset, automaton.step.shape[1]
    symbols = np.insert(automaton.klass[part], offs[1:], reset)[::-1]  # a reset after each text
    n = len(symbols)
    lanes = -(-n // lane)
    table = np.full(lanes * lane, reset, np.uint8)
    table[:n] = symbols
    table = np.ascontiguousarray(table.reshape(lanes, lane).T)
    move = (automaton.step * classes).astype(np.intp).ravel()  # a state is the begin of its row
    seen = np.empty((lane, lanes), np.int32)
    now = np.zeros(lanes, np.intp)
    for i in range(lane):
        now = move[now + table[i]]
        seen[i] = now
    began = np.zeros(lanes, np.int32)
    while True:
        ended = np.concatenate([[0], seen[-1, :-1]])
        wrong = np.flatnonzero(began != ended)
        if not len(wrong):
            break
        began[wrong] = ended[wrong]
        now = ended[wrong].astype(np.intp)
        for i in range(lane):
            now = move[now + table[i, wrong]]
            other = now != seen[i, wrong]
            wrong, now = wrong[other], now[other]
            if not len(wrong):
                break
            seen[i, wrong] = now
    step, lane_of = np.nonzero(seen >= automaton.first_accepting * classes)
    place = lane_of * lane + step
    order = np.argsort(-place, kind="stable")
    place, states = n - 1 - place[order], seen[step[order], lane_of[order]] // classes
    ok = place >= 0
    place, states = place[ok], states[ok]
    resets = offs[1:] + np.arange(len(offs) - 1)
    return place - np.searchsorted(resets, place), automaton.tags[states]


def _code_points(part: np.ndarray, places: np.ndarray) -> np.ndarray:
    before = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
    return before[places]


def _scanned(batches: Iterator[pa.RecordBatch], rules: tuple[Rule, ...]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner(rules)
    kinds = [r.kind for r in rules]
    for batch in batches:
        buf, offs = text_buffer(batch.column(1))
        kind, start, end, count = [], [], [], []
        for lo, hi, part, at in chunks(buf, offs):
            for row, found in enumerate(scanner.spans(part, at)):
                count.append(len(found))
                if found:
                    text = part[at[row] : at[row + 1]]
                    kind += [kinds[k] for _, k, _ in found]
                    start += _code_points(text, np.array([s for s, _, _ in found])).tolist()
                    end += _code_points(text, np.array([e for _, _, e in found])).tolist()
        items = pa.StructArray.from_arrays([pa.array(kind, pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["kind", "start", "end"])
        spans = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), items)
        yield pa.RecordBatch.from_arrays([batch.column(0), spans], ["_id", "spans"])


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id, spans``: each row's secrets (kind, start, end) by start, then in the rules' order. One pass, no shuffle."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("_text"))
    found = rows.mapInArrow(lambda it: _scanned(it, rules), f"_id long, spans {SPANS}")
    return found.select(F.col("_id").alias("doc_id"), "spans")


def _cleaned(batches: Iterator[pa.RecordBatch], rules: tuple[Rule, ...]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner(rules)
    for batch in batches:
        where = batch.column(0).type.get_field_index("text")
        texts = batch.column(0).field(where)
        buf, offs = text_buffer(texts)
        out: list[str | None] = []
        for lo, hi, part, at in chunks(buf, offs):
            for row, found in enumerate(scanner.spans(part, at)):
                text, end, pieces = part[at[row] : at[row + 1]].tobytes(), 0, []
                for s, k, e in found:
                    if s >= end:
                        pieces += [text[end:s], f"<{rules[k].kind}>".encode()]
                    end = max(end, e)
                out.append(b"".join([*pieces, text[end:]]).decode())
        out = [t if ok else None for t, ok in zip(out, texts.is_valid().to_pylist())]
        fields = [batch.column(0).field(j) if j != where else pa.array(out, pa.string()) for j in range(batch.column(0).type.num_fields)]
        yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(fields, fields=list(batch.column(0).type))], ["_row"])


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with each secret (overlapping ones as one) replaced by the kind of the first, ``<kind>``."""
    ship(docs.sparkSession)
    rows = as_row(docs.withColumn("text", F.col("text").cast("string")))
    out = rows.mapInArrow(lambda it: _cleaned(it, rules), rows.schema)
    return out.select(*(of_row(c).alias(c) for c in docs.columns))


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))))


def _of(spans: str, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(read_table(spark, sf_dir, "documents"))
    kinds = [r.kind for r in BASE]
    counts = [F.size(_of("spans", k)).cast("long").alias(f"n_{k}") for k in kinds]
    base = _of("spans", *kinds)
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def _either_case(pattern: str) -> str:
    return _folded(Rule("", pattern, "", fold=True))


def _sql() -> str:
    """Matches and the text between them by regular expressions; offsets from their lengths."""
    one = """
  SELECT doc_id, row, {n} AS ord, '{kind}' AS kind, string_split_regex(t, '{pattern}') AS gaps,
    regexp_extract_all(t, '{pattern}') AS hits, regexp_extract_all(t, '{pattern}', {group}) AS vals, {least} AS least FROM docs"""
    parts = []
    for n, r in enumerate(RULES):
        head = (_either_case(r.head) if r.fold else r.head).replace("(", "(?:")
        pattern = f"{head}({r.value.replace('{32,}', '+')})".replace("'", "''")
        parts.append(one.format(n=n, kind=r.kind, pattern=pattern, group=1, least=r.least))
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS row FROM documents),
found AS ({" UNION ALL ".join(parts)}
), places AS (
  SELECT *, unnest(range(1, len(hits) + 1)) AS k FROM found WHERE len(hits) > 0
), spans AS (
  SELECT row, ord, kind, len(hits[k]) AS width, len(vals[k]) AS val, least,
    CAST(list_sum(list_transform(gaps[1:k], lambda x: len(x))) + coalesce(list_sum(list_transform(hits[1:k-1], lambda x: len(x))), 0) AS BIGINT) AS s
  FROM places
), kept AS (
  SELECT row, ord, s, kind || ':' || s || ':' || (s + width) AS span FROM spans WHERE val >= least
), digests AS (
  SELECT row, count(*) FILTER (ord = 0) AS a, count(*) FILTER (ord = 1) AS b, count(*) FILTER (ord = 2) AS c,
    string_agg(span, ',' ORDER BY s, ord) FILTER (ord < 3) AS base, string_agg(span, ',' ORDER BY s, ord) AS spans
  FROM kept GROUP BY row
)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN digests USING (row)
"""


OP12_SQL = _sql()
