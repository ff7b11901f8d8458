"""Operator 4: toxicity by Levenshtein automata over a lexicon trie, with context windows.

1. Lexicon: from a sample of at most about ``SAMPLE`` labelled documents (a documented bound), the words whose
   occurrences, counted once for each pair of neighbour words, are toxic far beyond chance (log-likelihood ratio
   against the label's share, corrected for the number of words). Copies of a document share their contexts, so
   they add nothing. Every word that passes is taken.
2. Automaton: a task's different words, as a trie, are walked together with the lexicon's trie, with the states of the
   Levenshtein automaton of each word's allowed distance (0 under 5 characters, 1 under 10, else 2): ``lexicon_trie``. Words
   that the sample's clean documents hold significantly more often than toxic ones are exempt from inexact matches.
3. Context: a hit is a quotation if on its line the nearest quotation mark before it opens and the nearest one after it
   closes; a mark opens or closes by the blanks and marks around it, so an inch mark opens nothing. The ``WINDOW`` words on either side
   of a hit have weights: the log-odds of the labels of the sample's documents that have the word beside a hit, where
   significant; reporting verbs and negations of any language come out as clean, insults as toxic.
4. Logistic regression over hits outside quotations, exact and inexact, their density and kinds, quoted hits, and the windows'
   mean and greatest score gives the document's score.

Words are runs of letters, digits and bytes beyond ASCII; ``@ $ * '`` inside a word belong to it; A-Z are lowered.
Whole texts are read.

Cases: null and empty texts have no hits and get the score of a text without hits; without labels of both kinds
every score is the share of label 1 (0 if there is none); rows without ``doc_id`` are scored and never learned from; a word
of any length is read, one far longer than all lexicon words is none of them; a very long text is one row of its chunk;
repeated rows are scored each; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm.hashing import LOWER, SPACE, chunks, span_hashes, text_buffer
from basketry.llm.labelled import held_out, labelled_sample
from basketry.llm.lexicon_trie import NONE, Lexicon
from basketry.llm.scratch import read_table, ship, stored

SAMPLE = 12_000
SHORTEST = 3
MIN_SHARE = 0.7
#: Log-likelihood ratio against ``MIN_SHARE`` from which a word's clean contexts exempt it: three of them and no toxic one.
EXEMPT = 3.0
WINDOW = 8
#: Documents that must have a word beside a hit before it gets a weight.
WINDOW_DOCS = 8
FEATURES = 8
#: Words whose distance a worker keeps.
KEPT_WORDS = 1_000_000

_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[65:91] = _IN_WORD[97:123] = _IN_WORD[128:] = True
_INNER = np.isin(np.arange(256), list(b"@$*'"))
#: Bytes outside a quotation beside its marks.
_BEFORE, _AFTER = SPACE | np.isin(np.arange(256), list(b"([{")), SPACE | np.isin(np.arange(256), list(b".,;:!?)]}"))


def words_of(part: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word of a chunk, and the index of each document's first word (and the end)."""
    if not len(part):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    word = _IN_WORD[part]
    word[1:-1] |= _INNER[part[1:-1]] & word[:-2] & word[2:]
    quote = part[:-2] == 0xE2
    for k in range(3):  # U+2010 to U+206F (dashes and quotation marks) part words, and so do the guillemets
        word[k : len(part) - 2 + k][quote & (part[1:-1] == 0x80)] = False
    for mark in (0xAB, 0xBB):
        both = (part[:-1] == 0xC2) & (part[1:] == mark)
        word[:-1][both] = False
        word[1:][both] = False
    begin, stop = word.copy(), word.copy()
    inner = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(part))]
    begin[1:] &= ~word[:-1]
    stop[:-1] &= ~word[1:]
    begin[inner] = word[inner]
    stop[inner - 1] = word[inner - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(stop) + 1, np.searchsorted(starts, at)


class Matcher:
    """Distances of words to the lexicon; those of the words a worker has met are kept."""

    def __init__(self, lexicon: Lexicon, exempt: np.ndarray):
        self.lexicon, self.exempt = lexicon, exempt  # sorted hashes of words that never match inexactly
        self.hashes, self.known = np.zeros(0, np.uint64), np.zeros(0, np.int8)

    def distances(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Distance of each word (given as bytes from start to end, and hashed) to the nearest lexicon word."""
        different, seen, place = np.unique(hashes, return_index=True, return_inverse=True)
        new = different[~_among(different, self.hashes)]
        if len(new):
            at = seen[np.searchsorted(different, new)]
            raw = low.tobytes()
            words = [raw[a:b].decode() if b - a >= SHORTEST else "" for a, b in zip(starts[at].tolist(), ends[at].tolist())]
            found = self.lexicon.nearest(words)
            found[_among(new, self.exempt) & (found > 0)] = NONE
            if len(self.hashes) > KEPT_WORDS:
                old = _among(self.hashes, different)
                self.hashes, self.known = self.hashes[old], self.known[old]
            order = np.argsort(np.concatenate([self.hashes, new]), kind="stable")
            self.hashes, self.known = np.concatenate([self.hashes, new])[order], np.concatenate([self.known, found])[order]
        return self.known[np.searchsorted(self.hashes, different)][place]


def _among(values: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    """Which of the values are in the ascending array."""
    if not len(ascending):
        return np.zeros(len(values), bool)
    return ascending[np.minimum(np.searchsorted(ascending, values), len(ascending) - 1)] == values


@dataclass
class Model:
    lexicon: Lexicon | None
    exempt: np.ndarray
    context: np.ndarray  # sorted hashes of words that have a weight beside a hit
    context_weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    base: float


#: Quotation marks as UTF-8, and whether they open where the blanks around them do not tell (None: neither).
QUOTES = ((b'"', None), ("\u201c".encode(), True), ("\u201e".encode(), True), ("\u201d".encode(), False), ("\u00ab".encode(), True), ("\u00bb".encode(), False))


def _marks(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where quotation marks and line ends are, ascending, and what each is: 1 opens, -1 closes, 0 line end."""
    places, kinds = [np.flatnonzero(part == 10)], [np.zeros(int((part == 10).sum()), np.int8)]
    padded = np.concatenate([part, np.full(4, 32, np.uint8)])
    for mark, default in QUOTES:
        at = np.flatnonzero(part == mark[0])
        for k in range(1, len(mark)):
            at = at[padded[at + k] == mark[k]]
        before, after = (at == 0) | _BEFORE[part[np.maximum(at - 1, 0)]], _AFTER[padded[at + len(mark)]]
        kind = np.where(before & ~after, 1, np.where(~before & after, -1, 0 if default is None else 1 if default else -1))
        told = kind != 0
        places.append(at[told])
        kinds.append(kind[told].astype(np.int8))
    places, kinds = np.concatenate(places), np.concatenate(kinds)
    order = np.argsort(places, kind="stable")
    return places[order], kinds[order]


def quoted(part: np.ndarray, at: np.ndarray, spots: np.ndarray) -> np.ndarray:
    """Which of the bytes ``spots`` stand in a quotation of their line."""
    places, kinds = _marks(part)
    ends = at[1:-1]  # a document ends its last line
    places, kinds = np.concatenate([places, ends - 0.5]), np.concatenate([kinds, np.zeros(len(ends), np.int8)])
    order = np.argsort(places, kind="stable")
    places, kinds = places[order], np.concatenate([[0], kinds[order], [0]])
    where = np.searchsorted(places, spots, "right")
    return (kinds[where] == 1) & (kinds[where + 1] == -1)


def _hits(part: np.ndarray, at: np.ndarray, matcher: Matcher) -> tuple[np.ndarray, ...]:
    """Words that match: their number, document, distance and whether they are quoted; hashes and first word of documents."""
    low = LOWER[part]
    starts, ends, first = words_of(low, at)
    hashes = span_hashes(low, starts, ends)
    d = matcher.distances(low, starts, ends, hashes) if len(starts) else np.zeros(0, np.int8)
    hit = np.flatnonzero(d != NONE)
    return hit, np.searchsorted(first, hit, "right") - 1, d[hit], quoted(part, at, starts[hit]), hashes, first


def _windows(hit: np.ndarray, doc: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each hit the numbers of the words around it, and which of them are in its document and no hits."""
    around = hit[:, None] + np.concatenate([np.arange(-WINDOW, 0), np.arange(1, WINDOW + 1)])[None]
    inside = (around >= first[doc][:, None]) & (around < first[doc + 1][:, None])
    return np.where(inside, around, 0), inside & ~_among(around.ravel(), hit).reshape(around.shape)


def features(part: np.ndarray, at: np.ndarray, matcher: Matcher, context: np.ndarray, context_weights: np.ndarray) -> np.ndarray:
    """Measures of each document of a chunk, as the module describes."""
    x = np.zeros((len(at) - 1, FEATURES))
    hit, doc, distance, in_quotes, hashes, first = _hits(part, at, matcher)
    if not len(hit):
        return x
    n, total = len(x), np.maximum(np.diff(first), 1)
    exact, inexact = (np.bincount(doc[~in_quotes & own], minlength=n) for own in (distance == 0, distance > 0))
    x[:, 0], x[:, 1] = np.log1p(exact), np.log1p(inexact)
    x[:, 2], x[:, 3] = 20 * exact / (total + 20), 20 * inexact / (total + 20)
    kinds = np.unique(np.stack([doc[~in_quotes].astype(np.uint64), hashes[hit][~in_quotes]]), axis=1)
    x[:, 4] = np.log1p(np.bincount(kinds[0].astype(int), minlength=n))
    x[:, 5] = np.log1p(np.bincount(doc[in_quotes], minlength=n))
    if len(context):
        around, inside = _windows(hit, doc, first)
        word = hashes[around]
        known = inside & _among(word.ravel(), context).reshape(word.shape)
        weight = np.where(known, context_weights[np.minimum(np.searchsorted(context, word), len(context) - 1)], 0.0).sum(1)
        x[:, 6] = np.bincount(doc, weight, minlength=n) / np.maximum(np.bincount(doc, minlength=n), 1)
        greatest = np.full(n, -np.inf)
        np.maximum.at(greatest, doc, weight)
        x[:, 7] = np.where(np.isfinite(greatest), greatest, 0.0)
    return x


def _chunked(batch: pa.RecordBatch, column: int = 1):
    buf, offs = text_buffer(batch.column(column))
    yield from chunks(buf, offs)


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each sampled document's words: one row for each (word, neighbours)."""
    for batch in batches:
        labels = batch.column(2).to_numpy()
        for lo, hi, part, at in _chunked(batch):
            low = LOWER[part]
            starts, ends, first = words_of(low, at)
            h = np.concatenate([[0], span_hashes(low, starts, ends), [0]]).astype(np.uint64) if len(starts) else np.zeros(2, np.uint64)
            context = (h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[2:]).view(np.int64)
            doc = np.searchsorted(first, np.arange(len(starts)), "right") - 1
            size = ends - starts
            keep = np.flatnonzero(size >= SHORTEST)
            raw = low.tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array([raw[a:b] for a, b in zip(starts[keep].tolist(), ends[keep].tolist())], pa.binary()),
                 pa.array(labels[lo:hi][doc[keep]].astype(np.int32)), pa.array(context[keep])],
                ["word", "label", "context"],
            )


def _beside(batches: Iterator[pa.RecordBatch], lexicon: Lexicon, exempt: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The words beside the hits of each sampled document, once for a document."""
    matcher = Matcher(lexicon, exempt)
    for batch in batches:
        labels = batch.column(2).to_numpy()
        for lo, hi, part, at in _chunked(batch):
            hit, doc, _, _, hashes, first = _hits(part, at, matcher)
            around, inside = _windows(hit, doc, first) if len(hit) else (np.zeros((0, 1), np.int64), np.zeros((0, 1), bool))
            pairs = np.unique(np.stack([np.repeat(doc, around.shape[1])[inside.ravel()].astype(np.uint64), hashes[around][inside] if len(hit) else np.zeros(0, np.uint64)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[1].view(np.int64)), pa.array(labels[lo:hi][pairs[0].astype(int)].astype(np.int32))], ["word", "label"])


def _features(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    matcher = Matcher(model.lexicon, model.exempt)
    for batch in batches:
        for lo, hi, part, at in _chunked(batch):
            x = features(part, at, matcher, model.context, model.context_weights)
            yield pa.RecordBatch.from_arrays([batch.column(2).slice(lo, hi - lo), pa.array([r.tobytes() for r in x], pa.binary())], ["label", "x"])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights and bias by Newton steps."""
    z = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(z.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[-1, -1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        move = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + penalty, z.T @ (p - y) + penalty @ w)
        w -= move
        if np.abs(move).max() < 1e-6:
            break
    return w


def _sureness(share: float) -> Column:
    """Log-likelihood ratio of ``toxic`` out of ``toxic + clean`` against a share."""
    n, p = F.col("toxic") + F.col("clean"), F.col("toxic") / (F.col("toxic") + F.col("clean"))
    rest = F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - share))).otherwise(0.0)
    return n * (F.when(p > 0, p * F.log(p / share)).otherwise(0.0) + rest)


def lexicon_words(counted: DataFrame, share: float) -> list[str]:
    """The words of ``word, toxic, clean`` (different contexts) that are toxic beyond chance. Chance allows for the number of
    words, and every context is of a sampled document, so the sample bounds how many there are."""
    p = F.col("toxic") / (F.col("toxic") + F.col("clean"))
    limit = math.log(max(counted.count(), 1)) + 3
    rows = counted.where((p >= max(MIN_SHARE, share)) & (_sureness(share) > limit)).select("word")
    return sorted(bytes(r.word).decode() for r in rows.collect())


def exempt_words(counted: DataFrame) -> np.ndarray:
    """Sorted hashes of the words that clean contexts have significantly more often than ``MIN_SHARE`` allows."""
    p = F.col("toxic") / (F.col("toxic") + F.col("clean"))
    rows = counted.where((p < MIN_SHARE) & (_sureness(MIN_SHARE) >= EXEMPT)).select("word").collect()
    words = [bytes(r.word) for r in rows]
    offs = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    return np.sort(span_hashes(np.frombuffer(b"".join(words), np.uint8), offs[:-1], offs[1:])) if words else np.zeros(0, np.uint64)


def context_words(beside: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and log-odds of the words beside hits (``word, label``) that tell the label."""
    counted = beside.groupBy("word").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))
    counted = stored(counted, "toxic-context")
    all_toxic, all_clean, n = counted.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum("clean"), F.lit(0)), F.count(F.lit(1))).first()
    if not all_toxic or not all_clean:
        return np.zeros(0, np.uint64), np.zeros(0)
    share = float(all_toxic) / float(all_toxic + all_clean)
    rows = counted.where((F.col("toxic") + F.col("clean") >= WINDOW_DOCS) & (_sureness(share) > math.log(n) + 3)).collect()
    rows = sorted((np.int64(r.word).view(np.uint64), math.log((r.toxic + 0.5) / (r.clean + 0.5)) - math.log(share / (1 - share))) for r in rows)
    return np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], float)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    ship(docs.sparkSession)
    zero, nothing = np.zeros(FEATURES), np.zeros(0, np.uint64)
    picked = stored(labelled_sample(docs, labels, "toxic", sample).select("doc_id", "text", "label"), "toxic-sample")
    n, toxic = picked.agg(F.count(F.lit(1)), F.sum("label")).first()
    toxic = int(toxic or 0)
    none = Model(None, nothing, nothing, np.zeros(0), zero, zero + 1, np.zeros(FEATURES + 1), toxic / n if n else 0.0)
    if not n or toxic in (0, n):
        return none
    words = picked.mapInArrow(_occurrences, "word binary, label int, context long").distinct()
    counted = words.groupBy("word").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))
    counted = stored(counted, "toxic-words")
    all_toxic, all_clean = counted.agg(F.sum("toxic"), F.sum("clean")).first()
    terms = lexicon_words(counted, float(all_toxic) / (float(all_toxic) + float(all_clean)))
    if not terms:
        return none
    lexicon = Lexicon(terms)
    exempt = exempt_words(_near(counted, lexicon))
    context = context_words(picked.mapInArrow(lambda it: _beside(it, lexicon, exempt), "word long, label int"))
    model = Model(lexicon, exempt, *context, zero, zero + 1, np.zeros(FEATURES + 1), toxic / n)
    got = picked.mapInArrow(lambda it: _features(it, model), "label int, x binary").collect()
    got = sorted((r.label, bytes(r.x)) for r in got)
    x = np.frombuffer(b"".join(r[1] for r in got), float).reshape(-1, FEATURES)
    scale = x.std(0) + 1e-3
    weights = _logistic((x - x.mean(0)) / scale, np.array([r[0] for r in got], float))
    return replace(model, mean=x.mean(0), scale=scale, weights=weights)


def _near(counted: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The counted words that match the lexicon inexactly."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = lexicon.nearest([w.decode() for w in batch.column(0).to_pylist()])
            yield batch.filter(pa.array((d > 0) & (d != NONE)))

    return counted.mapInArrow(of, counted.schema)


def score(x: np.ndarray, model: Model) -> np.ndarray:
    z = (x - model.mean) / model.scale @ model.weights[:-1] + model.weights[-1]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    matcher = Matcher(model.lexicon, model.exempt) if model.lexicon is not None else None
    for batch in batches:
        for lo, hi, part, at in _chunked(batch):
            if matcher is None:
                s = np.full(hi - lo, model.base)
            else:
                s = score(features(part, at, matcher, model.context, model.context_weights), model)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(s)], ["doc_id", "score"])


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""
    ship(docs.sparkSession)
    model = learn(docs, labels, sample)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = rows.mapInArrow(lambda it: _scored(it, model), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
