"""Operator 3: language of a text by string kernels, Nystroem landmarks and one-versus-rest kernel ridge regression.

* Kernel: blended-spectrum presence. A text's set holds its byte n-grams of 1 to 4 bytes (A-Z and the accented capitals of Latin-1 lowered), hashed to
  ``SLOTS`` slots; two texts' kernel value is the size of the sets' intersection over the geometric mean of their
  sizes.
* Landmarks: the first ``LANDMARKS`` texts of a sample of at most about ``SAMPLE`` labelled rows (a documented
  bound; only the sample's slot bits reach the driver). With W = U S U' the landmarks' kernel matrix,
  K(x, landmarks) U S^(-1/2) are a text's features.
* Ridge regression to +1 / -1 for each language. All of this folds into one matrix, so scoring a block of texts
  is two matrix products: presence x landmarks, kernel values x languages.

``score`` is (1 + the best language's regression value) / 2, cut to 0..1. Texts that are null or without a letter
are ``und`` with score 0; so is every text if no row has a language to learn from. Ties go to the language that
sorts first. Repeated rows are scored each, in the sample equal rows are one; a very long text is one row of its block;
rows without ``doc_id`` are learned from and scored; an empty table gives no rows; other columns are ignored.

``accepted`` keeps the texts that are written in one of the learned languages. A text is not if its score is below what
texts of its size have: for each size class (the binary order of magnitude of its set of n-grams) the floor is the score
that all but ``REJECTED`` of the sample's texts of the class reach, less ``MARGIN``. A class with fewer than
``CLASS_TEXTS`` sample texts, as those of a few words, has no floor: too little is known to reject there. Without a model
every text with a letter stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm.hashing import LOWER, chunks, text_buffer
from basketry.llm.labelled import bounded_sample, held_out
from basketry.llm.scratch import read_table, ship

LONGEST = 4
SLOTS = 1 << 15
LANDMARKS = 192
SAMPLE = 4000
RIDGE = 1e-2
BLOCK_ROWS = 256
UNKNOWN = "und"
REJECTED, MARGIN, CLASS_TEXTS = 0.002, 0.02, 100

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def presence(part: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows of slots: which n-grams each document has."""
    low = LOWER[part].astype(np.uint32)
    if len(part):
        low[1:][(part[:-1] == 0xC3) & (part[1:] >= 0x80) & (part[1:] <= 0x9E)] += 32  # capitals with accents
    seen = np.zeros((len(at) - 1, SLOTS), bool)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    left = np.repeat(at[1:], np.diff(at)) - np.arange(len(part))  # bytes from here to the document's end
    gram = np.zeros(len(part), np.uint32)
    for n in range(1, LONGEST + 1):
        m = len(part) - n + 1
        if m <= 0:
            break
        gram = gram[:m] * np.uint32(0x01000193) + low[n - 1 :] + np.uint32(n)
        mixed = gram * np.uint32(0x9E3779B1)
        slot = (mixed ^ (mixed >> np.uint32(15))) & np.uint32(SLOTS - 1)
        ok = left[:m] >= n
        seen[row[:m][ok], slot[ok]] = True
    return seen


def _blocks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    buf, offs = text_buffer(texts)
    for lo, hi, part, at in chunks(buf, offs):
        for a in range(0, hi - lo, BLOCK_ROWS):
            b = min(a + BLOCK_ROWS, hi - lo)
            yield lo + a, lo + b, part[at[a] : at[b]], at[a : b + 1] - at[a]


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, part, at in _blocks(batch.column(1)):
            bits = [r.tobytes() for r in np.packbits(presence(part, at), axis=1)]
            yield pa.RecordBatch.from_arrays([batch.column(2).slice(lo, hi - lo), batch.column(3).slice(lo, hi - lo), pa.array(bits, pa.binary())], ["lang", "draw", "bits"])


@dataclass
class Model:
    languages: list[str]
    slots: np.ndarray  # slots that any landmark has
    landmarks: np.ndarray  # float32, slots x landmarks, divided by the root of each landmark's size
    weights: np.ndarray  # landmarks x languages
    bias: np.ndarray
    floors: np.ndarray  # least score of an accepted text, by size class


def kernel(seen: np.ndarray, slots: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    size = np.sqrt(np.maximum(seen.sum(1), 1))[:, None]
    return seen[:, slots].astype(np.float32) @ landmarks / size


def size_class(seen: np.ndarray) -> np.ndarray:
    """Binary order of magnitude of each text's set."""
    return np.log2(np.maximum(seen.sum(1), 1)).astype(int)


def fit(bits: list[bytes], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    names = sorted(set(langs))

    def rows(a, b):
        return np.unpackbits(np.frombuffer(b"".join(bits[a:b]), np.uint8).reshape(-1, SLOTS // 8), axis=1).astype(bool)

    marks = rows(0, min(landmarks, len(bits)))
    slots = np.flatnonzero(marks.any(0))
    scaled = (marks[:, slots] / np.sqrt(np.maximum(marks.sum(1), 1))[:, None]).astype(np.float32).T
    k = np.concatenate([kernel(rows(a, a + BLOCK_ROWS), slots, scaled) for a in range(0, len(bits), BLOCK_ROWS)]).astype(float)
    values, vectors = np.linalg.eigh(k[: len(marks)])
    keep = values > 1e-6 * values[-1]
    root = vectors[:, keep] / np.sqrt(values[keep])
    z = np.concatenate([k @ root, np.ones((len(k), 1))], axis=1)
    y = np.where(np.array(langs)[:, None] == np.array(names)[None], 1.0, -1.0)
    w = np.linalg.solve(z.T @ z + ridge * len(z) * np.diag([1.0] * keep.sum() + [0.0]) + 1e-9 * np.eye(z.shape[1]), z.T @ y)
    scores = (1 + (z @ w).max(1)) / 2
    classes = np.concatenate([size_class(rows(a, a + BLOCK_ROWS)) for a in range(0, len(bits), BLOCK_ROWS)])
    floors = np.zeros(SLOTS.bit_length() + 1)
    for c in range(1, len(floors)):
        own = scores[classes == c]
        floors[c] = np.quantile(own, REJECTED) - MARGIN if len(own) >= CLASS_TEXTS else floors[c - 1]
    return Model(names, slots, scaled, (root @ w[:-1]).astype(np.float32), w[-1].astype(np.float32), floors)


def learn(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model from rows outside the held-out fold that have a language and a text; None if there is none."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    drawn = bounded_sample(rows, sample, ("doc_id", "text", "lang")).mapInArrow(_bits, "lang string, draw long, bits binary")
    got = drawn.orderBy("draw", "lang").limit(sample + sample // 5).collect()
    return fit([bytes(r.bits) for r in got], [r.lang for r in got]) if got else None


def _has_letter(part: np.ndarray, at: np.ndarray) -> np.ndarray:
    count = np.concatenate([[0], np.cumsum(_LETTER[part])])
    out = count[at[1:]] > count[at[:-1]]
    for r in np.flatnonzero(~out & (at[1:] > at[:-1])):
        out[r] = any(map(str.isalpha, part[at[r] : at[r + 1]].tobytes().decode()))
    return out


def _predict(batches: Iterator[pa.RecordBatch], model: Model | None, text_at: int, first: int) -> Iterator[pa.RecordBatch]:
    """The columns from ``first`` on, and what column ``text_at`` is written in."""
    for batch in batches:
        for lo, hi, part, at in _blocks(batch.column(text_at)):
            pred, score = [UNKNOWN] * (hi - lo), np.zeros(hi - lo)
            rows = np.flatnonzero(_has_letter(part, at)) if model is not None else []
            if len(rows):
                f = kernel(presence(part, at), model.slots, model.landmarks) @ model.weights + model.bias
                best = f.argmax(1)
                for r in rows:
                    pred[r], score[r] = model.languages[best[r]], (1 + f[r, best[r]]) / 2
            yield pa.RecordBatch.from_arrays(
                [c.slice(lo, hi - lo) for c in batch.columns[first:]] + [pa.array(pred), pa.array(np.clip(score, 0, 1).astype(float))],
                [*batch.schema.names[first:], "lang_pred", "score"],
            )


def with_language(docs: DataFrame, model: Model | None, kept: list[str]) -> DataFrame:
    """The ``kept`` columns of ``docs``, then ``lang_pred`` and ``score`` (these names are taken)."""
    ship(docs.sparkSession)
    schema = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double")
    if "text" in kept:
        return docs.select(*kept).mapInArrow(lambda it: _predict(it, model, kept.index("text"), 0), schema)
    return docs.select("text", *kept).mapInArrow(lambda it: _predict(it, model, 0, 1), schema)


def _kept(batches: Iterator[pa.RecordBatch], model: Model | None, text_at: int) -> Iterator[pa.RecordBatch]:
    """The rows whose text, column ``text_at``, is accepted."""
    for batch in batches:
        for lo, hi, part, at in _blocks(batch.column(text_at)):
            ok = _has_letter(part, at)
            if model is not None and ok.any():
                seen = presence(part, at)
                best = (kernel(seen, model.slots, model.landmarks) @ model.weights + model.bias).max(1)
                ok &= (1 + best) / 2 >= model.floors[size_class(seen)]
            block = batch.slice(lo, hi - lo)
            yield block if ok.all() else block.filter(pa.array(ok))


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """The documents written in a learned language, all columns as they were; each text is sent to a worker once."""
    ship(docs.sparkSession)
    text_at = docs.columns.index("text")
    named = docs.toDF(*(f"_kept_{i}" for i in range(len(docs.columns))))  # names that can't clash
    return named.mapInArrow(lambda it: _kept(it, model, text_at), named.schema).toDF(*docs.columns)


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    named = with_language(rows, learn(docs, sample), ["doc_id"])
    return named.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read_table(spark, sf_dir, "documents"))
