"""Operator 10: document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Every passage is measured (``FEATURES`` numbers: kinds of
characters, word shapes, repetition), encoded by a learned layer, and weighted by gated attention: the softmax
over the document's passages of w . (tanh(V h) * sigmoid(U h)). The weighted sum of the encodings is the document's
representation, which a logistic layer scores. Only document labels are learned from, on a sample of at most
about ``SAMPLE`` labelled documents (a documented bound); the measures of all their passages reach the driver, no text.
Scoring is one pass of block matrix products over whole texts.

Cases: a null or empty text, or one of white space, is one passage of zeros; without any label of both kinds every
score is the share of label 1 (0.5 if there is none); repeated rows are scored each; an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm.hashing import LOWER, chunks, span_hashes, text_buffer, word_spans
from basketry.llm.labelled import held_out, labelled_sample
from basketry.llm.scratch import read_table, ship

PASSAGE = 64
SAMPLE = 6000
HIDDEN, ATTENTION = 16, 8
EPOCHS, RATE, DECAY = 150, 0.02, 1e-4
CUT = 0.3


def _kinds() -> np.ndarray:
    """Byte -> kind: 0 white space, 1 lower, 2 upper, 3 digit, 4 sentence mark, 5 '!', 6 '|', 7 other symbol, 8 line
    break, 9 part of a character beyond ASCII, 10 control."""
    kind = np.full(256, 7, np.int64)
    kind[:32] = kind[127] = 10
    kind[[9, 11, 12, 13, 32]] = 0
    kind[10] = 8
    kind[97:123], kind[65:91], kind[48:58] = 1, 2, 3
    kind[[ord(c) for c in ".,;:?'\"-()"]] = 4
    kind[ord("!")], kind[ord("|")] = 5, 6
    kind[128:] = 9
    return kind


_KIND = _kinds()
_N_KINDS = 11
FEATURES = _N_KINDS + 10


def passages(part: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Measures of every passage of a chunk, and the index of each document's first passage (and the end)."""
    starts, ends, first = word_spans(part, at)
    words = np.diff(first)
    count = np.maximum(1, -(-words // PASSAGE))
    border = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(count)), count)
    begin = first[doc] + PASSAGE * (np.arange(border[-1]) - border[doc])
    end = np.minimum(begin + PASSAGE, first[doc + 1])
    x = np.zeros((len(begin), FEATURES), np.float32)
    full = np.flatnonzero(end > begin)
    if not len(full):
        return x, border
    a, b = begin[full], end[full]
    n = (b - a).astype(np.float32)
    lo, hi = starts[a], ends[b - 1]
    kind = _KIND[part]
    for k in range(_N_KINDS):
        upto = np.concatenate([[0], np.cumsum(kind == k)])
        x[full, k] = (upto[hi] - upto[lo]) / (hi - lo)

    def share(of_word: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0.0], np.cumsum(of_word, dtype=np.float64)])
        return (upto[b] - upto[a]) / n

    size = ends - starts
    hashes = span_hashes(LOWER[part], starts, ends)
    f = _N_KINDS
    x[full, f] = mean = share(np.minimum(size, 64)) / 10
    x[full, f + 1] = np.sqrt(np.maximum(share(np.minimum(size, 64) ** 2) / 100 - mean**2, 0))
    same = np.zeros(len(hashes))
    same[1:] = hashes[1:] == hashes[:-1]
    x[full, f + 2] = share(same)
    x[full, f + 3] = share(kind[starts] == 2)
    x[full, f + 4] = share((kind[starts] == 2) & (kind[np.maximum(ends - 1, 0)] == 2) & (size > 1))
    x[full, f + 5] = share(kind[ends - 1] == 4)
    x[full, f + 6] = share(np.isin(kind[ends - 1], (5, 6, 7)))
    x[full, f + 7] = share(size == 1)
    piece = np.repeat(np.arange(len(full)), b - a)  # passages cover all words in order
    order = np.lexsort((hashes, piece))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (piece[order][1:] != piece[order][:-1])
    x[full, f + 8] = np.bincount(piece[order][new], minlength=len(full)) / n
    x[full, f + 9] = np.log1p(n) / 4
    return x, border


class Model:
    """Encoder, gated attention and scorer; ``learn`` fits all three by Adam on whole bags."""

    def __init__(self, base: float = 0.5):
        r = np.random.default_rng(7)
        self.base = base
        self.mean, self.scale = np.zeros(FEATURES), np.ones(FEATURES)
        self.p: dict[str, np.ndarray] | None = {
            "E": r.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)), "e": np.zeros(HIDDEN),
            "V": r.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)), "U": r.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)),
            "w": r.normal(0, ATTENTION**-0.5, ATTENTION), "c": r.normal(0, HIDDEN**-0.5, HIDDEN), "d": np.zeros(1),
        }

    def _forward(self, x: np.ndarray, border: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        h = np.tanh(x @ p["E"] + p["e"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        s = (t * g) @ p["w"]
        bag = np.repeat(np.arange(len(border) - 1), np.diff(border))
        a = np.exp(s - np.maximum.reduceat(s, border[:-1])[bag])
        a /= np.add.reduceat(a, border[:-1])[bag]
        z = np.add.reduceat(a[:, None] * h, border[:-1], axis=0)
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "bag": bag, "y": 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))}

    def score(self, x: np.ndarray, border: np.ndarray) -> np.ndarray:
        if self.p is None:
            return np.full(len(border) - 1, self.base)
        return self._forward(np.clip((x - self.mean) / self.scale, -8, 8), border)["y"]

    def learn(self, x: np.ndarray, border: np.ndarray, y: np.ndarray) -> "Model":
        self.base = float(y.mean()) if len(y) else 0.5
        if not len(y) or y.min() == y.max():
            self.p = None
            return self
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, EPOCHS + 1):
            p, f = self.p, self._forward(x, border)
            dy = (f["y"] - y) / len(y)
            dz = dy[:, None] * p["c"]
            grad = {"c": f["z"].T @ dy, "d": np.array([dy.sum()])}
            da = (dz[f["bag"]] * f["h"]).sum(1)
            ds = f["a"] * (da - np.add.reduceat(f["a"] * da, border[:-1])[f["bag"]])
            grad["w"] = (f["t"] * f["g"]).T @ ds
            dt = ds[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2)
            dg = ds[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
            grad["V"], grad["U"] = f["h"].T @ dt, f["h"].T @ dg
            dh = (f["a"][:, None] * dz[f["bag"]] + dt @ p["V"].T + dg @ p["U"].T) * (1 - f["h"] ** 2)
            grad["E"], grad["e"] = x.T @ dh, dh.sum(0)
            for k in p:
                g = grad[k] + DECAY * p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v2[k] = 0.999 * v2[k] + 0.001 * g * g
                p[k] = p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)
        return self


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Measures of every passage of each sampled document."""
    for batch in batches:
        buf, offs = text_buffer(batch.column(1))
        for lo, hi, part, at in chunks(buf, offs):
            x, border = passages(part, at)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array([x[a:b].tobytes() for a, b in zip(border[:-1], border[1:])], pa.binary())],
                ["doc_id", "label", "x"],
            )


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    ship(docs.sparkSession)
    got = labelled_sample(docs, labels, label, sample).select("doc_id", "text", "label")
    got = sorted(got.mapInArrow(_measured, "doc_id long, label int, x binary").collect(), key=lambda r: (r.doc_id, r.label, bytes(r.x)))
    bags = [np.frombuffer(r.x, np.float32).reshape(-1, FEATURES) for r in got]
    border = np.concatenate([[0], np.cumsum([len(b) for b in bags])]).astype(np.int64)
    x = np.concatenate(bags).astype(float) if bags else np.zeros((0, FEATURES))
    return Model().learn(x, border, np.array([r.label for r in got], float))


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offs = text_buffer(batch.column(1))
        for lo, hi, part, at in chunks(buf, offs):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), pa.array(model.score(*passages(part, at)).astype(float))], ["doc_id", "score"]
            )


def scored(docs: DataFrame, labels: DataFrame, cut: float = CUT, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""
    ship(docs.sparkSession)
    model = learn(docs, labels, "quality", sample)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = rows.mapInArrow(lambda it: _scored(it, model), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
