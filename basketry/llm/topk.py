"""Operator 7: exact top-k inner products by norm-bucketed retrieval.

1. Vectors are quantised (floor(scale * x), 64-bit integers) and dealt by length into buckets of about
   ``BUCKET_ROWS`` vectors, longest first; the borders come from a histogram of the lengths, so buckets are ranges
   of length and one very common length is split by row. Each bucket is one stored row.
2. The queries are a stated set, taken in blocks of ``QUERY_ROWS``; a block and its bounds go to the tasks with the code,
   so a bucket is read where its file is and nothing but results is shuffled. A block first meets the bucket of the
   longest vectors; each query's k-th score there is a lower bound of its final one.
3. Then it meets all other buckets. For each query a bucket gives a local cosine threshold, bound / (|q| * longest in
   the bucket):
   * above 1 the bucket cannot hold anything better and is passed over;
   * where it leaves few candidates, coordinate pruning: only vectors whose direction lies in the feasible range of
     the query's largest coordinate go on;
   * otherwise length pruning: only vectors at least bound / |q| long go on.
   What is left is verified by integer products, which rounding cannot change. A task's bounds rise with every bucket.
4. Each task keeps k rows a query, the last grouping k in all; ties go to the smaller id.

Cases: vectors that are null or hold null, NaN or infinite components are neither queries nor candidates; vectors
of different lengths meet only their own kind; a query never meets its own row; every query row is a query of its own, also
where rows share an id, and repeated ids are separate candidates (of equal ones any comes first); fewer than k candidates
give all; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketry.llm.scratch import read_table, ship, stored

SCALE = 256
TOP = 5
QUERY_STEP = 50
QUERY_ROWS = 16_384
BUCKET_ROWS = 4096
#: Coordinate pruning pays where the cosine threshold is at least this.
LOCAL_COSINE = 0.6

FOUND = "query long, vec_id long, score long"


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``row, vec_id, v, dim, norm``: usable vectors as integers, and a number of their row."""
    x = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull())
    rows = rows.where(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    rows = rows.select("vec_id", F.transform("x", lambda c: F.floor(F.lit(float(scale)) * c).cast("long")).alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v", F.size("v").alias("dim"), F.sqrt(square).alias("norm"))


def _packed(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows of one bucket as one row: row numbers, ids and vectors, longest first."""
    pdf = pdf.sort_values(["norm", "vec_id"], ascending=[False, True])
    v = np.array(pdf["v"].tolist(), np.int64).reshape(len(pdf), -1)
    keys = {c: [pdf[c].iloc[0]] for c in ("dim", "block")}
    return pd.DataFrame({**keys, "rows": [pdf["row"].to_numpy(np.int64).tobytes()], "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "vectors": [v.tobytes()]})


def length_buckets(rows: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``dim, block, rows, ids, vectors``: candidates in buckets by length, number 0 the longest. Ranges of about 1/1024 of
    the length's order of magnitude are counted; a range's rows take the numbers that its rank among all lengths spans,
    dealt by row."""
    grain = F.floor(F.log(F.col("norm") + 1) * 1024).cast("long")
    rows = rows.withColumn("grain", grain)
    counts = rows.groupBy("dim", "grain").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("dim").orderBy(F.col("grain").desc()).rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn("before", F.coalesce(before, F.lit(0)))
    place = F.col("before") + F.pmod(F.xxhash64("row"), F.col("n"))
    dealt = rows.join(counts, ["dim", "grain"]).withColumn("block", F.floor(place / bucket_rows).cast("long"))
    dealt = dealt.select("dim", "block", "row", "vec_id", "v", "norm")
    return dealt.groupBy("dim", "block").applyInPandas(_packed, "dim int, block long, rows binary, ids binary, vectors binary")


def _best(ids: np.ndarray, scores: np.ndarray, top: int) -> np.ndarray:
    """Indexes of the ``top`` highest scores, ties to the smaller id."""
    if len(ids) > 4 * top:
        cut = np.partition(scores, len(scores) - top)[len(scores) - top]
        near = np.flatnonzero(scores >= cut)
        return near[np.lexsort((ids[near], -scores[near]))[:top]]
    return np.lexsort((ids, -scores))[:top]


class Block:
    """A block of queries of one number of components, and the best found for each so far."""

    def __init__(self, rows: np.ndarray, vectors: np.ndarray, top: int, local_cosine: float):
        self.rows, self.q, self.top, self.local_cosine = rows, vectors, top, local_cosine
        self.norm = np.sqrt((vectors.astype(float) ** 2).sum(1))
        self.bounds = np.full(len(rows), -np.inf)
        self.found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(rows)

    def copy(self) -> "Block":
        """The same queries and bounds, nothing found yet."""
        out = Block(self.rows, self.q, self.top, self.local_cosine)
        out.bounds = self.bounds.copy()
        return out

    def meet(self, rows: np.ndarray, ids: np.ndarray, c: np.ndarray) -> None:
        """Take in a bucket's vectors, longest first."""
        q = self.q
        exact = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(q.shape[1], 1) < 2.0**52
        qf, cf = (q.astype(float), c.astype(float)) if exact else (q.astype(object), c.astype(object))
        c_norm = np.sqrt((c.astype(float) ** 2).sum(1))
        direction = c.astype(float) / np.maximum(c_norm, 1e-300)[:, None]
        for i in range(len(q)):
            keep = self._candidates(i, c_norm, direction)
            keep = keep[rows[keep] != self.rows[i]]
            if not len(keep):
                continue
            scores = (cf[keep] @ qf[i]).astype(np.int64)
            keep, scores = keep[scores >= self.bounds[i]], scores[scores >= self.bounds[i]]
            ids_, scores = np.concatenate([self.found[i][0], ids[keep]]), np.concatenate([self.found[i][1], scores])
            best = _best(ids_, scores, self.top)
            self.found[i] = ids_[best], scores[best]
            if len(best) == self.top:
                self.bounds[i] = max(self.bounds[i], scores[best[-1]])

    def _candidates(self, i: int, c_norm: np.ndarray, direction: np.ndarray) -> np.ndarray:
        """What coordinate or length pruning leaves of a bucket for query ``i``."""
        if not self.bounds[i] > 0:
            return np.arange(len(c_norm))
        reach = self.bounds[i] * (1 - 1e-9)
        longest = self.norm[i] * (c_norm[0] if len(c_norm) else 0.0)
        if longest < reach:
            return np.zeros(0, np.int64)
        theta = reach / longest
        if theta < self.local_cosine:
            return np.arange(int(np.searchsorted(-c_norm * self.norm[i], -reach, "right")))
        f = int(np.abs(self.q[i]).argmax())
        a = self.q[i, f] / self.norm[i]
        spread = np.sqrt(max(0.0, 1 - theta**2)) * np.sqrt(max(0.0, 1 - a**2)) + 1e-9
        low = a * theta - spread if a > -theta else -1.0
        high = a * theta + spread if a < theta else 1.0
        return np.flatnonzero((direction[:, f] >= low) & (direction[:, f] <= high) & (self.norm[i] * c_norm >= reach))

    def result(self) -> pd.DataFrame:
        sizes = [len(f[0]) for f in self.found]
        ids, scores = (np.concatenate([f[k] for f in self.found] or [np.zeros(0, np.int64)]) for k in (0, 1))
        return pd.DataFrame({"query": np.repeat(self.rows, sizes), "vec_id": ids, "score": scores})


def _met(batches: Iterator[pd.DataFrame], blocks: dict[int, Block]) -> Iterator[pd.DataFrame]:
    """The best of a task's buckets for each query."""
    own = {dim: block.copy() for dim, block in blocks.items()}
    for pdf in batches:
        for row in pdf.itertuples(index=False):
            if row.dim in own:
                rows, ids = np.frombuffer(row.rows, np.int64), np.frombuffer(row.ids, np.int64)
                own[row.dim].meet(rows, ids, np.frombuffer(row.vectors, np.int64).reshape(len(ids), -1))
    for block in own.values():
        yield block.result()


def top_products(
    vectors: DataFrame, is_query: Column, top: int = TOP, scale: int = SCALE, bucket_rows: int = BUCKET_ROWS, local_cosine: float = LOCAL_COSINE,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query row's ``top`` highest inner products."""
    spark = vectors.sparkSession
    ship(spark)
    rows = stored(quantised(vectors, scale), "quantised")
    buckets = stored(length_buckets(rows, bucket_rows), "length-buckets")
    queries = rows.where(is_query)
    n = max(1, -(-queries.count() // query_rows))
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    for k in range(n):  # a block of queries is bounded; each is one pass over the buckets
        asked = queries.where(F.pmod(F.xxhash64("row"), F.lit(n)) == k).select("row", "vec_id", "v", "dim").collect()
        if not asked:
            continue
        blocks = {}
        for dim in sorted({r.dim for r in asked}):
            own = [r for r in asked if r.dim == dim]
            blocks[dim] = Block(np.array([r.row for r in own]), np.array([r.v for r in own], np.int64).reshape(len(own), -1), top, local_cosine)
        first = buckets.where("block = 0").mapInPandas(lambda it, b=blocks: _met(it, b), FOUND)
        first = stored(first, "first-bucket")
        kth = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
        known = first.withColumn("rank", F.row_number().over(kth)).where(F.col("rank") == top).select("query", "score").collect()
        known = {r.query: r.score for r in known}
        for block in blocks.values():
            block.bounds = np.array([known.get(r, -np.inf) for r in block.rows.tolist()], float)
        rest = buckets.where("block > 0").mapInPandas(lambda it, b=blocks: _met(it, b), FOUND)
        ranked = first.unionByName(rest).withColumn("rank", F.row_number().over(kth)).where(F.col("rank") <= top)
        ranked = ranked.join(queries.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id")), "query")
        ranked = ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
        out = out.unionByName(stored(ranked, "ranked") if n > 1 else ranked)
    return out


def op7_topk_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_STEP == 0)


OP7_SQL = """
WITH usable AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id % 50 = 0 AND c.row <> q.row AND len(c.v) = len(q.v)
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM scored
) WHERE rank <= 5
"""
