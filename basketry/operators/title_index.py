"""Titles by token: a request reads the postings of its own rarest tokens instead of the catalogue.

A posting holds one product under one token of its title, with all that a match returns, so a request needs no join.
Postings are stored in a partition folder for each token bucket, sorted by token and set size; a title similar to the
request has a set size between ``t * |q|`` and ``|q| / t`` and shares one of the request's ``|q| - ceil(t * |q|) + 1``
rarest tokens, whatever those are. So a request reads a few folders, of them the row groups of its tokens and sizes, and
verifies what is there. A title found under several tokens is taken at the first of them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.sets import jaccard
from basketry.operators.similarity import DEFAULT_THRESHOLD, EPS, set_of

# Fixed value: postings of one token bucket.
ROWS_PER_BUCKET = 2_000_000


def _bucket(token, buckets: int):
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def _of_tokens(rows: DataFrame, tokens: list[str], buckets: list[int]) -> DataFrame:
    """Rows of some tokens: their folders by a literal partition filter, then the tokens by file statistics."""
    return rows.where(F.col("tok_bucket").isin(sorted(set(buckets))) & F.col("tok").isin(tokens))


@dataclass(frozen=True)
class TitleIndex:
    """``postings``: every column of the products, ``toks`` (the title's set), ``n`` (its size), ``tok`` and the folder's
    ``tok_bucket``; ``counts``: ``tok, df, tok_bucket``."""

    postings: DataFrame
    counts: DataFrame
    buckets: int
    ngram: int | None = None

    def similar_titles(self, products: DataFrame, product_id, threshold: float = DEFAULT_THRESHOLD, include_self: bool = True) -> DataFrame:
        """As ``similarity.similar_titles``: the same rows and columns, from the index."""
        if not 0 < threshold <= 1:
            raise ValueError("threshold must be in (0, 1]")
        # the request's own argument: the few tokens of one title, and how often each occurs
        asked = products.where(F.col("id") == F.lit(int(product_id))).select(F.explode(set_of("title", self.ngram)).alias("tok")).distinct()
        bucket = {r.tok: r.b for r in asked.select("tok", _bucket("tok", self.buckets).alias("b")).collect()}
        if not bucket:
            return products.where(F.lit(False)).withColumn("similarity", F.lit(0.0))
        counts = {r.tok: r.df for r in _of_tokens(self.counts, list(bucket), list(bucket.values())).select("tok", "df").collect()}
        tokens = sorted(bucket, key=lambda t: (counts.get(t, 0), t))
        size = len(tokens)
        prefix = tokens[: size - math.ceil(threshold * size - EPS) + 1]
        sizes = F.col("n").between(math.ceil(threshold * size - EPS), math.floor(size / threshold + EPS))
        rows = _of_tokens(self.postings, prefix, [bucket[t] for t in prefix]).where(sizes)
        # a title under several of the prefix's tokens counts at the first of them
        once = F.array_position(F.array(*(F.lit(t) for t in prefix)), F.col("tok"))
        first = F.array_min(F.transform("toks", lambda t: F.nullif(F.array_position(F.array(*(F.lit(p) for p in prefix)), t), F.lit(0))))
        query = F.array(*(F.lit(t) for t in tokens))
        out = rows.where(once == first).withColumn("similarity", jaccard("toks", query)).where(F.col("similarity") >= F.lit(threshold))
        if not include_self:
            out = out.where(F.col("id") != F.lit(int(product_id)))
        return out.select(*products.columns, "similarity")


def store_title_index(products: DataFrame, path: str, ngram: int | None = None, rows_per_bucket: int = ROWS_PER_BUCKET) -> TitleIndex:
    """The index of ``products`` under the shared folder ``path``. Ranges of (bucket, token, size, id) are written as
    files, so a token in very many titles is several files of its bucket."""
    spark = products.sparkSession
    sets = products.withColumn("toks", set_of("title", ngram)).withColumn("n", F.size("toks"))
    buckets = max(1, -(-(sets.agg(F.sum("n")).first()[0] or 0) // rows_per_bucket))
    rows = sets.withColumn("tok", F.explode("toks")).withColumn("tok_bucket", _bucket("tok", buckets))
    order = ["tok_bucket", "tok", "n", "id"]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("tok_bucket").parquet(f"{path}/postings")
    postings = spark.read.schema(rows.schema).parquet(f"{path}/postings")
    counts = postings.groupBy("tok_bucket", "tok").agg(F.count(F.lit(1)).alias("df")).select("tok", "df", "tok_bucket")
    counts.repartition("tok_bucket").sortWithinPartitions("tok_bucket", "tok").write.partitionBy("tok_bucket").parquet(f"{path}/counts")
    return TitleIndex(postings, spark.read.schema(counts.schema).parquet(f"{path}/counts"), buckets, ngram)
