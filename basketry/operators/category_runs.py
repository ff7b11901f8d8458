"""Each category's products by score, cut at a depth: what a request with a category context needs of the catalogue.

A request asks for the ``n`` best products of several categories (score-sorted runs), its own product aside. A product's
score is the same in every run, so the threshold algorithm over these runs stops at depth ``n + 1`` of each: a product
below that in some run has ``n`` better ones in the same run, whichever one is left out. The runs are therefore
stored to a depth, sorted by it, and a request reads ``n + 1`` rows of each of its categories, not the categories.

Products that share asin and title count as one, with their best score; a run's row keeps the two best of them, so the
score without one of them is known as well. Runs exist for a whole category and for each group within it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.ranking import top_n_per_group
from basketry.functions.scores import product_score
from basketry.operators.catalog import category_bucket

# Fixed value: rows kept of each run; a request for more reads the categories themselves.
DEPTH = 100


@dataclass(frozen=True)
class CategoryRuns:
    """``rows``: ``category, by_group, group, rank, asin, title, best, cat_bucket``; ``best``: the one or two best
    products (``score, id``) of an asin and title."""

    rows: DataFrame
    buckets: int
    depth: int

    def serves(self, top_n: int) -> bool:
        return 0 <= int(top_n) < self.depth

    def candidates(self, categories: DataFrame, top_n: int, without_id: int, group: str | None = None) -> DataFrame:
        """``asin, title, score``: at least the ``top_n`` best products of ``categories`` (of one group, if given), never
        more than ``top_n + 1`` of each and their doubles; product ``without_id`` is left out."""
        wanted = categories.select("category").distinct()
        wanted = wanted.withColumn("cat_bucket", category_bucket("category", self.buckets))
        rows = self.rows.where(F.col("rank") <= F.lit(int(top_n) + 1))
        rows = rows.where(~F.col("by_group")) if group is None else rows.where(F.col("by_group") & (F.col("group") == F.lit(group)))
        rows = rows.join(wanted, ["category", "cat_bucket"], "left_semi")
        rows = rows.select("asin", "title", F.explode("best").alias("_b")).where(F.col("_b.id") != F.lit(int(without_id)))
        return rows.select("asin", "title", F.col("_b.score").alias("score"))


def store_category_runs(categories: DataFrame, buckets: int, path: str, depth: int = DEPTH) -> CategoryRuns:
    """The runs of ``categories`` (the stored catalogue x category table) under the shared folder ``path``. Every map task
    keeps ``depth`` rows a run before the shuffle, so a category that holds a third of the catalogue is as small as any."""
    best_first = [F.desc_nulls_last("score"), F.asc("id")]
    scored = categories.withColumn("score", product_score()).select("category", "cat_bucket", "group", "id", "asin", "title", "score")
    scopes = F.array(F.struct(F.lit(False).alias("by_group"), F.lit(None).cast("string").alias("group")), F.struct(F.lit(True).alias("by_group"), F.col("group")))
    scored = scored.withColumn("_s", F.explode(scopes)).select("category", "cat_bucket", "_s.*", "id", "asin", "title", "score")
    run = ["category", "cat_bucket", "by_group", "group"]
    two = top_n_per_group(scored, [*run, "asin", "title"], best_first, 2)
    pair = F.array_sort(F.collect_list(F.struct("rank", "score", "id")))
    best = two.groupBy(*run, "asin", "title").agg(F.transform(pair, lambda b: F.struct(b["score"].alias("score"), b["id"].alias("id"))).alias("best"))
    order = [F.desc_nulls_last(F.col("best")[0]["score"]), F.asc_nulls_last("asin"), F.asc_nulls_last("title")]
    rows = top_n_per_group(best, run, order, depth)
    rows = rows.select("category", "by_group", "group", F.col("rank").cast("int").alias("rank"), "asin", "title", "best", "cat_bucket")
    # the first ranks of all runs of a bucket lie together, so a small depth reads the first row groups; a bucket is one file, of
    # at most a few rows for each of its catalogue rows
    rows.repartition("cat_bucket").sortWithinPartitions("cat_bucket", "rank", "category").write.partitionBy("cat_bucket").parquet(path)
    return CategoryRuns(categories.sparkSession.read.schema(rows.schema).parquet(path), buckets, depth)
