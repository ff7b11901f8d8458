"""Category paths by trigram: a substring request finds its paths, and by them its products, without the catalogue.

Every distinct path is listed under each of its trigrams, in a partition folder for each trigram bucket. A path that
contains a text has all the text's trigrams, so the paths listed under all of them are the candidates, verified by the
text itself; their buckets of the stored catalogue x category table are then all that is read. A text shorter than a
trigram is looked for in the distinct paths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: postings of one trigram bucket.
ROWS_PER_BUCKET = 2_000_000
GRAM = 3


@dataclass(frozen=True)
class CategoryGrams:
    """``postings``: ``gram, category, cat_bucket, gram_bucket``; ``paths``: ``category, cat_bucket``."""

    postings: DataFrame
    paths: DataFrame
    buckets: int

    def containing(self, text: str) -> DataFrame:
        """``category, cat_bucket`` of the paths that contain ``text``."""
        grams = sorted({text[i : i + GRAM] for i in range(len(text) - GRAM + 1)})
        if not grams:
            return self.paths.where(F.col("category").contains(text))
        spark = self.postings.sparkSession
        asked = spark.createDataFrame([(g,) for g in grams], "gram string").select(_bucket("gram", self.buckets).alias("b")).distinct()
        rows = self.postings.where(F.col("gram_bucket").isin([r.b for r in asked.collect()]) & F.col("gram").isin(grams))
        rows = rows.where(F.col("category").contains(text))
        return rows.groupBy("category", "cat_bucket").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == len(grams)).drop("_n")


def _bucket(gram, buckets: int):
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


def store_category_grams(categories: DataFrame, path: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> CategoryGrams:
    """The index of the paths of ``categories`` (with their ``cat_bucket``) under the shared folder ``path``."""
    spark = categories.sparkSession
    paths = categories.select("category", "cat_bucket").distinct()
    paths.write.parquet(f"{path}/paths")
    paths = spark.read.schema(paths.schema).parquet(f"{path}/paths")
    grams = F.array_distinct(F.regexp_extract_all("category", F.lit(f"(?s)(?=(.{{{GRAM}}}))"), 1))
    rows = paths.select(F.explode(grams).alias("gram"), "category", "cat_bucket")
    buckets = max(1, -(-rows.count() // rows_per_bucket))
    rows = rows.withColumn("gram_bucket", _bucket("gram", buckets))
    rows.repartitionByRange("gram_bucket", "gram", "category").sortWithinPartitions("gram_bucket", "gram").write.partitionBy("gram_bucket").parquet(f"{path}/grams")
    return CategoryGrams(spark.read.schema(rows.schema).parquet(f"{path}/grams"), paths, buckets)
