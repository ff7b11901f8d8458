"""Readers: the multi-line product dump, plain text, and the tab-separated co-purchase edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.functions import fields

# The dump's record separator (a line starting "Id:") and the record prefix it consumes.
RECORD_SEPARATOR = "\nId:"
RECORD_PREFIX = "Id:"


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Line text scan: ``value string`` per line."""
    return spark.read.text(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Multi-line record scan: one ``value`` string per product record.

    The reader splits on ``\\nId:`` itself, so records that straddle file splits are read once, by the task
    that owns their start. The separator eats the ``Id:`` of every record but a file's first, so it is put
    back; a preamble before the first record does not start with ``Id:`` + digits and is dropped. CRLF files
    work because the ``\\r`` stays at the end of each line and is trimmed by the field extractors.
    """
    return clean_records(spark.read.option("lineSep", RECORD_SEPARATOR).text(path))


def clean_records(raw: DataFrame) -> DataFrame:
    """Restore each record's ``Id:`` prefix and drop a preamble (trailing line breaks are harmless: every
    field pattern is anchored to its own line)."""
    value = F.when(F.col("value").startswith(RECORD_PREFIX), F.col("value")).otherwise(
        F.concat(F.lit(RECORD_PREFIX), F.col("value"))
    )
    return raw.select(value.alias("value")).where(F.col("value").rlike(fields.ID_PATTERN + r"[ \t]*(\r?\n|$)"))


def parse_products(records: DataFrame) -> DataFrame:
    """Typed product table from record strings (one ``select``, built-in expressions only)."""
    v = F.col("value")
    parsed = records.select(
        fields.extract(v, fields.ID_PATTERN).try_cast("bigint").alias("id"),
        fields.extract(v, fields.ASIN_PATTERN).alias("asin"),
        fields.extract(v, fields.TITLE_PATTERN).alias("title"),
        fields.extract(v, fields.GROUP_PATTERN).alias("group"),
        fields.extract(v, fields.SALESRANK_PATTERN).try_cast("double").alias("salesrank"),
        fields.extract(v, fields.TOTAL_REVIEWS_PATTERN).try_cast("bigint").alias("total_reviews"),
        fields.extract(v, fields.AVG_RATING_PATTERN).try_cast("double").alias("avg_rating"),
        fields.similars(v).alias("similars"),
        fields.categories(v).alias("categories"),
    )
    return parsed.select("*", *fields.category_columns(F.col("categories")))


def parse_reviews(records: DataFrame) -> DataFrame:
    """Long review table: one row per review line, ``id, date, customer, rating, votes, helpful``.

    The review lines are found in one pass over each record and exploded; each line is then parsed on its
    own. ``explode_outer`` plus a null filter keeps the optimizer from adding a ``size(...) > 0`` filter
    that it would push below the projection and so scan every record twice.
    """
    v = F.col("value")
    lines = records.select(
        fields.extract(v, fields.ID_PATTERN).try_cast("bigint").alias("id"),
        F.explode_outer(fields.review_lines(v)).alias("_line"),
    ).where(F.col("_line").isNotNull())
    return lines.select("id", *fields.review_fields(F.col("_line")))


def read_products(spark: SparkSession, path: str) -> DataFrame:
    return parse_products(read_records(spark, path))


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    return parse_reviews(read_records(spark, path))


def read_edge_list(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated ``src<TAB>dst`` lines, ``#`` comments skipped, explicit schema (no inference pass)."""
    return spark.read.csv(path, sep="\t", comment="#", schema="src bigint, dst bigint")


def undirected_edges(edge_list: DataFrame) -> DataFrame:
    """Canonical undirected weighted edges from a directed list: ``src < dst``, repeated pairs counted."""
    return (
        edge_list.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))
        .groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        .agg(F.count(F.lit(1)).alias("weight"))
    )
