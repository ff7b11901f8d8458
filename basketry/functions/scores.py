"""Product scores used to rank recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The constants of the recommenders' product score.
SALESRANK_SCALE = 10_000_000.0
REVIEWS_SCALE = 100.0


def product_score(
    salesrank: str | Column = "salesrank",
    total_reviews: str | Column = "total_reviews",
    avg_rating: str | Column = "avg_rating",
) -> Column:
    """``((1e7 - salesrank) / 1e7 + total_reviews / 100 + avg_rating) / 3``; null when any input is null."""
    s, t, a = (F.col(c) if isinstance(c, str) else c for c in (salesrank, total_reviews, avg_rating))
    return ((F.lit(SALESRANK_SCALE) - s) / F.lit(SALESRANK_SCALE) + t / F.lit(REVIEWS_SCALE) + a) / F.lit(3.0)


def with_normalised_score(df: DataFrame, out: str = "score") -> DataFrame:
    """Max-normalised score ``(salesrank / max + total_reviews / max + avg_rating) / 3`` over ``df``.

    The two maxima are scalar subqueries: computed once by a global (map-side combined) aggregate and used
    as values in the projection, with no join.
    """
    max_rank = df.agg(F.max("salesrank")).scalar()
    max_reviews = df.agg(F.max("total_reviews")).scalar()
    score = (
        F.try_divide(F.col("salesrank"), max_rank)
        + F.try_divide(F.col("total_reviews"), max_reviews)
        + F.col("avg_rating")
    ) / F.lit(3.0)
    return df.withColumn(out, score)
