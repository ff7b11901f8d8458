"""Exploration: group counts, correlations, null rates, review helpfulness, most frequent groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.functions.ranking import top_n_per_group


def group_by_count(df: DataFrame, group_col: str, count_col: str) -> DataFrame:
    """``group_col, count``: non-null ``count_col`` values per group (nulls of ``count_col`` not counted)."""
    return df.groupBy(group_col).agg(F.count(count_col).alias("count"))


def row_count_by(df: DataFrame, group_col: str) -> DataFrame:
    """``group_col, count``: rows per group, null group included."""
    return df.groupBy(group_col).agg(F.count(F.lit(1)).alias("count"))


def category_counts(products: DataFrame) -> DataFrame:
    """Products per category path, most frequent first (ties by path)."""
    return (
        products.select(F.explode("categories").alias("category"))
        .groupBy("category")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), F.asc("category"))
    )


def correlation(products: DataFrame) -> DataFrame:
    """One row: Pearson correlation of (salesrank, avg_rating) and of (total_reviews, avg_rating)."""
    return products.select(
        F.corr("salesrank", "avg_rating").alias("salesrank_avg_rating_corr"),
        F.corr("total_reviews", "avg_rating").alias("total_reviews_avg_rating_corr"),
    )


def null_rates(df: DataFrame) -> DataFrame:
    """``column, null_count, total, null_rate``: one aggregate pass over all columns, then unpivoted.

    A value counts as missing when null, or NaN for float and double columns.
    """
    float_types = (T.FloatType, T.DoubleType)
    missing = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        cond = c.isNull() | F.isnan(c) if isinstance(f.dataType, float_types) else c.isNull()
        missing.append(F.count_if(cond).alias(f.name))
    wide = df.agg(F.count(F.lit(1)).alias("__total"), *missing)
    long = wide.unpivot("__total", [f.name for f in df.schema.fields], "column", "null_count")
    return long.select(
        "column", "null_count", F.col("__total").alias("total"),
        F.try_divide(F.col("null_count").cast("double"), F.col("__total")).alias("null_rate"),
    )


def helpfulness(reviews: DataFrame) -> DataFrame:
    """Reviews with ``helpful_percentage = round(helpful * 100 / votes, 2)``; zero votes gives null."""
    pct = F.round(F.try_divide(F.col("helpful") * F.lit(100), F.col("votes").cast("double")), 2)
    return reviews.withColumn("helpful_percentage", pct).drop("helpful", "votes")


def misleading_share(reviews: DataFrame) -> DataFrame:
    """One row: average helpful percentage (null ratios skipped) and ``100 -`` that average."""
    avg = F.avg("helpful_percentage")
    return helpfulness(reviews).agg(
        avg.alias("avg_helpful_percentage"), (F.lit(100.0) - avg).alias("misleading_percentage")
    )


def with_review_dates(reviews: DataFrame, date_col: str = "date") -> DataFrame:
    """``updated_on``: the review date as a date (strings such as ``2000-7-28`` parse; bad text gives null)."""
    d = F.col(date_col)
    return reviews.withColumn("updated_on", d if isinstance(reviews.schema[date_col].dataType, T.DateType)
                              else F.try_to_date(d.cast("string")))


def _period_filter(reviews: DataFrame, month: int | str | None, year: int | str | None) -> DataFrame:
    r = with_review_dates(reviews)
    if month is not None:
        r = r.where(F.month("updated_on") == F.lit(int(month)))
    if year is not None:  # a date range, which file statistics can answer
        first, after = (F.make_date(F.lit(int(year) + k), F.lit(1), F.lit(1)) for k in (0, 1))
        r = r.where((F.col("updated_on") >= first) & (F.col("updated_on") < after))
    return r


def most_frequent_group(
    products: DataFrame, reviews: DataFrame | None = None, month: int | str | None = None,
    year: int | str | None = None,
) -> DataFrame:
    """The group with the most reviews in a month / year (one row; ties by group name), or with the most
    products when ``reviews`` is None."""
    if reviews is None:
        counts = row_count_by(products, "group")
    else:
        r = row_count_by(_period_filter(reviews, month, year), "id")  # reviews of one product meet it as one row
        counts = products.select("id", "group").join(r, "id").groupBy("group").agg(F.sum("count").alias("count"))
    return counts.orderBy(F.desc("count"), F.asc_nulls_last("group")).limit(1)


def most_frequent_group_per_period(products: DataFrame, reviews: DataFrame, period: str = "month") -> DataFrame:
    """For every month (or year), the group with the most reviews: ``period, group, count``.

    Reviews are counted per (product, period) before the join, so a hot product joins as a few rows; then one more
    aggregate (map-side combined) and a per-period top-1.
    """
    fn = {"month": F.month, "year": F.year}[period]
    r = with_review_dates(reviews).select("id", fn("updated_on").alias(period)).where(F.col(period).isNotNull())
    r = r.groupBy("id", period).agg(F.count(F.lit(1)).alias("count"))
    counts = products.select("id", "group").join(r, "id").groupBy(period, "group").agg(F.sum("count").alias("count"))
    top = top_n_per_group(counts, [period], [F.desc("count"), F.asc_nulls_last("group")], 1)
    return top.drop("rank")


def most_frequent_groups(products: DataFrame, reviews: DataFrame) -> DataFrame:
    """``level, period, group, count``: the group with the most reviews of every year, of every month of the year, and of
    all time, from one scan: reviews are counted per (product, year, month), meet their product once, and grouping sets
    make the three levels of the same few counts. Ties by group name; reviews without a date have no period."""
    r = with_review_dates(reviews).select("id", F.year("updated_on").alias("year"), F.month("updated_on").alias("month"))
    r = r.where(F.col("year").isNotNull()).groupBy("id", "year", "month").agg(F.count(F.lit(1)).alias("n"))
    counts = products.select("id", "group").join(r, "id").groupBy("year", "month", "group").agg(F.sum("n").alias("n"))
    group, year, month = F.col("group"), F.col("year"), F.col("month")
    sets = counts.groupingSets([[year, group], [month, group], [group]], year, month, group).agg(F.sum("n").alias("count"), F.grouping("year").alias("_y"), F.grouping("month").alias("_m"))
    level = F.when(F.col("_y") == 0, "year").when(F.col("_m") == 0, "month").otherwise("all")
    rows = sets.select(level.alias("level"), F.coalesce("year", "month", F.lit(0)).alias("period"), "group", "count")
    return top_n_per_group(rows, ["level", "period"], [F.desc("count"), F.asc_nulls_last("group")], 1).drop("rank")


def sort_by_salesrank(products: DataFrame, group: str, group_col: str = "group") -> DataFrame:
    """Products of one group, best (lowest) sales rank first; unranked products last, then by id."""
    return products.where(F.col(group_col) == F.lit(group)).orderBy(F.asc_nulls_last("salesrank"), F.asc("id"))


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Frequencies of a column: per value for strings, ``bins`` equal-width buckets for numbers.

    Numeric form: ``bucket, lower, upper, count`` from the column's min and max (scalar subqueries) and one
    grouped count.
    """
    dtype = df.schema[column].dataType
    if not isinstance(dtype, T.NumericType):
        return row_count_by(df, column).orderBy(F.desc("count"), F.asc_nulls_last(column))
    x = F.col(column).cast("double")
    lo, hi = df.agg(F.min(x)).scalar(), df.agg(F.max(x)).scalar()
    j = df.select(x.alias("_x")).where(F.col("_x").isNotNull()).select("_x", lo.alias("_lo"), hi.alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(bins)
    bucket = F.when(F.col("_hi") == F.col("_lo"), F.lit(1)).otherwise(
        F.least(F.floor((F.col("_x") - F.col("_lo")) / width) + 1, F.lit(bins))
    ).cast("int")
    counts = j.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("count"))
    # every bucket, also the empty ones; a column without values has none, one with a single value has one
    first = df.sparkSession.range(1).select(lo.alias("_lo"), hi.alias("_hi")).where(F.col("_lo").isNotNull())
    last = F.when(F.col("_hi") == F.col("_lo"), 1).otherwise(bins)
    every = first.select("_lo", "_hi", F.explode(F.sequence(F.lit(1), last)).alias("bucket"))
    return (
        every.join(counts, "bucket", "left")
        .withColumn("count", F.coalesce("count", F.lit(0)))
        .select(
            "bucket",
            (F.col("_lo") + (F.col("bucket") - 1) * (F.col("_hi") - F.col("_lo")) / F.lit(bins)).alias("lower"),
            (F.col("_lo") + F.col("bucket") * (F.col("_hi") - F.col("_lo")) / F.lit(bins)).alias("upper"),
            "count",
        )
        .orderBy("bucket")
    )


def title_set(products: DataFrame, product_id: int) -> DataFrame:
    """One row: the sorted distinct titles of one product id (the query side of the title match)."""
    return products.where(F.col("id") == F.lit(int(product_id))).agg(
        F.array_sort(F.collect_set("title")).alias("titles")
    )


def distinct_titles(products: DataFrame) -> DataFrame:
    """Distinct ``id, title`` rows of the catalogue (kept as rows, not one array, so it scales)."""
    return products.select("id", "title").distinct()


# The sample draw reads the first 8 hex digits (32 bits) of an md5 of the row's text.
SAMPLE_BUCKETS = 1 << 32
SAMPLE_SEPARATOR = "\u0001"


def _as_text(df: DataFrame, column: str) -> Column:
    """A value as text with a mark before it, an array's items between marks; no value's text is another's."""
    c = F.col(f"`{column}`")
    if isinstance(df.schema[column].dataType, T.ArrayType):
        c = F.array_join(F.transform(c, lambda x: F.concat(F.lit("="), F.coalesce(x.cast("string"), F.lit("-")))), ",")
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))


def drawn(df: DataFrame, fraction: float, seed: int, columns: list[str] | None = None) -> Column:
    """Bernoulli draw from a hash of the seed and the row's values (as text; a null is a value of its own).

    ``rand(seed)`` depends on how rows happen to be split into partitions, so the same seed can give another
    sample after a re-read or a retried task; a hash of the row repeats exactly (identical rows are drawn
    together). md5 is a standard function, so the same draw can be written in SQL.
    """
    cols = [_as_text(df, c) for c in (columns or df.columns)]
    digest = F.md5(F.concat_ws(SAMPLE_SEPARATOR, F.lit(str(int(seed))), *cols))
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return h < F.lit(int(fraction * SAMPLE_BUCKETS))


def sample(df: DataFrame, fraction: float = 0.1, seed: int = 42, columns: list[str] | None = None) -> DataFrame:
    """Bernoulli sample without replacement, repeatable for a seed whatever the partitioning."""
    return df.where(drawn(df, fraction, seed, columns))


def sample_size(df: DataFrame, fraction: float = 0.1, seed: int = 42) -> DataFrame:
    """One row: ``dataset_size`` and the size of a Bernoulli sample of it."""
    d = df.select(drawn(df, fraction, seed).alias("_drawn"))
    return d.agg(F.count(F.lit(1)).alias("dataset_size"), F.count_if("_drawn").alias("sample_size"))


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull())


def is_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def drop_null_rows(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    return df.na.drop(subset=subset)


def in_folded(column: str | Column, values: list[str]) -> Column:
    """Case-folded membership in a parameter list."""
    c = F.col(column) if isinstance(column, str) else column
    return F.lower(c).isin([v.lower() for v in values])
