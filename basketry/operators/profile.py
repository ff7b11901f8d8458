"""Column profile: counts, null share, distinct counts, top values, moments and quartiles per column.

Everything follows from one count per (column, value): rows, sample, nulls, distinct values, moments, top values,
and exact quartiles from a running count over the values in order. The counts are combined before the shuffle and
written once, so a column with few values costs next to nothing whatever the number of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.ranking import running_totals, top_n_per_group
from basketry.operators.explore import drawn
from basketry.session import require_checkpoint_dir

# The profile's default columns, top-value count and sample share.
DEFAULT_COLUMNS = ["salesrank", "total_reviews", "avg_rating"]
TOP_VALUES = 10
SAMPLE_FRACTION = 0.1

PROFILE_COLUMNS = [
    "col_name", "data_type", "count", "col_sparsity", "distinct_count", "fill_rate", "distinct_count_",
    "most_freq_values_top_10", "dataset_size", "sample_size", "mean", "stddev", "min", "q1", "q2", "q3", "max",
]


def _long(df: DataFrame, columns: list[str], drawn_col=None) -> DataFrame:
    """``col_name, value double, value_str string, _drawn boolean`` — one row per (row, profiled column);
    ``_drawn`` carries the row's sample draw to every column of the row."""
    d = F.lit(None).cast("boolean") if drawn_col is None else drawn_col
    parts = F.array(*[
        F.struct(F.lit(c).alias("col_name"), F.col(c).cast("double").alias("value"),
                 F.col(c).cast("string").alias("value_str"), d.alias("_drawn"))
        for c in columns
    ])
    return df.select(F.inline(parts))


def value_counts(df: DataFrame, columns: list[str], drawn_col=None) -> DataFrame:
    """``col_name, value, value_str, n, drawn``: rows (and sampled rows) per distinct value of each column."""
    return _long(df, columns, drawn_col).groupBy("col_name", "value", "value_str").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("_drawn").alias("drawn")
    )


def _top_of(counts: DataFrame, n: int) -> DataFrame:
    top = top_n_per_group(counts, ["col_name"], [F.desc("n"), F.asc_nulls_first("value_str")], n)
    return top.groupBy("col_name").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "value_str", "n"))),
            lambda s: F.struct(s["value_str"].alias("value"), s["n"].alias("count")),
        ).alias("most_freq_values_top_10")
    )


def top_values(df: DataFrame, columns: list[str], n: int = TOP_VALUES) -> DataFrame:
    """``col_name, most_freq_values_top_10 array<struct<value string, count bigint>>`` — the n most frequent
    values per column, null counted as a value, ties broken by the value text."""
    return _top_of(value_counts(df, columns), n)


def profile(
    df: DataFrame, columns: list[str] | None = None, sample_fraction: float | None = SAMPLE_FRACTION, seed: int = 42
) -> DataFrame:
    """One row per profiled column with the profile's 17 fields (``PROFILE_COLUMNS``).

    ``fill_rate`` and ``col_sparsity`` are percentages rounded to 2 places; ``sample_size`` counts a seeded
    Bernoulli sample of whole rows (null when ``sample_fraction`` is None); a quartile is the least value that at
    least that share of the non-null values does not exceed.
    """
    columns = columns or DEFAULT_COLUMNS
    types = {c: df.schema[c].dataType.simpleString() for c in columns}
    draw = drawn(df, sample_fraction, seed) if sample_fraction is not None else None
    require_checkpoint_dir(df.sparkSession)
    counts = value_counts(df, columns, draw).checkpoint()
    v, times = F.col("value"), F.col("n")
    known = F.when(v.isNotNull(), times)
    stats = counts.groupBy("col_name").agg(
        F.sum("n").alias("dataset_size"),
        (F.sum("drawn") if draw is not None else F.lit(None).cast("bigint")).alias("sample_size"),
        F.coalesce(F.sum(known), F.lit(0)).alias("count"),
        F.sum(F.when(v.isNull(), times).otherwise(0)).alias("_nulls"),
        F.count(v).alias("distinct_count_"),
        (F.sum(v * times) / F.sum(known)).alias("mean"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    )
    # one row per profiled column, so these joins always broadcast
    small = F.broadcast(stats.select("col_name", "count", "mean"))
    spread = counts.where(v.isNotNull()).join(small, "col_name").groupBy("col_name").agg(
        F.sqrt(F.try_divide(F.sum(times * (v - F.col("mean")) * (v - F.col("mean"))), F.max("count") - 1)).alias("stddev")
    )
    upto = running_totals(counts.where(v.isNotNull()).select("col_name", "value", "n"), ["col_name"], [v.asc()], "n", "_upto")
    quartiles = upto.join(small, "col_name").groupBy("col_name").agg(
        *[F.min(F.when(F.col("_upto") >= F.col("count") * q, v)).alias(f"q{i}") for i, q in ((1, 0.25), (2, 0.5), (3, 0.75))]
    )
    dtype = F.create_map(*[x for c in columns for x in (F.lit(c), F.lit(types[c]))])
    out = stats.join(_top_of(counts, TOP_VALUES), "col_name", "left").join(spread, "col_name", "left").join(quartiles, "col_name", "left")
    n, nulls = F.col("dataset_size"), F.col("_nulls")
    return out.select(
        "col_name",
        F.element_at(dtype, F.col("col_name")).alias("data_type"),
        "count",
        F.round(F.try_divide(nulls * F.lit(100.0), n), 2).alias("col_sparsity"),
        (F.col("distinct_count_") + F.when(nulls > 0, 1).otherwise(0)).alias("distinct_count"),
        F.when(nulls == 0, F.lit(100.0)).otherwise(F.round(F.try_divide(F.col("count") * F.lit(100.0), n), 2))
        .alias("fill_rate"),
        "distinct_count_", "most_freq_values_top_10", "dataset_size", "sample_size", "mean", "stddev", "min",
        "q1", "q2", "q3", "max",
    )
