"""Ranking helpers that never move a whole table into one partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketry.session import require_checkpoint_dir

# Fixed value: rows that one task of a shuffle holds, where the number of tasks follows the rows.
ROWS_PER_TASK = 750_000


def partitions_for(spark: SparkSession, rows: int) -> int:
    """How many tasks hold ``rows`` at ``ROWS_PER_TASK`` each; at least the session's shuffle partitions."""
    return max(-(-int(rows) // ROWS_PER_TASK), int(spark.conf.get("spark.sql.shuffle.partitions")))


def top_n_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, rank_col: str = "rank") -> DataFrame:
    """Rows ranked 1..n within each group by ``order`` (give a total order for a stable answer).

    ``row_number() <= n`` plans as WindowGroupLimit: each map task keeps at most n rows per group before the
    shuffle, so a group holding a third of the table sends n rows per task, not the whole group.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= n)


def running_totals(df: DataFrame, keys: list[str], order: list[Column], weight: str, out: str) -> DataFrame:
    """``df`` with ``out``: the sum of ``weight`` over the rows of the same ``keys`` up to this one, in ``order``.

    A plain window would move all rows of a key into one task. Here the rows are range-partitioned by (keys, order)
    and written once with the number of the range they fell into (a reliable checkpoint, so every later step sees
    the same ranges); each range's totals per key are one small row, and a running sum inside the range finishes the
    work. ``order`` must be total within a key.
    """
    require_checkpoint_dir(df.sparkSession)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *keys, *order).withColumn("_range", F.spark_partition_id()).checkpoint()
    own = [*keys, "_range"]
    totals = ranged.groupBy(*own).agg(F.sum(weight).alias("_total"))
    # a key spans at most one row per range here
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*own, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    within = F.sum(weight).over(Window.partitionBy(*own).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn("_within", within).join(offsets, own).withColumn(out, F.col("_before") + F.col("_within")).drop(
        "_range", "_within", "_before"
    )


def dense_rank_values(df: DataFrame, value: str, out: str = "rank", ascending: bool = False) -> DataFrame:
    """``(value, out)`` with ``out`` the dense rank of each distinct non-null ``value``: a running count over the
    distinct values, no range of which is ever in one task with another."""
    order = F.col(value).asc() if ascending else F.col(value).desc()
    values = df.select(value).where(F.col(value).isNotNull()).distinct().withColumns({"_all": F.lit(1), "_one": F.lit(1)})
    return running_totals(values, ["_all"], [order], "_one", out).select(value, F.col(out).cast("bigint").alias(out))
