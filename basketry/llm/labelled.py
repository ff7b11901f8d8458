"""Bounded samples of labelled rows for the classifiers (operators 3, 4 and 10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows with crc32(doc_id as text) mod 5 = 0 are never learned from.
FOLDS = 5
_SPAN = 1 << 53


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def _draw(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns, F.lit(17)), F.lit(_SPAN))


def bounded_sample(rows: DataFrame, bound: int, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """About ``bound`` rows (all different ones, if there are no more), drawn by a hash of the columns ``by``, so a retried
    task and a second run draw the same; column ``draw`` orders them. Rows that agree in ``by`` are one row, so many of
    them can neither fill nor burst the bound."""
    n = rows.count()
    drawn = rows.withColumn("draw", _draw(*by))
    return (drawn if n <= bound else drawn.where(F.col("draw") < int(_SPAN * (bound / n)))).dropDuplicates(["draw"])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """``doc_id, text, label, draw`` of about ``bound`` labelled documents outside the held-out fold. Only ids and
    labels are sent to all tasks, at most 1.2 x ``bound`` of them, so the texts are not shuffled before they are few. An
    id that has several labels counts with the largest, one that has several texts with the one that hashes least."""
    rows = labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("label"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    ids = bounded_sample(rows.groupBy("doc_id").agg(F.max("label").alias("label")), bound, ["doc_id"])
    ids = ids.orderBy("draw", "doc_id").limit(bound + bound // 5)
    text = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = text.where(~held_out(F.col("doc_id"))).join(F.broadcast(ids), "doc_id")
    return found.groupBy("doc_id", "label", "draw").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "label", "draw")
