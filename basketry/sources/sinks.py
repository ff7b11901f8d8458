"""Sinks: JSON rows, the property graph as parquet, the profile table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_json_rows(df: DataFrame) -> DataFrame:
    """One JSON object string per row (``value``), built on the executors."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value"))


def response_rows(df: DataFrame, message: str = "recommendations") -> DataFrame:
    """The service envelope ``{success, message, data}`` as one column per field, one row per record; the
    caller streams it (``write_json``) rather than collecting the data array on the driver."""
    return to_json_rows(df).select(
        F.lit(True).alias("success"), F.lit(message).alias("message"), F.col("value").alias("data")
    )


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_graph(vertex_df: DataFrame, edge_df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Vertices as parquet; edges as parquet partitioned by label (a label filter prunes files)."""
    vertex_df.write.mode(mode).parquet(f"{path}/vertices")
    edge_df.write.mode(mode).partitionBy("label").parquet(f"{path}/edges")


def write_profile(profile_df: DataFrame, path: str, mode: str = "overwrite") -> None:
    profile_df.write.mode(mode).parquet(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
