"""Written intermediate tables in the shared folder named by ``spark.checkpoint.dir``.

Every multi-pass operator cuts its lineage by writing a table and reading it back, so a lost executor makes
Spark recompute one step from files, not the whole chain. A table that several passes join on the same key is
bucketed by that key: its rows are shuffled once, when written.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.session import ensure_checkpoint_dir


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever the caller's session runs them."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = os.path.join(tempfile.mkdtemp(prefix="basketry-code-"), "basketry.zip")
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "basketry")):
            for name in names:
                if name.endswith(".py"):
                    z.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), root))
    sc.addPyFile(out)
    _shipped.add(sc.applicationId)


#: Folders and tables written within each open ``steps``.
_open: list[list[str]] = []


def new_folder(spark: SparkSession, name: str) -> str:
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def steps(spark: SparkSession):
    """Deletes, at its end, what operators have written to the shared folder within it. A result is computed from what was
    written, so it has to be written elsewhere (a folder named before) or collected within as well."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            _delete(spark, path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def stored_within(df: DataFrame, name: str):
    """``stored``; the files go at the end of the block, so their last reader is to be written within."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    try:
        df.write.parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        _delete(spark, path)


#: Spark's own switch: a query's shuffle files go when the query has run.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Within it, the shuffle files of each write go when it is done, not when the driver happens to collect its garbage; the
    caller's setting holds again at its end."""
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLES_GO) if before is None else spark.conf.set(SHUFFLES_GO, before)


@contextmanager
def bucketed(df: DataFrame, key: str | list[str], name: str, compression: str | None = None):
    """``df`` as a table bucketed by ``key`` in the shared folder; joins on ``key`` then move the other side only. The table
    and its files go at the end of the block, also of one that fails, so its last reader is to be written within.
    ``compression``: Parquet's codec, by default the session's."""
    spark, keys = df.sparkSession, [key] if isinstance(key, str) else key
    table, path = f"{name}_{uuid.uuid4().hex}", new_folder(spark, name)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        out = df.repartition(n, *keys).write.bucketBy(n, *keys).format("parquet").option("path", path)
        (out.option("compression", compression) if compression else out).saveAsTable(table)
        del df, out  # held through the block, it would keep the files of its shuffles
        yield spark.table(table)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        _delete(spark, path)


def as_row(docs: DataFrame) -> DataFrame:
    """``docs`` as one column ``_row``, so that no column of it can clash with a join's own columns."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))


def of_row(column: str) -> Column:
    return F.col("_row").getField(column)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
