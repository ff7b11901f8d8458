"""Session helpers for tests, the bench and local runs.

Library functions never build a session: they take DataFrames from the caller. These helpers exist so
tests and ``bench.py`` start Spark the same way, and so iterative operators find a reliable checkpoint
folder.
"""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cpus: int | str = "*", partitions: int = 8, app: str = "basketry") -> SparkSession:
    """A local session with AQE on and the web UI off."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BASKETRY_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder the cluster names, if any."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF, None)
    if conf:
        spark.sparkContext.setCheckpointDir(conf)
        return spark.sparkContext.getCheckpointDir()
    return None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the session's checkpoint folder; only a local-mode session that names none (tests, local runs) gets a
    scratch folder, which goes when the process ends. On a cluster a machine-local folder would not survive a lost
    executor, so it is an error."""
    current = checkpoint_dir(spark)
    if current:
        return current
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        return require_checkpoint_dir(spark)
    scratch = tempfile.mkdtemp(prefix="basketry-ckpt-")
    atexit.register(shutil.rmtree, scratch, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(scratch)
    return spark.sparkContext.getCheckpointDir()


def require_checkpoint_dir(spark: SparkSession) -> str:
    """Iterative operators cut lineage with reliable checkpoints, never machine-local ones."""
    current = checkpoint_dir(spark)
    if not current:
        raise RuntimeError(
            f"set {CHECKPOINT_CONF} (a shared folder) or call SparkContext.setCheckpointDir before running "
            "an iterative operator"
        )
    return current
