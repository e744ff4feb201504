"""Spark session settings and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
HOT_ROWS_CONF = "terralog.hotKeyRows"

_local_folders: dict[str, tempfile.TemporaryDirectory] = {}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and bench; a cluster brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("terralog")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: the cluster's own setting, or a temporary folder in local mode only.

    The temporary folder lasts as long as the Python process.
    """
    folder = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.TemporaryDirectory(prefix="terralog-", ignore_cleanup_errors=True)
    return _local_folders[app].name


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


def freeze(df: DataFrame) -> DataFrame:
    """Write the rows once as a table in the shared folder and read that.

    Every later use sees the same rows even if executors are lost, reads only the columns it needs, and the planner
    knows the table's size.
    """
    path = scratch_path(df.sparkSession, "frozen")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hot_rows(spark: SparkSession) -> int | None:
    """Rows of one key that one task may handle, if the session sets it; ordered work then goes block by block."""
    rows = spark.conf.get(HOT_ROWS_CONF, None)
    return int(rows) if rows else None
