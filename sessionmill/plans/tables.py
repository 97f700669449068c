"""Shared intermediate tables.

A job that reads one derived table several times writes it once to the folder
the cluster shares and goes on from there: the parse runs once, later readers
prune columns and push filters to Parquet, and a lost executor only costs the
re-read of a file. The tables go when the application ends.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
# Folder per application where the setting is absent on a local master.
_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a local one only where none is set (tests)."""
    folder = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder all executors share")
        folder = _LOCAL.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="sessionmill-"))
    return folder.rstrip("/")


_SCOPE = threading.local()


def new_folder(spark: SparkSession, name: str) -> str:
    base = getattr(_SCOPE, "folder", None) or f"{shared_folder(spark)}/sessionmill"
    return f"{base}/{name}-{uuid.uuid4().hex}"


def _hadoop(spark: SparkSession, folder: str) -> tuple:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def remove(spark: SparkSession, folder: str) -> None:
    fs, path = _hadoop(spark, folder)
    fs.delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables materialized inside (by this thread) are removed on leaving: for steps that repeat, like micro-batches."""
    before, folder = getattr(_SCOPE, "folder", None), new_folder(spark, "scratch")
    _SCOPE.folder = folder
    try:
        yield
    finally:
        _SCOPE.folder = before
        remove(spark, folder)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once, read back as a plain table scan; the folder is removed when the application ends."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    fs, folder = _hadoop(spark, path)
    fs.deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)
