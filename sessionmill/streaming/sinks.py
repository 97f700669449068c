"""Idempotent Parquet sinks for ``foreachBatch``: a replayed batch replaces its own folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionmill.plans.tables import remove


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def append_log(path: str) -> Callable[[DataFrame, int], None]:
    """Sink that keeps every batch as ``path/batch_id=N``."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, path, batch_id)
    return sink


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_log(spark: SparkSession, path: str, schema: T.StructType, before: int | None = None) -> DataFrame:
    """Rows of all batches with their ``batch_id``; empty when nothing was written yet."""
    full = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    if not _exists(spark, path):
        return spark.createDataFrame([], full)
    log = spark.read.schema(full).option("basePath", path).parquet(path)
    return log if before is None else log.where(F.col("batch_id") < before)


def write_note(spark: SparkSession, path: str, batch_id: int, text: str) -> None:
    """A short text as version ``batch_id`` of ``path``, whole or not at all; no job runs for it."""
    folder = f"{path}/batch_id={batch_id}"
    fs, note = _file(spark, f"{folder}/note")
    out = fs.create(note, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    fs.create(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS"), True).close()


def read_note(spark: SparkSession, path: str, batch_id: int) -> str:
    fs, note = _file(spark, f"{path}/batch_id={batch_id}/note")
    stream = fs.open(note)
    text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return text


def _file(spark: SparkSession, path: str) -> tuple:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def newest_version(spark: SparkSession, path: str, before: int) -> int | None:
    """Greatest batch folder below ``before`` (folder names only, no data)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    ids = [int(n.split("=", 1)[1]) for n in names if n.startswith("batch_id=")]
    ids = [i for i in ids if i < before and fs.exists(
        spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch_id={i}/_SUCCESS"))]
    return max(ids, default=None)


def oldest_version(spark: SparkSession, path: str) -> int | None:
    """Smallest batch folder (folder names only, no data)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return min((int(n.split("=", 1)[1]) for n in names if n.startswith("batch_id=")), default=None)


def expire_versions(spark: SparkSession, path: str, newest: int, keep: int = 2) -> None:
    """Remove versions that no replay can ask for: all below the ``keep`` newest up to ``newest``."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    ids = sorted(int(n.split("=", 1)[1]) for n in (f.getPath().getName() for f in fs.listStatus(p)) if n.startswith("batch_id="))
    for i in [i for i in ids if i <= newest][:-keep]:
        remove(spark, f"{path}/batch_id={i}")


def wall_clock(batch: DataFrame) -> DataFrame:
    return batch.sparkSession.range(1).select(F.current_timestamp().alias("now"))


def step_time(batch: DataFrame, batch_id: int, out: str, clock: Callable[[DataFrame], DataFrame] = wall_clock) -> Column:
    """The time of a step: taken once, read again on replay."""
    spark, path = batch.sparkSession, f"{out}/clock"
    if newest_version(spark, path, batch_id + 1) != batch_id:
        write_batch(clock(batch).toDF("now"), path, batch_id)
        expire_versions(spark, path, batch_id)
    return F.timestamp_micros(F.lit(spark.read.parquet(f"{path}/batch_id={batch_id}").select(F.unix_micros("now")).first()[0]))
