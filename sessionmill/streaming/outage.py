"""Delivery that outlives a sink that is down: the newest payload of each key waits until the sink takes it.

Each micro-batch is reduced to one payload for each (kind, key) before anything else. What waits lies in a
:class:`KeyedTable`; a step hands the sink everything that waits with the new rows over it, and empties the
table when the sink accepts. A kind is a sort of report (sessions, usage, statistics), so a usage report never replaces
a session. The table is as large as the number of keys, however long the sink is away.

Delivery is at least once: a step that is replayed hands over the same rows under the same batch id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sessionmill.plans.tables import materialize, scratch
from sessionmill.streaming.keyed import KeyedTable

KEY = ["kind", "key"]
PAYLOAD = T.StructType([T.StructField(c, T.StringType()) for c in (*KEY, "payload")])
Deliver = Callable[[DataFrame, int], None]


class SinkDown(Exception):
    """Raised by a sink that cannot take rows now. Any other error ends the stream."""


def pending_table(spark: SparkSession, out: str) -> KeyedTable:
    return KeyedTable(spark, f"{out}/pending", PAYLOAD, KEY)


def pending(spark: SparkSession, out: str) -> DataFrame:
    """(kind, key, payload) that waits after the newest step."""
    return pending_table(spark, out).read()


def newest_payloads(rows: DataFrame, order: list[str]) -> DataFrame:
    """The last payload of each (kind, key) in ``order``; of equal places the greater payload. Null keys form a group."""
    last = F.max_by("payload", F.struct(*order, F.col("payload").alias("tie")))
    return rows.groupBy(*KEY).agg(last.alias("payload"))


def deliver_batch(spark: SparkSession, batch: DataFrame, batch_id: int, out: str, order: list[str], deliver: Deliver) -> bool:
    """One step over ``batch`` (kind, key, payload and the ``order`` columns); True when the sink took everything."""
    with scratch(spark):
        table = pending_table(spark, out)
        newest = materialize(newest_payloads(batch, order), "newest")
        same = [F.col(f"w.{c}").eqNullSafe(F.col(f"n.{c}")) for c in KEY]
        waiting = table.read(batch_id).alias("w").join(newest.alias("n"), same, "left_anti")
        try:
            deliver(waiting.select(*PAYLOAD.fieldNames()).unionByName(newest), batch_id)
        except SinkDown:
            table.write(newest.withColumn("gone", F.lit(False)), batch_id)
            return False
        nothing = newest.limit(0).withColumn("gone", F.lit(False))
        table.write(nothing, batch_id, rewrite=table.manifest(batch_id), alive=lambda rows: rows.where(F.lit(False)))
        return True


def run_delivery(rows: DataFrame, out: str, order: list[str], deliver: Deliver, trigger: dict | None = None) -> StreamingQuery:
    """Start delivery of a stream of (kind, key, payload); ``order`` names the columns of arrival order."""
    def step(batch: DataFrame, batch_id: int) -> None:
        deliver_batch(batch.sparkSession, batch, batch_id, out, order, deliver)

    return (
        rows.writeStream.foreachBatch(step)
        .option("checkpointLocation", f"{out}/_checkpoints/delivery")
        .trigger(**(trigger or {"availableNow": True})).start()
    )
