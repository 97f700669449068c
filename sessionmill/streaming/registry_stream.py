"""Registry over a stream of snapshots: one ``foreachBatch`` step per trigger.

The live sessions lie in a :class:`KeyedTable`. A step reads the buckets of the keys that arrived and of those in which
a session falls due, classifies the batch against the stored rows, runs the housekeeping sweep over what falls due, and
writes changes, transitions, fired alerts and the rows that changed. All folders are named by batch id, and the time a
step runs at is written before anything else, so a replayed batch rewrites the same result.

A step also runs when only a clock tick arrives (``ticks``), so sessions turn stale and leave on a silent stream.

Feed and history rows carry a total order (``registry.STREAM_ORDER``): batch,
phase (usage reports, changes, the sweep, an opening state last), row.

A step can carry usage reports too: a machine's report goes to the feed when its content differs from the stored one. The cards that
a reader of the whole feed would show are a table by logical key which each step updates, so no reader folds the
feed. The feed may be kept for a number of steps only; ``follow`` gives a reader behind them a fresh full state.

Intermediate tables go at the end of each step.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sessionmill import contracts as C
from sessionmill.functions.times import micros, parse_rfc3339
from sessionmill.operators import alerts, entities, feed, registry, reports, views
from sessionmill.plans.tables import materialize, scratch
from sessionmill.streaming.keyed import KeyedTable
from sessionmill.streaming.sinks import expire_versions, oldest_version, read_log, step_time, wall_clock, write_batch

SESSIONS = T.StructType(C.SNAPSHOT.fields)
FIRED = T.StructType([T.StructField("logical_key", T.StringType()), T.StructField("fired_at", T.TimestampType())])
ALERTS = T.StructType([*FIRED.fields, *[T.StructField(c, T.StringType()) for c in ("key", "source", "project", "machine", "needs_user_reason", "title", "body")]])
_PLACE = [T.StructField("phase", T.IntegerType()), T.StructField("arrival", T.LongType())]
HISTORY = T.StructType([*[T.StructField(c, T.StringType()) for c in ("key", "at", "from_status", "to_status")], *_PLACE])
FEED = T.StructType([
    *SESSIONS.fields, *[T.StructField(c, T.StringType()) for c in ("event", "key", "logical_key")], *_PLACE, T.StructField("report", C.USAGE_REPORT)])
CARDS = T.StructType([T.StructField("logical_key", T.StringType()), T.StructField("key", T.StringType()), *SESSIONS.fields])
REPORTED, CHANGED, SWEPT, OPENING = 0, 1, 2, 3


def number_arrivals(batch: DataFrame, *order: str) -> DataFrame:
    """Unique increasing ``arrival`` in the given order; range partitions keep it distributed."""
    return batch.orderBy(*order).withColumn("arrival", F.monotonically_increasing_id())


def due_at(stale: timedelta, keep: timedelta) -> Column:
    """Instant in microseconds at which the sweep has something to do with a session; one without a readable time is due at once."""
    at = F.unix_micros(parse_rfc3339(F.col("last_activity")))
    return F.coalesce(F.least(at + micros(keep), F.when(~registry.exempt(), at + micros(stale))), F.lit(0))


def session_table(spark: SparkSession, out: str, stale: timedelta = C.STALE_SILENCE, keep: timedelta = C.RETENTION) -> KeyedTable:
    return KeyedTable(spark, f"{out}/sessions", SESSIONS, registry.KEY, due=F.when(~F.col("gone"), due_at(stale, keep)))


def fire_table(spark: SparkSession, out: str) -> KeyedTable:
    """Last fire of each logical session."""
    return KeyedTable(spark, f"{out}/last_fired", FIRED, ["logical_key"], fold=lambda rows: rows.groupBy("logical_key").agg(F.max("fired_at").alias("fired_at")))


def report_table(spark: SparkSession, out: str) -> KeyedTable:
    """Newest usage report of each machine."""
    return KeyedTable(spark, f"{out}/reports", C.USAGE_REPORT, ["machine"])


def card_table(spark: SparkSession, out: str) -> KeyedTable:
    """The card of each logical session that the feed so far folds to."""
    return KeyedTable(spark, f"{out}/cards", CARDS, ["logical_key"])


def _report_step(spark: SparkSession, arrived: DataFrame, batch_id: int, out: str) -> DataFrame:
    """Store the newest reports of a step, return the changed ones as feed rows."""
    table, fields = report_table(spark, out), C.USAGE_REPORT.fieldNames()
    stored = materialize(table.read(batch_id, table.buckets_of(arrived)), "reports")
    both = stored.withColumn("arrival", F.lit(-1).cast("bigint")).unionByName(arrived.select(*fields, "arrival"))
    changed = reports.changed_reports(both, "arrival").where("arrival >= 0")
    table.write(reports.newest_per_machine(arrived.select(*fields, "arrival"), "arrival").withColumn("gone", F.lit(False)), batch_id)
    return feed.usage_rows(changed.withColumn("phase", F.lit(REPORTED)))


def _card_step(spark: SparkSession, batch_id: int, out: str) -> None:
    """Bring the cards up to the feed rows of this step."""
    table = card_table(spark, out)
    step = spark.read.schema(FEED).parquet(f"{out}/feed/batch_id={batch_id}").where(F.col("event") != "usage")
    shown = table.read(batch_id, table.buckets_of(step)).join(step.select("logical_key").distinct(), "logical_key", "left_semi")
    table.write(feed.next_cards(shown.select(*CARDS.fieldNames()), step, "phase", "arrival"), batch_id)


def edges_of(changes: DataFrame, at: str, order: str = "arrival") -> DataFrame:
    """One row per logical session and instant at which some machine began to need the user (the last such row)."""
    kept = ["key", "source", "project", "machine", "needs_user_reason"]
    rows = changes.where("entered_needs_you").groupBy("logical_key", F.col(at).alias("alert_at"))
    return rows.agg(F.max_by(F.struct(*kept), order).alias("w")).select("logical_key", "alert_at", "w.*")


def apply_batch(
    spark: SparkSession,
    batch: DataFrame,
    batch_id: int,
    out: str,
    now: Column,
    stale: timedelta = C.STALE_SILENCE,
    keep: timedelta = C.RETENTION,
    cooldown: timedelta = C.ALERT_COOLDOWN,
    arrived_reports: DataFrame | None = None,
    retain: int | None = None,
) -> None:
    """One registry step. ``batch``: snapshot columns plus ``arrival`` and ``received_at``.

    ``arrived_reports``: usage reports with ``arrival``. ``retain``: steps of the feed that stay (by default all, at least two).
    """
    with scratch(spark):
        _apply(spark, batch, batch_id, out, now, stale, keep, cooldown, arrived_reports)
    if retain is not None:
        expire_versions(spark, f"{out}/feed", batch_id, max(2, retain))


def _apply(spark, batch, batch_id, out, now, stale, keep, cooldown, arrived_reports) -> None:
    columns = [f.name for f in SESSIONS.fields]
    live, fires = session_table(spark, out, stale, keep), fire_table(spark, out)
    instant = spark.range(1).select(F.unix_micros(now)).first()[0]
    touched, due = live.buckets_of(batch), live.due_by(instant, batch_id)
    arrived = batch.select(*registry.KEY).distinct()
    stored = materialize(live.read(batch_id, touched).join(arrived, registry.KEY, "left_semi").select(*columns), "stored")

    # every later step reads the classified batch; write it once
    changes = materialize(registry.registry_changes(batch, stored=stored).withColumn("phase", F.lit(CHANGED)), "changes")
    visible = changes.where(F.col("change_type") != "unchanged")
    merged = stored.withColumn("place", F.lit(None).cast("bigint")).unionByName(visible.select(*columns, F.col("arrival").alias("place")))
    newest = registry.latest(merged.withColumn("place", F.struct(F.col("place").isNotNull().alias("moved"), "place")), "place").select(*columns, "place.moved")
    others = live.read(batch_id, due).join(arrived, registry.KEY, "left_anti").select(*columns, F.lit(False).alias("moved"))
    seen = materialize(newest.unionByName(others), "seen")
    sweep = materialize(number_arrivals(registry.housekeeping(seen.drop("moved"), now, stale, keep), "key").withColumn("phase", F.lit(SWEPT)), "sweep")
    rows = feed.change_feed(changes, sweep)
    if arrived_reports is not None:
        rows = rows.unionByName(_report_step(spark, arrived_reports, batch_id, out), allowMissingColumns=True)
    write_batch(rows, f"{out}/feed", batch_id)
    _card_step(spark, batch_id, out)
    swept = sweep.where(F.col("event") == "upsert").select("key", "at", "from_status", "to_status", "phase", "arrival")
    write_batch(registry.transitions(changes, "phase", "arrival").unionByName(swept), f"{out}/transitions", batch_id)

    edges = materialize(edges_of(changes, "received_at"), "edges")
    earlier = fires.read(batch_id, fires.buckets_of(edges))
    fired = materialize(alerts.throttle(edges, cooldown, last_fired=earlier), "fired")
    told = views.alert_view(edges.join(fired, ["logical_key", "alert_at"])).withColumnRenamed("alert_at", "fired_at")
    write_batch(told.select(*[f.name for f in ALERTS.fields]), f"{out}/alerts", batch_id)
    # a fire matters as long as an alert of a later batch can fall into its cooldown; rows arrive in time order by batch
    oldest = F.coalesce(F.unix_micros(batch.agg(F.min("received_at")).scalar()), F.lit(instant))
    fires.write(fired.withColumnRenamed("alert_at", "fired_at"), batch_id,
                alive=lambda rows: rows.where(F.unix_micros("fired_at") + micros(cooldown) > oldest))

    aged = materialize(registry.mark_stale(seen, now, stale).withColumn("gone", registry.is_expired(now, keep)), "aged")
    opened = aged.where(~F.col("gone")).withColumn("bucket", live.bucket()).groupBy("bucket").agg(F.min(due_at(stale, keep)).alias("due"))
    # in the buckets that were due every row was looked at
    looked = dict.fromkeys(due) | {r["bucket"]: r["due"] for r in opened.where(F.col("bucket").isin(list(due))).collect()} if due else {}
    live.write(aged.where(F.col("moved") | F.col("staled") | F.col("gone")), batch_id, due=looked)


TICK, REPORT = "__tick", "__report"


def clock_ticks(spark: SparkSession) -> DataFrame:
    """A tick for each second of a running query; its trigger interval decides how often the sweep looks."""
    return spark.readStream.format("rate").option("rowsPerSecond", 1).load().select(F.col("timestamp").alias("now"))


def run_registry(
    snapshots: DataFrame,
    out: str,
    order: list[str],
    clock: Callable[[DataFrame], DataFrame] = wall_clock,
    trigger: dict | None = None,
    ticks: DataFrame | None = None,
    usage: DataFrame | None = None,
    retain: int | None = None,
    **limits: timedelta,
) -> StreamingQuery:
    """Start the registry stream; ``order`` names the columns that give arrival order inside a trigger, ``clock`` makes
    the one row of a step's time from its batch.

    ``ticks``: a stream of instants (``now``), such as :func:`clock_ticks`. Steps then run without new snapshots as well, and
    no step's time lies before its newest tick. ``usage``: a stream of usage reports with the ``order`` columns. ``retain``: steps of
    the feed that stay.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with scratch(spark):
            arrived = materialize(batch, "arrived")
            rows, told = arrived, None
            if usage is not None:
                told = rows.where(F.col(REPORT).isNotNull()).select(f"{REPORT}.*", *order)
                told = materialize(number_arrivals(told, *order).select(*C.USAGE_REPORT.fieldNames(), "arrival"), "reports")
                rows = rows.where(F.col(REPORT).isNull()).drop(REPORT)
            if ticks is not None:
                rows = rows.where(F.col(TICK).isNull()).drop(TICK)
            numbered = materialize(number_arrivals(rows, *order), "arrivals")

            def time(df: DataFrame) -> DataFrame:
                if ticks is None:
                    return clock(df)
                return spark.range(1).select(F.greatest(clock(df).scalar(), arrived.agg(F.max(TICK)).scalar()).alias("now"))

            apply_batch(spark, numbered, batch_id, out, step_time(numbered, batch_id, out, time), arrived_reports=told, retain=retain, **limits)

    if ticks is not None:
        snapshots = snapshots.unionByName(ticks.select(F.col("now").alias(TICK)), allowMissingColumns=True)
    if usage is not None:
        packed = usage.select(F.struct(*C.USAGE_REPORT.fieldNames()).alias(REPORT), *order)
        snapshots = snapshots.unionByName(packed, allowMissingColumns=True)
    return (
        snapshots.writeStream.foreachBatch(step)
        .option("checkpointLocation", f"{out}/_checkpoints/registry")
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def sessions(spark: SparkSession, out: str) -> DataFrame:
    """Live sessions after the newest step."""
    return session_table(spark, out).read()


def history(spark: SparkSession, out: str) -> DataFrame:
    """All status changes with their place in ``registry.STREAM_ORDER``."""
    return read_log(spark, f"{out}/transitions", HISTORY)


def opening(spark: SparkSession, out: str, overlap: timedelta = C.OVERLAP_WINDOW) -> DataFrame:
    """What a reader gets first: the logical sessions of the newest version as full rows, and each machine's report, behind its batch."""
    version = session_table(spark, out).version()
    newest = -1 if version is None else version
    merged = entities.logical_sessions(sessions(spark, out), overlap).drop("logical_key")
    at = {"batch_id": F.lit(newest).cast("bigint"), "phase": F.lit(OPENING), "arrival": F.lit(0).cast("bigint")}
    told = report_table(spark, out).read(newest + 1)
    return feed.full_state(merged, **at).unionByName(feed.usage_rows(told, **at), allowMissingColumns=True)


def cards(spark: SparkSession, out: str) -> DataFrame:
    """The cards after the newest step, as a reader of the whole feed would show them."""
    return card_table(spark, out).read()


def read_feed(spark: SparkSession, out: str, after: int = -1) -> DataFrame:
    """Feed rows of the batches after ``after``; a late reader takes ``opening`` and goes on from its batch."""
    return read_log(spark, f"{out}/feed", FEED).where(F.col("batch_id") > after)


def follow(spark: SparkSession, out: str, after: int | None = None) -> DataFrame:
    """Feed rows for a reader that has seen the batches up to ``after`` (None: nothing yet).

    If rows it has not seen are no longer kept, it gets a fresh full state and what follows that.
    """
    low = oldest_version(spark, f"{out}/feed")
    if after is not None and (low is None or after + 1 >= low):
        return read_feed(spark, out, after)
    version = session_table(spark, out).version()
    later = read_feed(spark, out, -1 if version is None else version)
    return opening(spark, out).unionByName(later, allowMissingColumns=True)
