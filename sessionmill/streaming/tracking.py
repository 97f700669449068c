"""Continuous session tracking over landed transcript chunks.

One streaming query parses each line once. A step reduces its records to partial facts, calls and messages (the batch
operators' aggregates with the place of each newest value) and adds them to keyed tables; buckets are merged when they have grown, and
files that have been silent for the retention leave. A snapshot reads the tables at its own ``now``, so time decay needs no timer.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sessionmill import contracts as C
from sessionmill.functions.times import micros
from sessionmill.operators import facts as FA
from sessionmill.operators import registry
from sessionmill.operators import usage as U
from sessionmill.operators.records import parse_records
from sessionmill.plans.tables import materialize, scratch
from sessionmill.sources.transcripts import hook_events
from sessionmill.streaming.keyed import BUCKETS, KeyedTable
from sessionmill.streaming.sinks import append_log, expire_versions, newest_version, read_log, step_time, wall_clock, write_batch


def log_records(lines: DataFrame, out: str, trigger: dict | None = None) -> StreamingQuery:
    """Parse each landed line once into an appended record table under ``out``; usage events, increments, blocks and
    reports of any cadence are the batch operators over :func:`logged_records`."""
    return (
        parse_records(lines).writeStream.foreachBatch(append_log(f"{out}/records"))
        .option("checkpointLocation", f"{out}/_checkpoints/records")
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def logged_records(spark: SparkSession, out: str) -> DataFrame:
    return read_log(spark, f"{out}/records", C.RECORDS).drop("batch_id")


@dataclass(frozen=True)
class TrackingState:
    """Newest facts, calls and messages as DataFrames, and the prompts that reached a transcript."""

    facts: DataFrame
    calls: DataFrame
    messages: DataFrame
    delivered: DataFrame | None

    def snapshots(self, machine: Column, now: Column) -> DataFrame:
        full = FA.with_pending(self.facts, self.calls)
        prompts = None if self.delivered is None else FA.unanswered(self.delivered, full)
        return FA.snapshots(full, FA.session_usage(full, self.messages), prompts, machine, now)


def live_calls(records: DataFrame) -> DataFrame:
    """Call states on a stream. A call without a time counts as the oldest one."""
    return FA.call_states(records.withColumn(
        "since", F.when(F.col("opens"), F.coalesce("ts", F.timestamp_seconds(F.lit(0))))))


def _facts_of(records: DataFrame, landed: Column) -> DataFrame:
    return FA.partial_facts(records).withColumn("landed", landed)


def _merged(rows: DataFrame) -> DataFrame:
    landed = rows.groupBy("file", "source").agg(F.max("landed").alias("landed"))
    return FA.merge_facts(rows).join(landed, ["file", "source"])


BUFFERED = "session_id string, prompt string, prompt_ts timestamp"
DELIVERED = "session_id string, file string, prompt string, prompt_ts timestamp"
INDEX = "session_id string, file string, landed timestamp"
HOOK = "__hook"


class Tables:
    """The state of the tracking stream: keyed tables that take partial rows and merge them when a bucket is written anew.

    ``keep``: a file leaves the state (facts, calls, messages, last total) when it has been silent for so long; one that never told
    a time counts from its landing. ``slack`` rounds that up, so that a bucket is not written anew for each file that leaves.
    """

    def __init__(self, spark: SparkSession, out: str, keep: timedelta = C.RETENTION, slack: timedelta = timedelta(0), buckets: int = BUCKETS):
        def table(name: str, schema: T.StructType | str, keys: list[str], by: str, **how) -> KeyedTable:
            schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
            return KeyedTable(spark, f"{out}/{name}", schema, keys, [by], buckets=buckets, **how)

        none = spark.createDataFrame([], C.RECORDS)
        seen = F.unix_micros(F.coalesce("last_activity", "landed")) + micros(keep)
        step = max(1, micros(slack))
        self.leaves = F.ceil(seen / step).cast("long") * step if slack else seen
        facts = _facts_of(none, F.current_timestamp()).schema
        self.facts = table("facts", facts, ["file", "source"], "file", due=self.leaves, fold=_merged)
        self.calls = table("calls", live_calls(none).schema, ["file", "call_id"], "file", fold=FA.merge_calls)
        self.messages = table("messages", U.placed_messages(none).schema, ["file", "message_id"], "file", fold=U.merge_messages)
        self.totals = table("totals", U.last_totals(none).schema, ["file"], "file")
        self.of_files = [self.facts, self.calls, self.messages, self.totals]
        # which files name a session; a file that left is still found here until its last landing is as old
        self.index = table("index", INDEX, ["session_id", "file"], "session_id", due=F.unix_micros("landed") + micros(keep),
                           fold=lambda rows: rows.groupBy("session_id", "file").agg(F.max("landed").alias("landed")))
        # a prompt waits for its transcript for the buffer time, a delivered one is held as long as a session
        self.buffered = table("buffered", BUFFERED, ["session_id"], "session_id", due=F.unix_micros("prompt_ts") + micros(C.PROMPT_TTL))
        self.delivered = table("delivered", DELIVERED, ["session_id", "file"], "session_id", due=F.unix_micros("prompt_ts") + micros(keep))


def _step(spark: SparkSession, records: DataFrame, hooks: DataFrame | None, batch_id: int, out: str, instant: int, tables: Tables) -> None:
    now = F.timestamp_micros(F.lit(instant))
    files = tables.facts.buckets_of(records.select("file").distinct())
    before = tables.totals.read(batch_id, files)
    partial = materialize(_facts_of(records, now), "partial")
    silent = tables.facts.buckets_of(partial.where(tables.leaves <= instant))  # arrived too late, unless other records say more
    anew = set().union(*(t.full_buckets(batch_id) for t in tables.of_files), tables.facts.due_by(instant, batch_id), silent)
    tables.facts.write(partial, batch_id, anew, lambda rows: rows.where(tables.leaves > instant))
    left = tables.facts.read(batch_id + 1, anew).select("file").distinct()
    stay = lambda rows: rows.join(left, "file", "left_semi")
    jobs = [
        lambda: tables.calls.write(live_calls(records), batch_id, anew, stay),
        lambda: tables.messages.write(U.placed_messages(records), batch_id, anew, stay),
        lambda: tables.totals.write(U.last_totals(records).withColumn("gone", F.lit(False)), batch_id, anew, stay),
        lambda: write_batch(U.usage_deltas(records, stored=before), f"{out}/usage_deltas", batch_id),
    ]
    # the rest of the step is independent of each other
    with ThreadPoolExecutor(len(jobs)) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]
        if hooks is not None:
            _deliver(spark, records, hooks, batch_id, instant, tables)
        for job in running:
            job.result()


def _deliver(spark: SparkSession, records: DataFrame, hooks: DataFrame, batch_id: int, instant: int, tables: Tables) -> None:
    """Hooks of the step change the buffer; then buffered prompts whose transcript is known are delivered, once."""
    last, index = FA.newest_hooks(hooks), tables.index
    named = records.where(F.col("session_id").isNotNull()).select("session_id", "file", F.timestamp_micros(F.lit(instant)).alias("landed")).distinct()
    ends = index.full_buckets(batch_id) | index.due_by(instant, batch_id)
    index.write(named, batch_id, ends, lambda x: x.where(index.due > instant))
    moved = materialize(last.select("session_id").unionByName(named.select("session_id")).distinct(), "moved")
    late = tables.buffered.due_by(instant, batch_id)
    waiting = tables.buffered.read(batch_id, tables.buffered.buckets_of(moved) | late).select("*", F.lit(None).cast("string").alias("kind"))
    heard = last.select("session_id", F.col("hook.message").alias("prompt"), F.col("hook.received_at").alias("prompt_ts"), F.col("hook.kind").alias("kind"))
    # the step's newest hook replaces what was buffered
    buffer = materialize(heard.unionByName(waiting.join(heard, "session_id", "left_anti")), "buffer")
    prompts = buffer.where("kind IS NULL OR kind = 'prompt'").drop("kind")
    places = index.read(batch_id + 1, index.buckets_of(prompts)).join(prompts.select("session_id").distinct(), "session_id", "left_semi")
    places = materialize(places.select("file").distinct(), "places")
    known = FA.finish_facts(tables.facts.read(batch_id + 1, tables.facts.buckets_of(places))).join(places, "file", "left_semi")
    sent = materialize(FA.delivered_prompts(prompts, known), "sent")

    over = F.unix_micros("prompt_ts") + micros(C.PROMPT_TTL) <= instant
    found = sent.select("session_id", F.lit(True).alias("found")).distinct()
    after = buffer.join(found, "session_id", "left").withColumn("gone", F.coalesce("found", F.lit(False)) | (F.coalesce("kind", F.lit("")) == "resolution") | over)
    changed = materialize(after.where(F.col("kind").isNotNull() | F.col("gone")), "changed")
    open_ = after.where(~F.col("gone")).withColumn("bucket", tables.buffered.bucket()).groupBy("bucket").agg(F.min("prompt_ts").alias("first"))
    looked = dict.fromkeys(late) | {r["bucket"]: r["due"] for r in open_.select("bucket", (F.unix_micros("first") + micros(C.PROMPT_TTL)).alias("due")).collect() if r["bucket"] in late}
    tables.buffered.write(changed, batch_id, due=looked)

    answered = last.where("hook.kind = 'resolution'").select("session_id")
    old = tables.delivered.read(batch_id, tables.delivered.buckets_of(answered)).join(answered, "session_id", "left_semi")
    rows = sent.withColumn("gone", F.lit(False)).unionByName(old.withColumn("gone", F.lit(True)))
    ends = tables.delivered.full_buckets(batch_id) | tables.delivered.due_by(instant, batch_id)
    tables.delivered.write(rows, batch_id, ends, lambda x: x.where(tables.delivered.due > instant))


def track(
    lines: DataFrame,
    out: str,
    hooks: DataFrame | None = None,
    trigger: dict | None = None,
    clock: Callable[[DataFrame], DataFrame] = wall_clock,
    **limits: timedelta,
) -> list[StreamingQuery]:
    """Start the tracking query; its tables, logs and checkpoint live under ``out``.

    One query reads each line once: a step merges partial facts, calls and messages into keyed tables, appends the increments
    of cumulative totals to the log ``usage_deltas`` and, with ``hooks``, delivers prompts. ``trigger`` defaults to everything that
    has landed (``availableNow``); ``clock`` makes the one row of a step's time from its records (column ``__hook``: hook events);
    ``limits`` are those of :class:`Tables`.
    """
    rows = parse_records(lines)
    if hooks is not None:
        rows = rows.unionByName(hook_events(hooks).select(F.struct("session_id", "kind", "message", "received_at", "ord").alias(HOOK)), allowMissingColumns=True)

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with scratch(spark):
            arrived = materialize(batch, "arrived")
            now = step_time(arrived, batch_id, f"{out}/tracking", clock)
            instant = spark.range(1).select(F.unix_micros(now)).first()[0]
            told = None if hooks is None else arrived.where(F.col(HOOK).isNotNull()).select(f"{HOOK}.*")
            records = arrived if hooks is None else arrived.where(F.col(HOOK).isNull()).drop(HOOK)
            _step(spark, records, told, batch_id, out, instant, Tables(spark, out, **limits))

    return [
        rows.writeStream.foreachBatch(step)
        .option("checkpointLocation", f"{out}/_checkpoints/tracking")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    ]


def event_clock(batch: DataFrame) -> DataFrame:
    """Step time by the data: the newest activity or receive time of the step."""
    times = [F.max("active_ts")] + ([F.max(f"{HOOK}.received_at")] if HOOK in batch.columns else [])
    return batch.agg(F.greatest(*times, F.lit(datetime(1970, 1, 1, tzinfo=timezone.utc))).alias("now"))


def tracked(spark: SparkSession, out: str, hooks: bool = False) -> TrackingState:
    """State as of the newest step of :func:`track`; ``hooks`` if it reads any."""
    tables = Tables(spark, out)
    facts = FA.finish_facts(tables.facts.read()).drop("landed")
    return TrackingState(facts, tables.calls.read(), tables.messages.read().drop("at"), tables.delivered.read() if hooks else None)


def usage_increments(spark: SparkSession, out: str) -> DataFrame:
    """Increments of cumulative totals that :func:`track` has written so far."""
    schema = U.usage_deltas(spark.createDataFrame([], C.RECORDS)).schema
    return read_log(spark, f"{out}/usage_deltas", schema).drop("batch_id")


SHOWN = ["status", "current_task", "usage", "last_activity", "needs_user"]


def emit_changed(spark: SparkSession, out: str, snapshots: DataFrame, sweep: int) -> DataFrame:
    """One sweep over the snapshots of a moment: those that show something else than at the sweep before.

    Several files of one session are compacted to the most recently active one first. Changed rows are appended to
    ``out/changed``, what is shown now becomes the next version of ``out/shown``; a repeated sweep rewrites both.
    """
    columns = [f.name for f in C.SNAPSHOT.fields]
    schema = T.StructType(C.SNAPSHOT.fields)
    now = registry.latest(snapshots.select(*columns), "last_activity").select(*columns)
    with scratch(spark):
        now = materialize(now, "shown")
        version = newest_version(spark, f"{out}/shown", sweep)
        before = spark.createDataFrame([], schema) if version is None else spark.read.schema(schema).parquet(f"{out}/shown/batch_id={version}")
        before = before.select(*registry.KEY, F.struct(*SHOWN).alias("__was"))
        changed = now.join(before, registry.KEY, "left").where(~F.struct(*SHOWN).eqNullSafe(F.col("__was"))).select(*columns)
        write_batch(changed, f"{out}/changed", sweep)
        write_batch(now, f"{out}/shown", sweep)
    expire_versions(spark, f"{out}/shown", sweep)
    return spark.read.schema(schema).parquet(f"{out}/changed/batch_id={sweep}")
