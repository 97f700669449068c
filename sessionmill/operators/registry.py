"""Session registry as change data: what changed, when, and what ages out."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionmill import contracts as C
from sessionmill.functions.times import age_micros, micros, parse_rfc3339, render_millis
from sessionmill.operators.segments import Running, integer_segment, running

KEY = ["machine", "source", "agent_id"]
COMPARED = [
    "status", "needs_user", "current_task", "usage", "project", "git_branch", "needs_user_reason", "jump", "last_activity",
]
# Total order of the rows that a stream writes: batch, step inside the batch, row of the step.
STREAM_ORDER = ("batch_id", "phase", "arrival")


def session_key() -> Column:
    return F.concat_ws("/", *KEY)


def logical_key() -> Column:
    return F.concat_ws("/", "source", "agent_id")


def registry_changes(observed: DataFrame, order: str = "arrival", stored: DataFrame | None = None) -> DataFrame:
    """Classify every snapshot against the one before it under the same key.

    Adds ``change_type`` (new, updated, unchanged), ``status_changed``,
    ``entered_needs_you`` (rising edge; a first sighting that needs the user
    counts) and ``from_status``. ``stored`` holds the current row per key from
    earlier batches. Equal rows leave the stored row equal in every compared
    field, so the previous row and the previously stored row agree.
    """
    shown = F.struct(*[c for c in COMPARED if c in observed.columns])
    rows = observed.withColumn("__seg", integer_segment(order)).withColumn("__new", F.lit(True))
    if stored is not None:
        # a flag puts stored rows first, whatever numbers the order uses
        old = stored.select(*[c for c in observed.columns if c != order and c in stored.columns])
        rows = rows.unionByName(old.withColumn("__seg", F.lit(0).cast("bigint")).withColumn("__new", F.lit(False)), allowMissingColumns=True)
    seen = running(rows, KEY, ["__new", "__seg"], [order], __was=Running("prev", shown)).where("__new")
    was = F.col("__was")
    first = was.isNull()
    return seen.withColumns({
        "change_type": F.when(first, "new").when(was.eqNullSafe(shown), "unchanged").otherwise("updated"),
        "status_changed": first | (was["status"] != F.col("status")),
        "entered_needs_you": F.col("needs_user") & ~F.coalesce(was["needs_user"], F.lit(False)),
        "from_status": was["status"],
        "key": session_key(), "logical_key": logical_key(),
    }).drop("__seg", "__was", "__new")


def transitions(changes: DataFrame, *order: str) -> DataFrame:
    """History rows: one per status change or first sighting, with the columns that order them."""
    return changes.where((F.col("change_type") != "unchanged") & F.col("status_changed")).select(
        "key", F.col("last_activity").alias("at"), "from_status", F.col("status").alias("to_status"), *(order or ["arrival"]))


def session_history(history: DataFrame, key: str, *order: str) -> DataFrame:
    """Status history of one session, oldest first; a streamed log is ordered by ``STREAM_ORDER``."""
    return history.where(F.col("key") == key).orderBy(*(order or ["arrival"])).select("at", "from_status", "to_status")


def latest(observed: DataFrame, order: str = "arrival", keys: list[str] = KEY) -> DataFrame:
    """Newest row per key: registry state, upsert result and pre-sink compaction alike."""
    rest = [c for c in observed.columns if c not in keys]
    return (
        observed.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("w"))
        .select(*keys, *[F.col(f"w.{c}").alias(c) for c in rest])
    )


def remove_sessions(current: DataFrame, removed: DataFrame) -> DataFrame:
    return current.join(removed.select("key").distinct(), current["key"] == removed["key"], "left_anti")


# --- ageing ----------------------------------------------------------------

def is_expired(now: Column, limit: timedelta) -> Column:
    """Silent for ``limit`` or longer; an unreadable time counts as oldest."""
    last = parse_rfc3339(F.col("last_activity"))
    return last.isNull() | (age_micros(last, now) >= micros(limit))


def exempt() -> Column:
    """States that wait on the user, ended or are stale already do not turn stale."""
    return F.col("status").isin("stale", "done", "needs_you", "failed")


def mark_stale(current: DataFrame, now: Column, limit: timedelta = C.STALE_SILENCE) -> DataFrame:
    """Add ``staled`` and set the status; states that wait on the user are exempt."""
    return current.withColumn("staled", ~exempt() & is_expired(now, limit)).withColumn(
        "status", F.when(F.col("staled"), "stale").otherwise(F.col("status")))


def expired(current: DataFrame, now: Column, limit: timedelta = C.RETENTION) -> DataFrame:
    """Sessions to remove, whatever their status."""
    return current.where(is_expired(now, limit))


def retained(current: DataFrame, now: Column, limit: timedelta = C.RETENTION) -> DataFrame:
    return current.where(~is_expired(now, limit))


def housekeeping(current: DataFrame, now: Column, stale: timedelta = C.STALE_SILENCE,
                 keep: timedelta = C.RETENTION) -> DataFrame:
    """Change rows of one sweep: ``upsert`` for newly stale sessions, ``removed`` for expired ones.

    A session that is both only emits its removal. The transition of a sweep
    has no previous status and happens at ``now``.
    """
    swept = mark_stale(current, now, stale).withColumn("__gone", is_expired(now, keep))
    return (
        swept.where(F.col("__gone") | F.col("staled"))
        .withColumns({
            "event": F.when(F.col("__gone"), "removed").otherwise("upsert"),
            "key": session_key(), "logical_key": logical_key(),
            "at": F.when(~F.col("__gone"), render_millis(now)),
            "from_status": F.lit(None).cast("string"),
            "to_status": F.when(~F.col("__gone"), F.lit("stale")),
            "entered_needs_you": F.lit(False),
        }).drop("__gone", "staled")
    )
