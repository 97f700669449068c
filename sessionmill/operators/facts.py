"""Per-file session facts as mergeable aggregates.

Everything here is ``max_by``/``max``/``sum``/``count_if`` over the record
table, so partial aggregation runs before the shuffle (a file with a third of
all rows costs one partial row per map task) and the same code serves batch
and streaming.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionmill import contracts as C
from sessionmill.functions.times import age_micros, micros, render_millis
from sessionmill.operators.segments import Running, running

# Lines per segment of one landed chunk; bounds the rows of one window task.
SEGMENT_LINES = 1 << 16
SEGMENT = ["seq", "cut"]


def with_segment(records: DataFrame) -> DataFrame:
    return records.withColumn("cut", F.floor(F.col("line") / F.lit(SEGMENT_LINES)).cast("bigint"))


def order_key() -> Column:
    return F.struct("seq", "line", "pos")


def newest(col: str | Column, order: Column | None = None) -> Column:
    """Newest non-null value in file order."""
    col = F.col(col) if isinstance(col, str) else col
    return F.max_by(col, F.when(col.isNotNull(), order_key() if order is None else order))


# Fact: the record column whose newest value it is.
NEWEST = {c: c for c in (
    "session_id", "cwd", "git_branch", "repository_url", "originator", "model", "approval_policy",
    "interrupted", "finished", "stop", "todos", "total", "last_total_tokens", "context_window", "rate_limits",
)} | {"last_tokens": "tokens"}


def _clocks_and_counters() -> list[Column]:
    return [
        F.max("active_ts").alias("last_activity"),
        F.min("active_ts").alias("first_activity"),
        F.max(F.when(F.col("clears"), order_key())).alias("cleared_at"),
        F.count_if(F.col("pos") == -1).alias("lines"),
        F.count_if(F.col("parse_error")).alias("parse_errors"),
        F.count_if(F.col("sidechain")).alias("sidechain_records"),
    ]


def session_facts(records: DataFrame) -> DataFrame:
    """One row per file: metadata, flags, counters, gauges and clocks."""
    return records.groupBy("file", "source").agg(*[newest(c).alias(name) for name, c in NEWEST.items()], *_clocks_and_counters())


def partial_facts(records: DataFrame) -> DataFrame:
    """Facts of some of a file's records, each newest value with its place (``at``), to be merged by :func:`merge_facts`."""
    placed = [newest(F.when(F.col(c).isNotNull(), F.struct(order_key().alias("at"), F.col(c).alias("value")))).alias(name) for name, c in NEWEST.items()]
    return records.groupBy("file", "source").agg(*placed, *_clocks_and_counters())


def merge_facts(partials: DataFrame) -> DataFrame:
    """One partial row per file from several."""
    return partials.groupBy("file", "source").agg(
        *[newest(name, F.col(f"{name}.at")).alias(name) for name in NEWEST],
        F.max("last_activity").alias("last_activity"), F.min("first_activity").alias("first_activity"), F.max("cleared_at").alias("cleared_at"),
        *[F.sum(c).alias(c) for c in ("lines", "parse_errors", "sidechain_records")])


def finish_facts(merged: DataFrame) -> DataFrame:
    """Merged partial rows as :func:`session_facts` gives them."""
    return merged.select(*[F.col(f"{c}.value").alias(c) if c in NEWEST else F.col(c) for c in merged.columns])


def with_call_starts(records: DataFrame) -> DataFrame:
    """Add ``since`` to call rows: record time, else last activity, else the epoch.

    Only files that hold a call without a time need the running clock, so only
    those are scanned in order.
    """
    undated = F.coalesce(F.col("opens"), F.lit(False)) & F.col("ts").isNull()
    files = records.where(undated).select("file").distinct()
    clocked = with_segment(
        records.join(files, "file", "left_semi").where(undated | F.col("active_ts").isNotNull())
    )
    odd = (
        running(clocked, ["file"], SEGMENT, ["seq", "line", "pos"], since=Running("max", F.col("active_ts")))
        .where(undated)
        .withColumn("since", F.coalesce("since", F.timestamp_seconds(F.lit(0))))
        .drop("cut")
    )
    usual = records.where(~undated).withColumn("since", F.when(F.col("opens"), F.col("ts")))
    return usual.unionByName(odd)


def call_states(records: DataFrame) -> DataFrame:
    """One row per (file, call id): newest open and close and what was opened."""
    calls = records.where(F.col("call_id").isNotNull())
    return calls.groupBy("file", "call_id").agg(
        F.max(F.when(F.col("opens"), order_key())).alias("opened_at"),
        F.max(F.when(~F.col("opens"), order_key())).alias("closed_at"),
        newest(F.when(F.col("opens"), F.struct("call_name", "call_label", "since"))).alias("call"),
    )


def merge_calls(states: DataFrame) -> DataFrame:
    """:func:`call_states` of a file's records from those of some of them."""
    return states.groupBy("file", "call_id").agg(
        F.max("opened_at").alias("opened_at"), F.max("closed_at").alias("closed_at"), newest("call", F.col("opened_at")).alias("call"))


def call_task(name: Column, label: Column) -> Column:
    return F.when(label.isNotNull(), F.concat(name, F.lit(": "), label)).otherwise(name)


def todo_task(todos: Column) -> Column:
    """First entry in progress: its active form, else its content."""
    going = F.filter(todos, lambda t: t["status"] == "in_progress")
    first = F.try_element_at(going, F.lit(1))
    return F.coalesce(first["active_form"], first["content"])


def open_calls(calls: DataFrame, facts: DataFrame) -> DataFrame:
    """Calls still pending: opened after their own close and after the last clear of the file."""
    alive = calls.where(F.col("opened_at").isNotNull() & (F.col("closed_at").isNull() | (F.col("opened_at") > F.col("closed_at"))))
    return (
        alive.join(facts.select("file", "cleared_at"), "file")
        .where(F.col("cleared_at").isNull() | (F.col("opened_at") > F.col("cleared_at")))
        .drop("cleared_at")
    )


def with_pending(facts: DataFrame, calls: DataFrame) -> DataFrame:
    """Add ``pending`` (open calls) and ``current_task`` to the facts."""
    per_file = open_calls(calls, facts).groupBy("file").agg(
        F.count(F.lit(1)).alias("pending"),
        F.max_by(call_task(F.col("call.call_name"), F.col("call.call_label")),
                 F.struct("call.since", "opened_at")).alias("__task"),
    )
    return (
        facts.join(per_file, "file", "left")
        .withColumn("pending", F.coalesce("pending", F.lit(0)))
        .withColumn("current_task", F.when(F.col("pending") > 0, F.col("__task")).otherwise(todo_task(F.col("todos"))))
        .drop("__task")
    )


def known_sessions(facts: DataFrame) -> DataFrame:
    """Drop files that produced no session."""
    return facts.where(F.col("session_id").isNotNull() & (F.col("session_id") != C.UNKNOWN_AGENT) | F.col("last_activity").isNotNull())


# --- prompts ---------------------------------------------------------------

def newest_hooks(hooks: DataFrame) -> DataFrame:
    """Newest hook event per session, by (receive time, arrival order).

    Ordering by receive time lets a prompt that follows a resolution in one
    delivery survive.
    """
    return hooks.groupBy("session_id").agg(
        F.max_by(F.struct("kind", "message", "received_at"), F.struct("received_at", "ord")).alias("hook")
    )


def waiting_prompts(hook_state: DataFrame, facts: DataFrame) -> DataFrame:
    """Unanswered prompt per file: the newest hook is a prompt and nothing happened since.

    A prompt waits at most the buffer time for its transcript to appear.
    """
    prompts = hook_state.where(F.col("hook.kind") == "prompt").select(
        "session_id", F.col("hook.message").alias("prompt"), F.col("hook.received_at").alias("prompt_ts"))
    return unanswered(delivered_prompts(prompts, facts), facts)


def delivered_prompts(prompts: DataFrame, facts: DataFrame) -> DataFrame:
    """(file, session_id, prompt, prompt_ts): prompts whose transcript began before their buffer time was over."""
    in_time = F.col("first_activity").isNull() | (
        F.unix_micros("first_activity") - F.unix_micros("prompt_ts") < micros(C.PROMPT_TTL))
    own = facts.where(F.col("source") == C.SOURCE_A).select("file", "session_id", "first_activity")
    return own.join(prompts, "session_id").where(in_time).select("file", "session_id", "prompt", "prompt_ts")


def unanswered(delivered: DataFrame, facts: DataFrame) -> DataFrame:
    """Delivered prompts of files in which nothing happened since."""
    quiet = F.col("last_activity").isNull() | (F.col("last_activity") <= F.col("prompt_ts"))
    return delivered.join(facts.select("file", "last_activity"), "file").where(quiet).select("file", "session_id", "prompt", "prompt_ts")


# --- state and snapshot ----------------------------------------------------

def state_at(now: Column, awaiting: Column | None = None) -> Column:
    """State ladder over facts with ``pending``."""
    silence = age_micros(F.col("last_activity"), now)
    awaiting = F.lit(False) if awaiting is None else awaiting
    return (
        F.when(F.col("last_activity").isNull(), "idle")
        .when(F.coalesce("interrupted", F.lit(False)), "interrupted")
        .when((F.col("source") == C.SOURCE_A) & awaiting, "needs_you")
        .when(F.col("pending") > 0, "tool_running")
        .when(F.coalesce("finished", F.lit(False)), "done")
        .when(silence >= micros(C.STALE_SILENCE), "stale")
        .when(silence >= micros(C.IDLE_SILENCE), "idle")
        .otherwise("thinking")
    )


def status_of(state: Column) -> Column:
    return F.when(state == "interrupted", F.lit("needs_you")).otherwise(state)


def _gauge(used: Column, window: Column) -> Column:
    # single precision at each step, as the gauge is defined
    share = (used.cast("float") / window.cast("float")).cast("float")
    return F.least((share * F.lit(100).cast("float")).cast("float"), F.lit(100).cast("float"))


def context_pct() -> Column:
    last = F.col("last_tokens")
    used_a = last["input_tokens"] + last["cache_read_tokens"] + last["cache_creation_tokens"]
    gauge_a = F.when(used_a > 0, _gauge(used_a, F.lit(C.CONTEXT_WINDOW_TOKENS)))
    gauge_b = F.when(
        F.col("last_total_tokens").isNotNull() & (F.col("context_window") > 0),
        _gauge(F.col("last_total_tokens"), F.col("context_window")))
    return F.when(F.col("source") == C.SOURCE_B, gauge_b).otherwise(gauge_a)


def session_usage(facts: DataFrame, messages: DataFrame) -> DataFrame:
    """(file, usage): sums over deduplicated messages, or the newest cumulative total."""
    sums = messages.groupBy("file").agg(*[F.sum(f"tokens.{f}").alias(f"sum_{f}") for f in C.TOKEN_FIELDS])
    total = F.col("total")
    zero = F.lit(0).cast("bigint")
    b = {
        "input_tokens": F.greatest(total["input_tokens"] - total["cached_input_tokens"], zero),
        "output_tokens": total["output_tokens"],
        "cache_read_tokens": total["cached_input_tokens"],
        "cache_creation_tokens": zero,
    }
    is_b = F.col("source") == C.SOURCE_B
    fields = [
        F.coalesce(F.when(is_b, b[f]).otherwise(F.col(f"sum_{f}")), zero).alias(f) for f in C.TOKEN_FIELDS
    ]
    return facts.join(sums, "file", "left").select("file", F.struct(*fields, context_pct().alias("context_pct")).alias("usage"))


def snapshots(facts: DataFrame, usage: DataFrame, prompts: DataFrame | None, machine: Column, now: Column) -> DataFrame:
    """Normalized snapshot rows at ``now`` (facts must carry pending and current_task)."""
    live = known_sessions(facts)
    if prompts is not None:
        live = live.join(prompts.select("file", "prompt"), "file", "left")
    else:
        live = live.withColumn("prompt", F.lit(None).cast("string"))
    state = state_at(now, F.col("prompt").isNotNull())
    reason = F.when(state == "needs_you", F.coalesce("prompt", F.lit(C.WAITING_REASON))).when(
        state == "interrupted", F.lit(C.INTERRUPTED_REASON))
    return live.join(usage, "file").select(
        "file",
        F.coalesce("session_id", F.lit(C.UNKNOWN_AGENT)).alias("agent_id"),
        "source", machine.alias("machine"),
        F.coalesce("cwd", F.lit("")).alias("project"),
        status_of(state).alias("status"),
        "git_branch", "current_task",
        reason.isNotNull().alias("needs_user"), reason.alias("needs_user_reason"),
        "usage",
        F.coalesce(render_millis(F.col("last_activity")), F.lit("")).alias("last_activity"),
        F.when(F.col("cwd").isNotNull(), F.struct(F.lit("terminal").alias("type"), F.col("cwd").alias("target"))).alias("jump"),
    )
