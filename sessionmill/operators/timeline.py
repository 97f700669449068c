"""State after every transcript line, and the changes of it.

The per-line state needs the running number of pending calls, where a call is
reopened, closed or dropped by a later clear. A file may hold most of all
rows, so the fold is cut into segments (see ``segments``): segment summaries
give every segment its start values as seed rows, and one shuffle by (file,
segment) carries the full rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionmill import contracts as C
from sessionmill.functions.times import render_millis
from sessionmill.operators.facts import (
    SEGMENT, call_task, newest, order_key, todo_task, with_call_starts, with_segment,
)
from sessionmill.operators.segments import newest_covering
from sessionmill.plans.tables import materialize

PLACE = ["file", *SEGMENT]


def _effects(records: DataFrame) -> DataFrame:
    useful = (
        F.col("active_ts").isNotNull() | F.col("interrupted").isNotNull() | F.col("finished").isNotNull()
        | F.coalesce("clears", F.lit(False)) | F.col("call_id").isNotNull() | F.col("todos").isNotNull()
    )
    return with_segment(with_call_starts(records).where(useful)).select(
        *PLACE, "source", "line", "pos", "active_ts", "interrupted", "finished",
        F.coalesce("clears", F.lit(False)).alias("clears"), "call_id", "opens", "since",
        call_task(F.col("call_name"), F.col("call_label")).alias("task"),
        todo_task(F.col("todos")).alias("todo"), F.col("todos").isNotNull().alias("todos_set"),
    )


def _todo_effect() -> Column:
    return F.when(F.col("todos_set"), F.struct(F.col("todo").alias("text")))


def _segment_starts(effects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file seeds, call seeds) of every segment but the first of a file."""
    order = order_key()
    per_segment = (
        effects.withColumn("todo_effect", _todo_effect()).groupBy(*PLACE, "source").agg(
            F.max("active_ts").alias("active_ts"),
            newest("interrupted", order).alias("interrupted"),
            newest("finished", order).alias("finished"),
            newest("todo_effect", order).alias("todo_effect"),
            F.max(F.when(F.col("clears"), order)).alias("cleared_at"),
        )
    )
    by_file = Window.partitionBy("file").orderBy(*SEGMENT)
    sofar = by_file.rowsBetween(Window.unboundedPreceding, 0)
    before = by_file.rowsBetween(Window.unboundedPreceding, -1)
    after = by_file.rowsBetween(1, Window.unboundedFollowing)
    numbered = per_segment.select(
        *PLACE, "source", F.row_number().over(by_file).cast("bigint").alias("k"),
        F.count(F.lit(1)).over(Window.partitionBy("file")).alias("segments"),
        F.max("active_ts").over(before).alias("active_ts"),
        *[F.last(c, ignorenulls=True).over(before).alias(c) for c in ("interrupted", "finished", "todo_effect")],
        F.max("cleared_at").over(sofar).alias("cleared_at"),
        F.min(F.when(F.col("cleared_at").isNotNull(), F.struct(*SEGMENT))).over(after).alias("next_clear"),
    ).where(F.col("segments") > 1)
    numbered = materialize(numbered, "segments")
    index = numbered.select("file", F.struct(*SEGMENT).alias("next_clear"), F.col("k").alias("k_clear"))
    cleared = numbered.join(index, ["file", "next_clear"], "left")

    # newest event of each call id per segment, only in files with several segments
    several = numbered.select("file").distinct()
    events = effects.where(F.col("call_id").isNotNull()).join(several, "file", "left_semi")
    by_call = Window.partitionBy("file", "call_id").orderBy("k")
    touched = (
        events.groupBy(*PLACE, "call_id")
        .agg(F.max_by(F.struct("opens", "since", "task"), order).alias("e"), F.max(order).alias("at"))
        .join(cleared.select(*PLACE, "k", "segments", "cleared_at", "k_clear"), PLACE)
        .withColumn("k_touch", F.lead("k").over(by_call))
    )
    alive = (
        touched.where(F.col("e.opens") & (F.col("cleared_at").isNull() | (F.col("at") > F.col("cleared_at"))))
        .select(
            "file", "call_id", "k_touch",
            (F.col("k") + 1).alias("lo"),
            F.least(F.col("k_touch"), F.col("k_clear"), F.col("segments")).alias("hi"),
            F.struct("e.since", "at").alias("rank"), F.struct("e.since", "at", "e.task").alias("best"),
        )
        .where(F.col("hi") >= F.col("lo"))
    )
    alive = materialize(alive, "alive")
    # number of calls pending at each segment start
    steps = (
        alive.select("file", F.explode(F.array(
            F.struct(F.col("lo").alias("k"), F.lit(1).cast("bigint").alias("d")),
            F.struct((F.col("hi") + 1).alias("k"), F.lit(-1).cast("bigint").alias("d")))).alias("s"))
        .groupBy("file", F.col("s.k").alias("k")).agg(F.sum("s.d").alias("d"))
    )
    # calls alive at a start and touched inside that segment are seeded one by one,
    # of all others only the newest matters
    named = alive.where(F.col("hi") == F.col("k_touch"))
    bulk = alive.withColumn("hi", F.when(F.col("hi") == F.col("k_touch"), F.col("hi") - 1).otherwise(F.col("hi")))
    best = newest_covering(bulk, numbered.select("file", "k"), ["file"], "lo", "hi", "k", "rank", "best")
    starts = (
        numbered.join(steps, ["file", "k"], "left")
        .withColumn("pending", F.coalesce(F.sum("d").over(
            Window.partitionBy("file").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
        .join(best, ["file", "k"], "left")
        .where(F.col("k") > 1)
    )
    file_seeds = starts.select(
        *PLACE, "source", F.lit(-2).cast("bigint").alias("line"), F.lit(0).alias("pos"), "active_ts", "interrupted", "finished",
        F.lit(False).alias("clears"), F.col("pending").cast("bigint").alias("step"), "todo_effect",
        F.when(F.col("best").isNotNull(), F.lit(True)).alias("opens"), F.struct("best.since", "best.at").alias("rank"), F.col("best.task").alias("task"),
    ).withColumn("rank", F.when(F.col("opens"), F.col("rank")))
    call_seeds = (
        named.select("file", F.col("hi").alias("k"), "call_id", "rank", "best")
        .join(numbered.select(*PLACE, "k", "source"), ["file", "k"])
        .select(
            *PLACE, "source", F.lit(-1).cast("bigint").alias("line"), F.lit(0).alias("pos"),
            F.lit(False).alias("clears"), F.lit(0).cast("bigint").alias("step"), "call_id", F.lit(True).alias("opens"),
            F.col("best.task").alias("task"), "rank", F.col("rank.at").alias("seed_rank"),
        )
    )
    return file_seeds, call_seeds


def evaluated(records: DataFrame) -> DataFrame:
    """Every effect row (and the seed rows) with the values after it, as a shared table."""
    effects = materialize(_effects(records), "effects")
    rows = (
        effects.withColumns({
            "todo_effect": _todo_effect(), "step": F.lit(None).cast("bigint"),
            "rank": F.when(F.col("opens"), F.struct("since", order_key().alias("at"))),
            "seed_rank": F.lit(None).cast("struct<seq:bigint,line:bigint,pos:int>"),
        }).drop("todo", "todos_set", "since")
    )
    place = F.struct(*SEGMENT)
    several = effects.groupBy("file").agg((F.min(place) != F.max(place)).alias("cut"))
    if not several.where("cut").isEmpty():
        for seeds in _segment_starts(effects):
            rows = rows.unionByName(seeds, allowMissingColumns=True)
    rows = rows.repartition(*[F.col(c) for c in PLACE])
    order = ["line", "seed_rank", "pos"]
    seg = Window.partitionBy(*PLACE).orderBy(*order)
    upto = seg.rowsBetween(Window.unboundedPreceding, 0)
    opened = F.coalesce(F.col("opens").cast("bigint"), F.lit(0).cast("bigint"))
    rows = rows.withColumns({
        "last_activity": F.max("active_ts").over(upto),
        "is_interrupted": F.coalesce(F.last("interrupted", True).over(upto), F.lit(False)),
        "is_finished": F.coalesce(F.last("finished", True).over(upto), F.lit(False)),
        "todo": F.last("todo_effect", True).over(upto)["text"],
        "place": F.row_number().over(seg).cast("bigint"),
        "epoch": F.count_if(F.col("clears")).over(upto),
        "next_line": F.lead("line").over(seg),
    })
    per_call = Window.partitionBy(*PLACE, "epoch", "call_id").orderBy(*order)
    rows = rows.withColumns({
        "step": F.when(F.col("step").isNotNull(), F.col("step"))
        .when(F.col("call_id").isNotNull(), opened - F.coalesce(F.lag(opened).over(per_call), F.lit(0).cast("bigint")))
        .otherwise(F.lit(0).cast("bigint")),
        "ends": F.when(F.col("call_id").isNotNull(), F.lead("place").over(per_call)),
    })
    per_epoch = Window.partitionBy(*PLACE, "epoch").orderBy(*order)
    in_epoch = per_epoch.rowsBetween(Window.unboundedPreceding, 0)
    whole_epoch = per_epoch.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({
        "pending": F.sum("step").over(in_epoch),
        "open": F.last(F.when(F.col("opens"), F.struct("rank", "ends", "task")), True).over(in_epoch),
        "latest": F.max("rank").over(in_epoch),
        "epoch_end": F.max("place").over(whole_epoch),
    })
    return materialize(rows, "evaluated")


def _state() -> Column:
    return (
        F.when(F.col("last_activity").isNull(), F.lit(None).cast("string"))
        .when(F.col("is_interrupted"), "interrupted")
        .when(F.col("pending") > 0, "tool_running")
        .when(F.col("is_finished"), "done")
        .otherwise("thinking")
    )


def line_states(rows: DataFrame) -> DataFrame:
    """From :func:`evaluated`: state after each line that had an effect, evaluated at the running activity clock.

    The instant equals the last activity, so silence is zero and no idle or
    stale state can appear. A file's lines before its first activity have none.
    """
    last_of_line = F.col("next_line").isNull() | (F.col("next_line") != F.col("line"))
    return (
        rows.where((F.col("line") == -2) | ((F.col("line") >= 0) & last_of_line))
        .withColumn("state", _state())
    )


def pending_counts(records: DataFrame) -> DataFrame:
    """Number of pending calls after each line with an effect."""
    return line_states(evaluated(records)).where(F.col("line") >= 0).select("file", "seq", "line", "pending")


def timeline(records: DataFrame) -> DataFrame:
    """State changes of each file with the task shown at that moment.

    The task is the newest pending call. Nearly always that is the call opened
    last; the remaining changes look up the newest interval that covers them.
    """
    rows = evaluated(records)
    seg = Window.partitionBy(*PLACE).orderBy("line")
    changes = (
        line_states(rows).withColumn("was", F.lag("state").over(seg))
        .where((F.col("line") >= 0) & F.col("state").isNotNull() & ~F.col("state").eqNullSafe(F.col("was")))
    )
    newest_is_open = (
        (F.col("open.ends").isNull() | (F.col("open.ends") > F.col("place")))
        & (F.col("open.rank") == F.col("latest"))
    )
    clear = changes.where((F.col("pending") <= 0) | newest_is_open).withColumn(
        "task", F.when(F.col("pending") > 0, F.col("open.task")).otherwise(F.col("todo")))
    unclear = changes.where((F.col("pending") > 0) & ~newest_is_open)
    intervals = rows.where(F.col("opens")).select(
        *PLACE, F.col("place").alias("lo"),
        F.coalesce(F.col("ends") - 1, F.col("epoch_end")).alias("hi"),
        "rank", F.struct("task").alias("best"),
    ).join(unclear.select(*PLACE).distinct(), PLACE, "left_semi")
    found = newest_covering(intervals, unclear, PLACE, "lo", "hi", "place", "rank", "best")
    looked_up = unclear.drop("task").join(found, [*PLACE, "place"], "left").withColumn("task", F.col("best.task")).drop("best")
    columns = ["file", "source", "seq", "line", "last_activity", "state", "task"]
    return (
        clear.select(*columns).unionByName(looked_up.select(*columns))
        .withColumn("ts", render_millis(F.col("last_activity")))
    )


def changed_snapshots(snapshots: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Keep a snapshot only when what is shown differs from the one before it."""
    from sessionmill.operators.segments import Running, integer_segment, running

    shown = F.struct("status", "current_task", "usage", "last_activity", "needs_user")
    seen = running(
        snapshots.withColumn("__seg", integer_segment(order)), keys, ["__seg"], [order],
        __was=Running("prev", shown))
    return seen.where(~shown.eqNullSafe(F.col("__was"))).drop("__seg", "__was")
