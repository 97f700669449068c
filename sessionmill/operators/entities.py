"""One logical session per card: merge observations of several machines."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionmill import contracts as C
from sessionmill.functions.paths import normalize_project
from sessionmill.functions.times import micros, parse_rfc3339
from sessionmill.operators.registry import logical_key


def _freshness() -> Column:
    """Unreadable times sort oldest; equal times keep the first in (machine, agent_id) order."""
    return F.coalesce(F.unix_micros(parse_rfc3339(F.col("last_activity"))), F.lit(-(1 << 62)))


def _merge_aggregates(columns: list[str]) -> list[Column]:
    """Freshest row as ``w``, whether any row needs the user, and the freshest needing row's reason."""
    order = F.struct((-F.col("__fresh")).alias("age"), F.col("machine"), F.col("agent_id"))
    return [
        F.min_by(F.struct(*columns), order).alias("w"),
        F.coalesce(F.bool_or("needs_user"), F.lit(False)).alias("__any"),
        F.min_by("needs_user_reason", F.when(F.col("needs_user"), order)).alias("__reason"),
    ]


def _merged(columns: list[str]) -> list[Column]:
    """Columns of the merged row: needs_user is never lost, its reason moves along."""
    special = {
        "needs_user": F.col("__any"),
        "needs_user_reason": F.when(F.col("w.needs_user"), F.col("w.needs_user_reason")).otherwise(F.col("__reason")),
    }
    return [special.get(c, F.col(f"w.{c}")).alias(c) for c in columns]


def logical_sessions(sessions: DataFrame, overlap: timedelta = C.OVERLAP_WINDOW) -> DataFrame:
    """Two merge rules, both plain aggregates.

    1. Same source and id on several machines: one session.
    2. Same source and normalized project, exactly two sessions, on two
       machines, active within ``overlap``: one session. Three or more
       sessions of a project are ambiguous and stay apart.

    A project with very many sessions never meets in one task: the group facts
    and the merged row of a project come from one aggregate with map-side
    merging, and sessions swallowed by a pair are removed by their own unique
    key, not by project.
    """
    columns = [*sessions.columns, "logical_key"]
    one = (
        sessions.withColumns({"logical_key": logical_key(), "__fresh": _freshness()})
        .groupBy("logical_key").agg(*_merge_aggregates(sessions.columns))
        .select("logical_key", *_merged(sessions.columns))
    )
    keyed = one.withColumns({
        "__project": normalize_project(F.col("project")),
        "__at": F.unix_micros(parse_rfc3339(F.col("last_activity"))),
        "__fresh": _freshness(),
    })
    pairs = keyed.groupBy("source", "__project").agg(
        F.count(F.lit(1)).alias("n"), F.min("machine").alias("m0"), F.max("machine").alias("m1"),
        F.count("__at").alias("dated"), (F.max("__at") - F.min("__at")).alias("gap"),
        F.array(F.min("logical_key"), F.max("logical_key")).alias("members"),
        *_merge_aggregates(columns),
    ).where(
        (F.col("n") == 2) & (F.col("m0") != F.col("m1")) & (F.col("dated") == 2) & (F.col("gap") <= micros(overlap)))
    members = pairs.select(F.explode("members").alias("logical_key"))
    alone = one.join(members, "logical_key", "left_anti")
    return alone.select(*columns).unionByName(pairs.select(*_merged(columns)))


def newest_first(sessions: DataFrame) -> DataFrame:
    """Presentation order: the activity string, newest first."""
    return sessions.orderBy(F.desc("last_activity"))
