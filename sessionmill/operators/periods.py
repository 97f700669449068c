"""Usage by period (today, 7d, 30d, all) and source, and sums over machines."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionmill import contracts as C
from sessionmill.operators.usage import event_cost

PERIODS = ["today", "7d", "30d", "all"]


def local_midnight(now: datetime, tz: str) -> datetime:
    """Start of the local day: the earlier instant when it happens twice, a day ago when it never does."""
    zone = ZoneInfo(tz)
    local = now.astimezone(zone)
    wall = datetime(local.year, local.month, local.day, tzinfo=zone, fold=0)
    instant = wall.astimezone(timezone.utc)
    exists = instant.astimezone(zone).replace(tzinfo=None) == wall.replace(tzinfo=None)
    return instant if exists else now.astimezone(timezone.utc) - timedelta(days=1)


def period_starts(now: Column, midnight: Column) -> dict[str, Column]:
    """Inclusive lower bounds; NULL means no bound."""
    return {
        "today": midnight,
        "7d": now - F.lit(timedelta(days=7)),
        "30d": now - F.lit(timedelta(days=30)),
        "all": F.lit(None).cast("timestamp"),
    }


def utc_midnight(now: Column) -> Column:
    return F.date_trunc("day", now)


def zone_midnight(now: Column, zone: Column) -> Column:
    """:func:`local_midnight` as a column, for a time zone per row."""
    wall = F.date_trunc("day", F.from_utc_timestamp(now, zone))
    instant = F.to_utc_timestamp(wall, zone)
    # of two instants with this wall time the earlier one; none at all when the clock jumps over it
    earlier = F.to_utc_timestamp(wall - F.expr("INTERVAL 3 HOURS"), zone) + F.expr("INTERVAL 3 HOURS")
    first = F.when((earlier < instant) & (F.from_utc_timestamp(earlier, zone) == wall), earlier).otherwise(instant)
    return F.when(F.from_utc_timestamp(first, zone) == wall, first).otherwise(now - F.expr("INTERVAL 1 DAY"))


def period_totals(
    events: DataFrame,
    models: DataFrame,
    now: Column,
    midnight: Column | None = None,
    scope: tuple[str, ...] = ("machine",),
    cost: Column | None = None,
) -> DataFrame:
    """(scope, period, source) totals, with a row for every pair even when empty.

    ``events``: file, source, ts, tokens and the scope columns; ``models``:
    newest model per file, which prices the whole session. Each event is
    aggregated per file first, in one row with one counter set per period, so
    the four overlapping periods cost no extra rows and a session is counted
    once per period without a distinct.
    """
    starts = period_starts(now, utc_midnight(now) if midnight is None else midnight)
    past = F.col("ts") <= now
    hit = {p: past if p == "all" else past & (F.col("ts") >= s) for p, s in starts.items()}
    per_file = events.groupBy(*scope, "source", "file").agg(*[
        F.struct(
            F.count_if(hit[p]).alias("messages"),
            *[F.coalesce(F.sum(F.when(hit[p], F.col(f"tokens.{f}"))), F.lit(0).cast("bigint")).alias(f) for f in C.TOKEN_FIELDS],
        ).alias(f"p_{p}") for p in starts
    ]).join(models.select("file", "model"), "file", "left")
    price = event_cost if cost is None else cost
    own = F.when(F.col("source") == C.SOURCE_B, C.SOURCE_B).otherwise(C.SOURCE_A)

    def cell(p: str, source: str) -> Column:
        """A file's counters under one period and source: its own, or nothing, which keeps the pair in the result."""
        used = F.when((own == source) & (F.col(f"p_{p}.messages") > 0), F.col(f"p_{p}"))
        return F.struct(F.lit(p).alias("period"), F.lit(source).alias("source"), used.alias("t"),
                        F.when(used.isNotNull(), price(F.col("source"), F.col("model"), F.col(f"p_{p}"))).alias("cost"))

    cells = per_file.select(*scope, F.explode(F.array(*[cell(p, s) for p in starts for s in (C.SOURCE_A, C.SOURCE_B)])).alias("e"))
    zero = F.lit(0).cast("bigint")
    return cells.groupBy(*scope, F.col("e.period").alias("period"), F.col("e.source").alias("source")).agg(
        F.count("e.t").alias("sessions"),
        *[F.coalesce(F.sum(f"e.t.{f}"), zero).alias(f) for f in ("messages", *C.TOKEN_FIELDS)], F.sum("e.cost").alias("est_cost_usd"))


def usage_stats(totals: DataFrame, now: Column) -> DataFrame:
    """Nested report row per machine from :func:`period_totals` (eight rows each)."""
    from sessionmill.functions.times import render_millis

    fields = F.struct("sessions", "messages", *C.TOKEN_FIELDS, "est_cost_usd")
    per_period = totals.groupBy("machine", "period").agg(
        F.max_by(fields, F.when(F.col("source") == C.SOURCE_A, 1)).alias("claude"),
        F.max_by(fields, F.when(F.col("source") == C.SOURCE_B, 1)).alias("codex"))
    rank = F.array_position(F.array(*[F.lit(p) for p in PERIODS]), F.col("period"))
    listed = per_period.groupBy("machine").agg(
        F.array_sort(F.collect_list(F.struct(rank.alias("rank"), F.col("period").alias("key"), "claude", "codex"))).alias("l"))
    return listed.select(
        "machine",
        F.transform("l", lambda x: F.struct(x["key"].alias("key"), x["claude"].alias("claude"), x["codex"].alias("codex"))).alias("periods"),
        render_millis(now).alias("computed_at"))


def all_machines(totals: DataFrame, period: str) -> DataFrame:
    """One period summed over machines per source, plus the grand row (source NULL)."""
    return (
        totals.where(F.col("period") == period)
        .rollup("source")
        .agg(*[F.sum(c).alias(c) for c in ("sessions", "messages", *C.TOKEN_FIELDS)],
             F.sum("est_cost_usd").alias("est_cost_usd"))
        .withColumn("total_tokens", sum((F.col(f) for f in C.TOKEN_FIELDS[1:]), F.col(C.TOKEN_FIELDS[0])))
    )
