"""Anchored five-hour blocks, the rolling week and the plan estimate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionmill import contracts as C
from sessionmill.functions.times import age_micros, micros

HOUR = 3600
PIECE_HOURS = 240  # ten days


def hourly_usage(events: DataFrame, account: list[str], now: Column) -> DataFrame:
    """Token sums per (account, hour); future events are left out first."""
    hour = (F.floor(F.unix_seconds("ts") / HOUR) * HOUR).cast("bigint")
    return (
        events.where(F.col("ts") <= now)
        .groupBy(*account, hour.alias("hour"))
        .agg(*[F.sum(f"tokens.{f}").alias(f) for f in C.TOKEN_FIELDS], F.count(F.lit(1)).alias("messages"))
    )


def _next_start(start: Column, hour: Column) -> Column:
    """Start of the block that holds ``hour`` when the block before it started at ``start`` (null: none yet)."""
    return F.when(start.isNull() | (hour >= start + F.lit(C.BLOCK_HOURS * HOUR)), hour).otherwise(start)


def _starts_in(hours: Column, start: Column) -> Column:
    """The starts of blocks of each of some sorted hours; at most ``PIECE_HOURS`` of them."""
    return F.aggregate(
        hours, F.array().cast("array<bigint>"),
        lambda done, h: F.concat(done, F.array(_next_start(F.coalesce(F.try_element_at(done, F.lit(-1)), start), h))))


def blocks(hourly: DataFrame, account: list[str], piece_hours: int = PIECE_HOURS) -> DataFrame:
    """All blocks of every account: start, end, token sums, messages.

    A block starts on the hour and lasts whole hours, so membership depends on the hour only. The calendar is cut into
    pieces. What a piece does to the block that runs into it is a small map: the block can have started in
    one of the last ``BLOCK_HOURS`` - 1 hours before it, or not be open any more; for each case the piece tells the
    start of its last block. Only these maps are followed in order, one row per account and piece; then each
    piece finds its blocks from the start that runs into it, so no array is longer than a piece.
    Null accounts form an account like others.
    """
    length, span = C.BLOCK_HOURS * HOUR, piece_hours * HOUR
    piece = F.floor(F.col("hour") / span).cast("bigint")
    rows = F.array_sort(F.collect_list(F.struct("hour", *C.TOKEN_FIELDS, "messages")))
    each = hourly.withColumn("piece", piece).groupBy(*account, "piece").agg(rows.alias("rows")).withColumn("hours", F.col("rows.hour"))

    # case 0: no open block; case k: it started k hours before the piece
    def last_start(case: int) -> Column:
        start = F.col("piece") * span - case * HOUR if case else F.lit(None).cast("bigint")
        return F.aggregate("hours", start.cast("bigint"), _next_start)

    maps = each.withColumn("ends", F.array(*[last_start(k) for k in range(C.BLOCK_HOURS)]))
    # a bounded number of rows per account: one for each piece of the calendar with use
    steps = F.array_sort(F.collect_list(F.struct("piece", "ends")))

    def walk(seen: Column, step: Column) -> Column:
        before = F.try_element_at(seen, F.lit(-1))["leaves"]
        back = F.floor((step["piece"] * span - before) / HOUR).cast("int")
        case = F.coalesce(F.when(back < C.BLOCK_HOURS, back), F.lit(0))
        leaves = F.element_at(step["ends"], case + 1)
        return F.concat(seen, F.array(F.struct(step["piece"].alias("piece"), before.alias("enters"), leaves.alias("leaves"))))

    empty = F.array().cast("array<struct<piece:bigint,enters:bigint,leaves:bigint>>")
    walked = maps.groupBy(*account).agg(F.aggregate(steps, empty, walk).alias("s")).select(F.struct(*account).alias("who"), F.explode("s").alias("s"))
    same = F.struct(*account).eqNullSafe(F.col("who")) & (F.col("piece") == F.col("s.piece"))
    known = each.join(walked, same).withColumn("starts", _starts_in(F.col("hours"), F.col("s.enters")))
    placed = known.select(*account, F.explode(F.arrays_zip("rows", "starts")).alias("z")).select(*account, F.col("z.starts").alias("start"), "z.rows.*")
    return (
        placed.groupBy(*account, "start")
        .agg(*[F.sum(f).alias(f) for f in C.TOKEN_FIELDS], F.sum("messages").alias("messages"))
        .select(
            *account, F.timestamp_seconds("start").alias("block_start"),
            F.timestamp_seconds(F.col("start") + length).alias("block_end"), *C.TOKEN_FIELDS, "messages")
    )


def weekly_usage(events: DataFrame, account: list[str], now: Column) -> DataFrame:
    """Rolling seven days, both ends inclusive."""
    return (
        events.where((F.col("ts") <= now) & (age_micros(F.col("ts"), now) <= micros(C.WEEK)))
        .groupBy(*account)
        .agg(*[F.sum(f"tokens.{f}").alias(f) for f in C.TOKEN_FIELDS], F.count(F.lit(1)).alias("messages"))
    )


def _window_usage(prefix: str) -> Column:
    zero = F.lit(0).cast("bigint")
    return F.struct(
        F.struct(*[F.coalesce(F.col(f"{prefix}{f}"), zero).alias(f) for f in C.TOKEN_FIELDS]).alias("tokens"),
        F.coalesce(F.col(f"{prefix}messages"), zero).alias("messages"))


def plan_estimate(events: DataFrame, accounts: DataFrame, account: list[str], now: Column) -> DataFrame:
    """Current block and rolling week per account; accounts without use get zeros."""
    current = blocks(hourly_usage(events, account, now), account).where(
        (F.col("block_start") <= now) & (F.col("block_end") > now))
    five = current.select(*account, F.col("block_end").alias("five_hour_resets_at"),
                          *[F.col(c).alias(f"b_{c}") for c in (*C.TOKEN_FIELDS, "messages")])
    week = weekly_usage(events, account, now)
    week = week.select(*account, *[F.col(c).alias(f"w_{c}") for c in (*C.TOKEN_FIELDS, "messages")])
    return (
        accounts.select(*account).distinct().join(five, account, "left").join(week, account, "left")
        .select(*account, F.struct(
            _window_usage("b_").alias("five_hour"), "five_hour_resets_at",
            _window_usage("w_").alias("weekly"), F.lit("estimated").alias("confidence"),
        ).alias("claude"))
    )
