"""Ordered running values that survive one key holding most of the rows.

A plain window puts every row of a key into one task, which is right for nearly all keys. The few
hot ones are found by counting and cut into segments: the segments are summarised with mergeable
aggregates (partial aggregation on the map side), the summaries are scanned in order per key, and
each segment gets what came before it as one extra seed row. Rows are shuffled once, by
(key, segment); keys that are not hot have one segment and no seeds.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Upper bound of rows per (key, segment) when the order column is a unique integer.
SEGMENT_ROWS = 1 << 16
# A key is cut when it holds more rows than this and more than one part in ``HOT_KEYS`` of all rows,
# so there are fewer than ``HOT_KEYS`` hot keys at any size and their list may be broadcast.
HOT_ROWS = 1 << 16
HOT_KEYS = 100_000
# Segments of a hot key are joined until there is at most one for this many of its rows.
ROWS_PER_SEED = 100


def integer_segment(order: str, rows: int = SEGMENT_ROWS) -> Column:
    """Segment number of a unique integer order column: at most ``rows`` rows each."""
    return F.floor(F.col(order) / F.lit(rows)).cast("bigint")


@dataclass(frozen=True)
class Running:
    """``how``: sum, max, last (newest non-null so far) or prev (value of the row before)."""

    how: str
    value: Column


def _cut_hot_keys(df: DataFrame, keys: list[str], segment: list[str]) -> tuple[DataFrame, list[str]]:
    """``df`` with ``__hot`` and the columns that number a hot key's segments (null for other keys), and their names; no names if no key is hot."""
    *outer, inner = segment
    named = {k: f"__key{i}" for i, k in enumerate(keys)}
    span = F.max(inner) - F.min(inner) + 1
    counts = df.groupBy(*[F.col(k).alias(n) for k, n in named.items()]).agg(F.count(F.lit(1)).alias("__n"), span.alias("__span"))
    share = counts.agg(F.sum("__n") / F.lit(HOT_KEYS)).scalar()
    hot = counts.where((F.col("__n") > HOT_ROWS) & (F.col("__n") > share))
    if hot.isEmpty():
        return df, []
    hot = hot.withColumn("__wide", F.greatest(F.lit(1), F.ceil(F.col("__span") * ROWS_PER_SEED / F.col("__n"))))
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in named.items()]
    rows = df.join(F.broadcast(hot), same, "left").withColumn("__hot", F.col("__wide").isNotNull())
    for c in outer:
        rows = rows.withColumn(f"__cut_{c}", F.when(F.col("__hot"), F.col(c)))
    rows = rows.withColumn(f"__cut_{inner}", F.floor(F.col(inner) / F.col("__wide")).cast("bigint"))
    return rows.drop(*named.values(), "__n", "__span", "__wide"), [f"__cut_{c}" for c in segment]


def running(
    df: DataFrame,
    keys: Sequence[str],
    segment: Sequence[str],
    order: Sequence[str],
    **specs: Running,
) -> DataFrame:
    """Add one column per spec. ``segment`` columns must be non-decreasing in ``order``, the last one an integer.

    Only hot keys are cut. Neighbouring values of the last segment column count as one segment where a key
    has few rows in each, so seeds are at most one in ``ROWS_PER_SEED`` rows for each value of the others.
    """
    keys, segment, order = list(keys), list(segment), list(order)
    ordering = F.struct(*[F.col(c) for c in order])
    held = {name: f"__{name}" for name in specs}
    base, cuts = _cut_hot_keys(df, keys, segment)
    for name, spec in specs.items():
        base = base.withColumn(held[name], F.struct(spec.value.alias("v")) if spec.how == "prev" else spec.value)

    def summary(name: str, spec: Running) -> Column:
        col = F.col(held[name])
        if spec.how in ("sum", "max"):
            return getattr(F, spec.how)(col).alias(held[name])
        return F.max_by(col, F.when(col.isNotNull(), ordering)).alias(held[name])

    before = Window.partitionBy(*keys).orderBy(*cuts).rowsBetween(Window.unboundedPreceding, -1)

    def carried(name: str, spec: Running) -> Column:
        col = F.col(held[name])
        if spec.how in ("sum", "max"):
            return getattr(F, spec.how)(col).over(before).alias(held[name])
        return F.last(col, ignorenulls=True).over(before).alias(held[name])

    rows = base.withColumn("__seed", F.lit(1))
    seeds = None if not cuts else (
        base.where("__hot")
        .groupBy(*keys, *cuts)
        .agg(*[summary(n, s) for n, s in specs.items()])
        .select(*keys, *cuts, *[carried(n, s) for n, s in specs.items()])
        .where(F.coalesce(*[F.when(F.col(held[n]).isNotNull(), F.lit(True)) for n in specs]))
        .withColumn("__seed", F.lit(0))
    )
    if seeds is not None:
        rows = rows.unionByName(seeds, allowMissingColumns=True)
    rows = rows.repartition(*[F.col(c) for c in (*keys, *cuts)])  # by key alone would also do for the window
    at = Window.partitionBy(*keys, *cuts).orderBy("__seed", *order)
    upto = at.rowsBetween(Window.unboundedPreceding, 0)
    for name, spec in specs.items():
        col = F.col(held[name])
        if spec.how in ("sum", "max"):
            rows = rows.withColumn(name, getattr(F, spec.how)(col).over(upto))
        elif spec.how == "last":
            rows = rows.withColumn(name, F.last(col, ignorenulls=True).over(upto))
        else:
            rows = rows.withColumn(name, F.lag(col).over(at)["v"])
    return rows.where(F.col("__seed") == 1).drop("__seed", "__hot", *cuts, *held.values())


def dyadic_cover(lo: Column, hi: Column) -> Column:
    """Aligned power-of-two blocks that exactly cover the integers lo..hi."""
    end = hi + F.lit(1)
    top = F.floor(F.log2((end - lo).cast("double"))).cast("int")

    def at_level(j: Column) -> Column:
        size = F.pow(F.lit(2.0), j).cast("bigint")
        left = F.ceil(lo / size).cast("bigint")
        right = F.floor(end / size).cast("bigint")
        open_ = left < right
        return F.array(
            F.when(open_ & (left % 2 == 1), F.struct(j.alias("level"), left.alias("block"))),
            F.when(open_ & (right % 2 == 1), F.struct(j.alias("level"), (right - 1).alias("block"))),
        )

    blocks = F.flatten(F.transform(F.sequence(F.lit(0), top), at_level))
    return F.when(hi >= lo, F.filter(blocks, lambda b: b.isNotNull()))


def newest_covering(
    intervals: DataFrame,
    points: DataFrame,
    keys: Sequence[str],
    lo: str,
    hi: str,
    at: str,
    rank: str,
    value: str,
) -> DataFrame:
    """For each point the ``value`` of the covering interval with the greatest ``rank``.

    Both sides meet on power-of-two blocks, so the work is rows times the log
    of the widest interval; no interval is ever paired with all its points.
    Returns (keys, at, value); points that nothing covers are left out.
    """
    keys = list(keys)
    blocks = (
        intervals.where(F.col(hi) >= F.col(lo))
        .select(*keys, F.explode(dyadic_cover(F.col(lo), F.col(hi))).alias("b"), F.col(rank).alias("__rank"), F.col(value).alias("__value"))
        .groupBy(*keys, F.col("b.level").alias("__level"), F.col("b.block").alias("__block"))
        .agg(F.max(F.struct("__rank", "__value")).alias("__best"))
    )
    levels = blocks.groupBy(*keys).agg(F.max("__level").alias("__top"))
    asked = (
        points.select(*keys, at).distinct()
        .join(levels, keys)
        .select(*keys, at, F.explode(F.sequence(F.lit(0), F.col("__top"))).alias("__level"))
        .withColumn("__block", F.floor(F.col(at) / F.pow(F.lit(2.0), F.col("__level"))).cast("bigint"))
    )
    return (
        asked.join(blocks, [*keys, "__level", "__block"])
        .groupBy(*keys, at)
        .agg(F.max("__best").alias("__best"))
        .select(*keys, at, F.col("__best.__value").alias(value))
    )
