"""Change feed for readers: full state, then diffs; and the card view it folds to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionmill import contracts as C
from sessionmill.operators.registry import logical_key, session_key


def change_feed(changes: DataFrame, housekeeping: DataFrame | None = None, order: str = "arrival") -> DataFrame:
    """Visible changes as feed rows (event, key, logical_key, session columns)."""
    feed = changes.where(F.col("change_type") != "unchanged").withColumn("event", F.lit("upsert"))
    if housekeeping is not None:
        feed = feed.unionByName(housekeeping, allowMissingColumns=True)
    return feed


def next_cards(shown: DataFrame, step: DataFrame, *order: str) -> DataFrame:
    """What a step of the feed makes of the cards it touches: rows of ``step``'s logical keys with ``gone``.

    ``shown``: the cards of these keys so far (logical_key, key and the columns of a session). Only the card shown can be removed by a
    later row, so the card stands for all rows before it.
    """
    moves = step.where(F.col("event").isin("upsert", "removed"))
    columns = [c for c in shown.columns if c != "logical_key"]
    before = shown.select("logical_key", *columns, F.lit("upsert").alias("event"), *[F.lit(-1).cast("bigint").alias(c) for c in order])
    after = card_view(before.unionByName(moves.select("logical_key", *columns, "event", *[F.col(c).cast("bigint").alias(c) for c in order])), *order)
    touched = moves.select("logical_key").distinct()
    cards = after.select(F.col("logical_key").alias("k"), F.struct(*columns).alias("w"))
    found = touched.join(cards, F.col("logical_key").eqNullSafe(F.col("k")), "left")
    return found.select("logical_key", *[F.col(f"w.{c}").alias(c) for c in columns], F.col("w").isNull().alias("gone"))


def full_state(current: DataFrame, **position: Column) -> DataFrame:
    """The opening rows of a reader: every session at one position of the feed."""
    return current.withColumns({"event": F.lit("full"), "key": session_key(), "logical_key": logical_key(), **position})


def usage_rows(reports: DataFrame, **position: Column) -> DataFrame:
    """Changed usage reports as feed rows (event, key, logical_key, report); the key is the machine."""
    report = F.struct(*C.USAGE_REPORT.fieldNames()).alias("report")
    kept = [c for c in ("phase", "arrival", "batch_id") if c in reports.columns and c not in position]
    rows = reports.select(F.lit("usage").alias("event"), F.col("machine").alias("key"), F.lit(None).cast("string").alias("logical_key"), report, *kept)
    return rows.withColumns(position) if position else rows


def newest_reports(feed: DataFrame, *order: str) -> DataFrame:
    """The report of each machine that a reader shows after the feed: the last usage row."""
    rows = feed.where(F.col("event") == "usage")
    return rows.groupBy("key").agg(F.max_by("report", F.struct(*order)).alias("report")).select("report.*")


def card_view(feed: DataFrame, *order: str) -> DataFrame:
    """State a reader shows after the feed. ``order``: the columns of the feed's total order; none may be null.

    Rows before the newest full state are void. The last upsert of a logical
    key wins; a later removal counts only when it names the machine shown.
    One scalar, then two aggregates over one pass: last upsert and last
    removal per machine, then the machine shown.
    """
    order = order or ("arrival",)
    position = F.struct(*order)
    for c in order:
        position = F.when(F.col(c).isNotNull(), position).otherwise(F.raise_error(F.lit(f"feed row without {c}")))
    rows = feed.withColumn("__at", position)
    reset = rows.where(F.col("event") == "full").agg(F.max("__at")).scalar()
    valid = rows.where(F.coalesce(F.col("__at") >= reset, F.lit(True)))
    shown = F.col("event").isin("full", "upsert")
    rest = [c for c in feed.columns if c not in ("logical_key", "event")]
    machines = valid.groupBy("logical_key", "key").agg(
        F.max_by(F.struct(*rest), F.when(shown, F.col("__at"))).alias("w"), F.max(F.when(shown, F.col("__at"))).alias("at"),
        F.max(F.when(F.col("event") == "removed", F.col("__at"))).alias("gone"))
    last = machines.where("at IS NOT NULL").groupBy("logical_key").agg(F.max_by(F.struct("w", "at", "gone"), "at").alias("m"))
    return last.where("m.gone IS NULL OR m.gone < m.at").select("logical_key", "m.w.*")
