"""Ranked live views with their display columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionmill import contracts as C
from sessionmill.functions import display as D
from sessionmill.functions import paths as P
from sessionmill.operators.alerts import alert_text
from sessionmill.operators.usage import total_tokens


def live_counters(sessions: DataFrame) -> DataFrame:
    """One row: working, needs_you, failed, active and the overall tone."""
    status = F.col("status")
    counts = sessions.agg(
        F.count_if(status.isin("thinking", "tool_running")).alias("working"),
        F.count_if(status == "needs_you").alias("needs_you"),
        F.count_if(status == "failed").alias("failed"),
    )
    return counts.withColumn("active", F.col("working") + F.col("needs_you")).withColumn(
        "tone",
        F.when(F.col("failed") > 0, "failed").when(F.col("needs_you") > 0, "needs-you")
        .when(F.col("working") > 0, "working").otherwise("quiet"))


def panel(sessions: DataFrame) -> DataFrame:
    """By machine; within it attention first, then newest activity (string order)."""
    return sessions.withColumn("status_rank", D.status_rank(F.col("status"))).orderBy(
        "machine", "status_rank", F.desc("last_activity"))


def session_cards(sessions: DataFrame, now: Column, limits: tuple[float, float, float] = D.TONES) -> DataFrame:
    """Card columns of each session."""
    usage = F.col("usage")
    pct = F.greatest(F.least(usage["context_pct"], F.lit(100).cast("float")), F.lit(0).cast("float"))
    jump = F.when(F.col("jump.type") == "terminal", F.col("jump.target"))
    return sessions.select(
        "machine", "source", "agent_id", "last_activity", "status", "needs_user",
        D.status_label(F.col("status")).alias("status_label"),
        D.source_label(F.col("source")).alias("source_label"),
        P.project_name(F.col("project")).alias("project_name"),
        D.ago(F.col("last_activity"), now).alias("ago"),
        D.compact(total_tokens(usage)).alias("tokens"),
        D.compact(usage["input_tokens"]).alias("tokens_in"),
        D.compact(usage["output_tokens"]).alias("tokens_out"),
        D.tone(pct, limits).alias("context_tone"),
        P.editor_link(F.col("machine"), jump).alias("editor_link"),
        P.terminal_path(F.col("machine"), jump).alias("terminal_path"),
    )


def usage_panel(reports: DataFrame, account: DataFrame, now: Column) -> DataFrame:
    """One row per shown window: exact account windows, exact machine limits, else the estimate.

    ``account`` is the one-row result of ``account_exact``; when it holds a
    reading the estimates stand down.
    """
    exact = account.where(F.col("claude_exact").isNotNull())

    def percent(used: Column) -> list[Column]:
        return [F.floor(used + 0.5).cast("bigint").alias("pct"), D.tone(used).alias("tone")]

    labels = [("5h", "five_hour"), ("week", "seven_day"), ("opus", "seven_day_opus"), ("sonnet", "seven_day_sonnet")]
    account_rows = exact.select(F.explode(F.array(*[
        F.struct(F.lit(label).alias("label"), F.col(f"claude_exact.{name}").alias("w")) for label, name in labels])).alias("e")
    ).where(F.col("e.w").isNotNull()).select(
        F.lit("account").alias("machine"), F.lit("claude").alias("who"), F.lit("exact").alias("confidence"),
        F.col("e.label").alias("label"), *percent(F.col("e.w.used_percent")),
        F.lit(None).cast("string").alias("tokens"),
        F.coalesce(D.resets_in(F.col("e.w.resets_at"), now), F.lit("")).alias("resets"))
    codex = reports.where(F.col("codex.primary").isNotNull()).select("machine", F.explode(F.array(
        F.struct(F.lit("5h").alias("label"), F.col("codex.primary").alias("w")),
        F.struct(F.lit("week").alias("label"), F.col("codex.secondary").alias("w")))).alias("e")
    ).where(F.col("e.w").isNotNull()).select(
        "machine", F.lit("codex").alias("who"), F.lit("exact").alias("confidence"),
        F.col("e.label").alias("label"), *percent(F.col("e.w.used_percent")),
        F.lit(None).cast("string").alias("tokens"),
        F.coalesce(D.resets_in(F.timestamp_seconds("e.w.resets_at"), now), F.lit("")).alias("resets"))
    estimates = reports.where(F.col("claude").isNotNull() & ~exact.exists()).select(
        "machine", F.explode(F.array(
            F.struct(F.lit("5h").alias("label"), F.col("claude.five_hour").alias("w"), F.col("claude.five_hour_resets_at").alias("r")),
            F.struct(F.lit("week").alias("label"), F.col("claude.weekly").alias("w"), F.lit(None).cast("timestamp").alias("r")))).alias("e")
    ).select(
        "machine", F.lit("claude").alias("who"), F.lit("estimated").alias("confidence"), F.col("e.label").alias("label"),
        F.lit(None).cast("bigint").alias("pct"), F.lit(None).cast("string").alias("tone"),
        D.compact(total_tokens(F.col("e.w.tokens"))).alias("tokens"),
        F.coalesce(D.resets_in(F.col("e.r"), now), F.lit("")).alias("resets"))
    return account_rows.unionByName(codex).unionByName(estimates)


def stats_panel(totals: DataFrame) -> DataFrame:
    """Rows of ``all_machines`` with display columns."""
    return totals.select(
        F.coalesce("source", F.lit("all")).alias("source"), "sessions", "messages",
        D.compact(F.col("total_tokens")).alias("tokens"), D.money(F.col("est_cost_usd")).alias("cost"))


def alert_view(fired: DataFrame) -> DataFrame:
    """Title and body of each alert."""
    title, body = alert_text(F.col("source"), F.col("project"), F.col("machine"), F.col("needs_user_reason"))
    return fired.withColumn("title", title).withColumn("body", body)


def register_views(spark, **frames: DataFrame) -> None:
    """Expose derived tables to Spark SQL under their names."""
    for name, frame in frames.items():
        frame.createOrReplaceTempView(name)
