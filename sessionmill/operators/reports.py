"""Machine usage reports: exact limits, plan readings, assembly, freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionmill import contracts as C
from sessionmill.functions.times import age_micros, micros, parse_rfc3339, render_millis
from sessionmill.operators.segments import Running, integer_segment, running


def newest_limits(facts: DataFrame, scope: tuple[str, ...] = ("machine",)) -> DataFrame:
    """Newest rate limits over all files of a scope; a reading without a time sorts lowest."""
    seen = F.coalesce("rate_limits.observed_at", F.timestamp_seconds(F.lit(0)))
    return (
        facts.where((F.col("source") == C.SOURCE_B) & F.col("rate_limits").isNotNull())
        .groupBy(*scope).agg(F.max_by("rate_limits", F.struct(seen, F.col("file"))).alias("codex"))
    )


def parse_plan_windows(bodies: DataFrame, body: str = "body", observed_at: str = "observed_at") -> DataFrame:
    """Plan-window response bodies to ``reading``, or ``error`` when a required window is absent.

    A window without utilization counts as absent; unknown fields are ignored.
    """
    wire = "struct<utilization:double,resets_at:string>"
    parsed = F.from_json(
        F.col(body), f"five_hour {wire}, seven_day {wire}, seven_day_opus {wire}, seven_day_sonnet {wire}, __bad string",
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    rows = bodies.withColumn("__w", parsed)

    def window(name: str) -> Column:
        w = F.col(f"__w.{name}")
        return F.when(w["utilization"].isNotNull(), F.struct(
            w["utilization"].alias("used_percent"), parse_rfc3339(w["resets_at"]).alias("resets_at")))

    error = (
        F.when(F.col("__w").isNull() | F.col("__w.__bad").isNotNull(), "invalid body")
        .when(window("five_hour").isNull(), "missing five_hour window")
        .when(window("seven_day").isNull(), "missing seven_day window"))
    reading = F.struct(*[window(n).alias(n) for n in ("five_hour", "seven_day", "seven_day_opus", "seven_day_sonnet")],
                       F.col(observed_at).alias("observed_at"))
    return rows.withColumn("error", error).withColumn("reading", F.when(error.isNull(), reading)).drop("__w")


def fresh_readings(readings: DataFrame, now: Column) -> DataFrame:
    """Newest good reading per machine, withheld when too old."""
    newest = (
        readings.where(F.col("error").isNull()).groupBy("machine")
        .agg(F.max_by("reading", "reading.observed_at").alias("claude_exact")))
    return newest.where(age_micros(F.col("claude_exact.observed_at"), now) < micros(C.EXACT_FRESH))


def usage_report(machines: DataFrame, estimates: DataFrame, exact: DataFrame, limits: DataFrame, now: Column) -> DataFrame:
    """One report row per machine."""
    return (
        machines.select("machine").distinct()
        .join(estimates, "machine", "left").join(exact, "machine", "left").join(limits, "machine", "left")
        .select("machine", "claude", "claude_exact", "codex", render_millis(now).alias("reported_at"))
    )


def changed_reports(reports: DataFrame, order: str, shown: tuple[str, ...] = ("claude", "claude_exact", "codex")) -> DataFrame:
    """Reports whose content differs from the machine's previous one; the report time is ignored."""
    content = F.struct(*shown)
    seen = running(reports.withColumn("__seg", integer_segment(order)), ["machine"], ["__seg"], [order],
                   __was=Running("prev", content))
    return seen.where(~content.eqNullSafe(F.col("__was"))).drop("__seg", "__was")


def newest_per_machine(reports: DataFrame, order: str) -> DataFrame:
    rest = F.struct(*reports.columns)
    return reports.groupBy("machine").agg(F.max_by(rest, order).alias("r")).select("r.*")


def account_exact(reports: DataFrame) -> DataFrame:
    """Newest exact reading over all machines, as one row."""
    return reports.where(F.col("claude_exact").isNotNull()).agg(
        F.max_by("claude_exact", "claude_exact.observed_at").alias("claude_exact"))


def live_reports(reports: DataFrame, now: Column) -> DataFrame:
    """Reports younger than three minutes, by machine; a bad report time is not live."""
    age = age_micros(parse_rfc3339(F.col("reported_at")), now)
    return reports.where(age < micros(C.REPORT_FRESH)).orderBy("machine")
