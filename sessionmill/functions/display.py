"""Display columns of the session, usage and alert views."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sessionmill.contracts import SOURCE_A
from sessionmill.functions.times import parse_rfc3339

# --- fixed values: labels ---------------------------------------------------
STATUS_LABELS = {
    "thinking": "thinking", "tool_running": "running", "needs_you": "needs you",
    "done": "done · waiting", "failed": "failed", "idle": "idle", "stale": "stale",
}
STATUS_RANK = ["needs_you", "failed", "tool_running", "thinking", "done", "idle", "stale"]
UNRANKED = 9
TONES = (50, 70, 90)
# ---------------------------------------------------------------------------


def _fixed(v: Column, digits: int, exact_ties: list[float]) -> Column:
    """Fixed decimals by the exact binary value of ``v``.

    ``format_number`` rounds the exact value half to even; only the fractions
    in ``exact_ties`` are true ties, and those go up.
    """
    tie = (v - F.floor(v)).isin(exact_ties)
    up = F.when(tie, v + F.lit(0.5 * 10.0 ** -digits)).otherwise(v)
    return F.replace(F.format_number(up, digits), F.lit(","), F.lit(""))


def compact(n: Column) -> Column:
    """1234 as ``1.2k``, 3400000 as ``3.4M``."""
    d = n.cast("double")
    return (
        F.when(n >= 1_000_000, F.concat(_fixed(d / 1_000_000, 1, [0.25, 0.75]), F.lit("M")))
        .when(n >= 1_000, F.concat(_fixed(d / 1_000, 1, [0.25, 0.75]), F.lit("k")))
        .otherwise(n.cast("string"))
    )


def _whole(seconds: Column, unit: int) -> Column:
    return F.floor(seconds / unit).cast("bigint").cast("string")


def ago(instant: Column, now: Column) -> Column:
    """Age of an RFC 3339 string; a future instant reads ``now``, an invalid one is empty."""
    ts = parse_rfc3339(instant)
    s = F.greatest(F.floor((F.unix_millis(now) - F.unix_millis(ts)) / 1000), F.lit(0))
    return (
        F.when(ts.isNull(), "")
        .when(s < 10, "now")
        .when(s < 60, F.concat(s.cast("string"), F.lit("s ago")))
        .when(s < 3600, F.concat(_whole(s, 60), F.lit("m ago")))
        .when(s < 86400, F.concat(_whole(s, 3600), F.lit("h ago")))
        .otherwise(F.concat(_whole(s, 86400), F.lit("d ago")))
    )


def resets_in(target: Column, now: Column) -> Column:
    """Countdown to an instant, empty once passed."""
    s = F.floor((F.unix_millis(target) - F.unix_millis(now)) / 1000)
    h = F.floor(s / 3600)
    m = F.floor((s % 3600) / 60).cast("string")
    return (
        F.when(s <= 0, "")
        .when(h > 24, F.concat(F.lit("resets in "), _whole(h, 24), F.lit("d "), (h % 24).cast("string"), F.lit("h")))
        .when(h > 0, F.concat(F.lit("resets in "), h.cast("string"), F.lit("h "), F.lpad(m, 2, "0"), F.lit("m")))
        .otherwise(F.concat(F.lit("resets in "), m, F.lit("m")))
    )


def tone(pct: Column, limits: tuple[float, float, float] = TONES) -> Column:
    elevated, high, critical = limits
    return F.when(pct > critical, "critical").when(pct > high, "high").when(pct > elevated, "elevated").otherwise("ok")


def money(v: Column) -> Column:
    return (
        F.when(v.isNull(), "—")
        .when(v >= 100, F.concat(F.lit("$"), F.format_number(F.floor(v + 0.5), 0)))
        .otherwise(F.concat(F.lit("$"), _fixed(v, 2, [0.125, 0.375, 0.625, 0.875])))
    )


def status_label(status: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for kv in STATUS_LABELS.items() for x in kv])
    return F.coalesce(F.try_element_at(labels, status), status)


def source_label(source: Column) -> Column:
    return F.when(source == SOURCE_A, "claude").otherwise(source)


def status_rank(status: Column) -> Column:
    at = F.array_position(F.array(*[F.lit(s) for s in STATUS_RANK]), status)
    return F.when(at > 0, at - 1).otherwise(UNRANKED).cast("int")
