"""RFC 3339 instants: strict parsing and millisecond rendering."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def parse_rfc3339(value: Column) -> Column:
    """Instant of a full RFC 3339 string; NULL for anything shorter or invalid."""
    return F.when(value.rlike(RFC3339), F.try_to_timestamp(F.upper(value)))


def render_millis(ts: Column) -> Column:
    """``2024-01-01T00:00:00.000Z``; the session time zone must be UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def micros(duration: timedelta) -> int:
    return duration // timedelta(microseconds=1)


def age_micros(ts: Column, now: Column) -> Column:
    return F.unix_micros(now) - F.unix_micros(ts)
