"""Token usage: message dedup, cumulative-to-delta, ownership, events, cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionmill import contracts as C
from sessionmill.operators.facts import SEGMENT, newest, order_key, with_segment
from sessionmill.operators.segments import Running, running


def placed_messages(records: DataFrame) -> DataFrame:
    """Last write per (file, message id) with its place (``at``): streamed repeats carry cumulative usage."""
    named = records.where(F.col("message_id").isNotNull() & F.col("tokens").isNotNull())
    placed = named.select("file", "source", "message_id", order_key().alias("at"), "ts", "tokens")
    return merge_messages(placed)


def merge_messages(placed: DataFrame) -> DataFrame:
    last = placed.groupBy("file", "source", "message_id").agg(F.max_by(F.struct("at", "ts", "tokens"), "at").alias("w"))
    return last.select("file", "source", "message_id", "w.at", "w.ts", "w.tokens")


def message_usage(records: DataFrame) -> DataFrame:
    return placed_messages(records).drop("at")


def last_totals(records: DataFrame) -> DataFrame:
    """(file, total): the cumulative total that the next increment starts from."""
    timed = F.when(F.col("ts").isNotNull(), F.col("total"))
    return records.groupBy("file").agg(newest(timed).alias("total")).where(F.col("total").isNotNull())


def usage_deltas(records: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Cumulative totals to increments.

    Records without a time do not move the baseline. A total that shrank in
    input or output restarts the count. Increments without input and output
    are skipped. ``stored``: the last totals of files (:func:`last_totals`) before these records.
    """
    totals = with_segment(records.where(F.col("total").isNotNull() & F.col("ts").isNotNull())
                          .select("file", "source", "seq", "line", "pos", "ts", "total"))
    segments = SEGMENT
    if stored is not None:
        segments = ["__new", *SEGMENT]
        first = stored.select("file", "total").withColumns({c: F.lit(0).cast("bigint") for c in ("seq", "line", "cut")}).withColumn("__new", F.lit(False))
        totals = totals.withColumn("__new", F.lit(True)).unionByName(first.withColumn("pos", F.lit(0)), allowMissingColumns=True)
    seen = running(totals, ["file"], segments, ["seq", "line", "pos"], before=Running("prev", F.col("total")))
    seen = seen if stored is None else seen.where("__new")
    zero = F.lit(0).cast("bigint")

    def now_(f: str) -> Column:
        return F.col(f"total.{f}")

    def was(f: str) -> Column:
        return F.coalesce(F.col(f"before.{f}"), zero)

    restart = (now_("input_tokens") < was("input_tokens")) | (now_("output_tokens") < was("output_tokens"))

    def step(f: str) -> Column:
        return F.when(restart, now_(f)).otherwise(F.greatest(now_(f) - was(f), zero))

    fresh, cached, out = step("input_tokens"), step("cached_input_tokens"), step("output_tokens")
    return seen.where((fresh > 0) | (out > 0)).select(
        "file", "source", "seq", "line", "ts",
        F.struct(
            F.greatest(fresh - cached, zero).alias("input_tokens"), out.alias("output_tokens"),
            cached.alias("cache_read_tokens"), zero.alias("cache_creation_tokens"),
        ).alias("tokens"),
    )


def owned_messages(messages: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """One row per message id over all files (of a ``scope``): the latest (ts, file) copy owns it.

    An aggregate, not a ranking window: copies of one message merge on the map side.
    """
    rest = [c for c in messages.columns if c not in ("message_id", *scope)]
    return (
        messages.where(F.col("ts").isNotNull())
        .groupBy(*scope, "message_id")
        .agg(F.max_by(F.struct(*rest), F.struct("ts", "file")).alias("w"))
        .select(*scope, "message_id", *[F.col(f"w.{c}").alias(c) for c in rest])
    )


def usage_events(records: DataFrame) -> DataFrame:
    """Both dialects as one event table: (file, source, message_id, ts, tokens)."""
    a = owned_messages(message_usage(records))
    b = usage_deltas(records).select("file", "source", "ts", "tokens")
    return a.unionByName(b, allowMissingColumns=True).select("file", "source", "message_id", "ts", "tokens")


# --- fixed values: list prices in USD per million tokens (input, output) ----
# first match wins; ("prefix" | "contains", needle, input rate, output rate)
PRICE_RULES = [
    ("prefix", "claude-fable", 10.0, 50.0),
    ("prefix", "claude-mythos", 10.0, 50.0),
    ("contains", "3-opus", 15.0, 75.0),
    ("contains", "opus-3", 15.0, 75.0),
    ("contains", "opus", 5.0, 25.0),
    ("contains", "sonnet", 3.0, 15.0),
    ("contains", "haiku", 1.0, 5.0),
]
CACHE_READ_FACTOR = 0.1
CACHE_WRITE_FACTOR = 1.25
# ---------------------------------------------------------------------------


def price_per_mtok(model: Column, rules: list[tuple[str, str, float, float]] | None = None) -> Column:
    """STRUCT<input, output> of the first matching rule, NULL when none matches."""
    lowered = F.lower(model)
    out = None
    for how, needle, rate_in, rate_out in rules or PRICE_RULES:
        test = lowered.startswith(needle) if how == "prefix" else lowered.contains(needle)
        price = F.struct(F.lit(rate_in).alias("input"), F.lit(rate_out).alias("output"))
        out = F.when(test, price) if out is None else out.when(test, price)
    return out


def event_cost(source: Column, model: Column, tokens: Column, rules=None) -> Column:
    """API-equivalent USD of one event; never priced for the cumulative dialect."""
    price = price_per_mtok(model, rules)
    mtok = F.lit(1_000_000.0)
    cost = (
        tokens["input_tokens"] / mtok * price["input"]
        + tokens["output_tokens"] / mtok * price["output"]
        + tokens["cache_read_tokens"] / mtok * price["input"] * F.lit(CACHE_READ_FACTOR)
        + tokens["cache_creation_tokens"] / mtok * price["input"] * F.lit(CACHE_WRITE_FACTOR)
    )
    return F.when(source != C.SOURCE_B, cost)


def file_models(records: DataFrame) -> DataFrame:
    """Newest model per file; the price of a whole session follows it."""
    return records.where(F.col("model").isNotNull()).groupBy("file").agg(newest("model").alias("model"))


def total_tokens(tokens: Column) -> Column:
    return sum((tokens[f] for f in C.TOKEN_FIELDS[1:]), tokens[C.TOKEN_FIELDS[0]])
