"""Alert throttling: at most one alert per session and cooldown, counted from the last fired one.

The rule is sequential per key, yet a key may hold most alerts. Time is cut into slots of one cooldown.
A slot without alerts ends every cooldown that runs into it, so each stretch of filled slots starts with
a fire and stands alone. Short stretches are folded as sorted arrays of bounded size. In the others
every alert knows its hop, the alert that fires next after it, and maps "from the alert that enters a
segment to the one that leaves it" are joined pairwise into segments of 2, 4, 8 … slots. An alert that
enters a segment lies in its first slot or is the first of its second, so each level holds about half of
the rows below it. From the top the fires are then handed down, one for each half.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionmill import contracts as C
from sessionmill.functions import paths
from sessionmill.functions.times import micros
from sessionmill.operators.segments import SEGMENT_ROWS, Running, running
from sessionmill.plans.tables import materialize

# Alerts of a stretch that are folded as one array; longer stretches go through the tree.
FOLDED_ALERTS = 1024
STRETCH = ["k", "stretch"]


def throttle(
    alerts: DataFrame,
    cooldown: timedelta = C.ALERT_COOLDOWN,
    key: str = "logical_key",
    at: str = "alert_at",
    last_fired: DataFrame | None = None,
) -> DataFrame:
    """Alerts that fire, from rows (key, at): the first, then the first one a cooldown later, and so on.

    Equal times of one key are one alert; null is a key like any other, rows without a time never fire.
    ``last_fired`` (key, fired_at) continues an earlier run.
    """
    width = micros(cooldown)
    # a struct, since joins match nulls inside one
    rows = alerts.select(F.struct(F.col(key).alias("v")).alias("k"), F.unix_micros(at).alias("t")).where(F.col("t").isNotNull())
    if last_fired is not None:
        # what the earlier fire blocks cannot fire, and the first alert after that always does
        until = last_fired.select(F.struct(F.col(key).alias("v")).alias("k"), (F.unix_micros("fired_at") + width).alias("until"))
        rows = rows.join(until, "k", "left").where(F.col("until").isNull() | (F.col("t") >= F.col("until"))).drop("until")
    slot = ((F.col("t") - F.pmod("t", F.lit(width))) / width).cast("bigint")
    rows = materialize(rows.distinct().withColumn("slot", slot), "alerts")
    slots = materialize(_stretches(rows), "slots")
    placed = rows.join(slots, ["k", "slot"])

    few = placed.where(F.col("alerts") <= FOLDED_ALERTS).groupBy(*STRETCH).agg(F.array_sort(F.collect_list("t")).alias("ts"))
    fired = few.select("k", F.explode(_greedy(F.col("ts"), width)).alias("t"))
    longest = slots.where(F.col("alerts") > FOLDED_ALERTS).agg(F.max("length")).first()[0]
    if longest is not None:
        hops = _hops(placed.where(F.col("alerts") > FOLDED_ALERTS), width)
        fired = fired.unionByName(_tree_fires(hops, (longest - 1).bit_length()))
    return fired.select(F.col("k.v").alias(key), F.timestamp_micros("t").alias(at))


def _stretches(rows: DataFrame) -> DataFrame:
    """Filled slots with their stretch, place in it, first alert and that of the next two; size of the stretch."""
    filled = rows.groupBy("k", "slot").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first"))
    filled = filled.withColumn("stretch", F.col("slot") - F.row_number().over(Window.partitionBy("k").orderBy("slot")))
    whole, ordered = Window.partitionBy(*STRETCH), Window.partitionBy(*STRETCH).orderBy("slot")
    return filled.select(
        "k", "slot", "stretch", "first", F.lead("first", 2).over(ordered).alias("beyond"),
        (F.col("slot") - F.min("slot").over(whole)).alias("place"), F.sum("n").over(whole).alias("alerts"),
        F.count(F.lit(1)).over(whole).alias("length"))


def _greedy(times: Column, width: int) -> Column:
    def step(fired: Column, t: Column) -> Column:
        free = F.coalesce(t >= F.try_element_at(fired, F.lit(-1)) + width, F.lit(True))
        return F.when(free, F.concat(fired, F.array(t))).otherwise(fired)
    return F.aggregate(times, F.array().cast("array<bigint>"), step)


def _hops(placed: DataFrame, width: int) -> DataFrame:
    """(k, stretch, place, t, head, hop, hop_place): the alert that fires next after one that fires at ``t``.

    It lies in the next slot, if that has an alert a cooldown later; else it is the first of the slot after that.
    """
    offers = placed.select(*STRETCH, "place", (-F.col("t")).alias("back"), F.lit(0).alias("asks"))
    asks = placed.select(
        *STRETCH, (F.col("place") + 1).alias("place"), (-F.col("t") - width).alias("back"), F.lit(1).alias("asks"),
        "t", "beyond", (F.col("t") == F.col("first")).alias("head"))
    both = offers.unionByName(asks, allowMissingColumns=True)
    # backwards in time, where at most this many different times lie in a piece
    both = both.withColumn("piece", F.floor(F.col("back") / F.lit(SEGMENT_ROWS)).cast("bigint"))
    near = Running("max", F.when(F.col("asks") == 0, F.col("back")))
    asked = running(both, [*STRETCH, "place"], ["piece"], ["back", "asks"], near=near).where("asks = 1")
    return asked.select(
        *STRETCH, (F.col("place") - 1).alias("place"), "t", "head", F.coalesce(-F.col("near"), "beyond").alias("hop"),
        F.when(F.col("near").isNotNull(), F.col("place")).otherwise(F.col("place") + 1).alias("hop_place"))


def _segment(place: str, level: int) -> Column:
    return F.shiftright(F.col(place), level)


def _tree_fires(hops: DataFrame, levels: int) -> DataFrame:
    """(k, t) of all fires in stretches of at most 2**levels slots."""
    # maps[j]: for each alert that may enter a segment of 2**j slots the alert that fires first after the segment
    maps = [materialize(hops, "hops")]
    for level in range(1, levels):
        below = maps[-1]
        start = F.shiftleft(_segment("place", level), level)
        inside = F.col("hop").isNotNull() & (_segment("place", level) == _segment("hop_place", level))
        entering = below.where((F.col("place") == start) | (F.col("head") & (F.col("place") == start + 1)))
        entering = entering.withColumn("via", F.when(inside, F.col("hop")))
        onward = below.select(*STRETCH, F.col("t").alias("via"), F.col("hop").alias("on"), F.col("hop_place").alias("on_place"), F.lit(True).alias("met"))
        joined = entering.join(onward, [*STRETCH, "via"], "left")
        maps.append(materialize(joined.select(
            *STRETCH, "place", "t", "head", F.when(F.col("met"), F.col("on")).otherwise(F.col("hop")).alias("hop"),
            F.when(F.col("met"), F.col("on_place")).otherwise(F.col("hop_place")).alias("hop_place")), "hops"))
    fired = _starts(maps[0])
    for level in range(levels - 1, -1, -1):
        fires_next = F.col("hop").isNotNull() & (_segment("place", level + 1) == _segment("hop_place", level + 1))
        here = maps[level].select(*STRETCH, "t", "hop", "hop_place")
        both = F.array(
            F.struct("place", "t"), F.when(fires_next, F.struct(F.col("hop_place").alias("place"), F.col("hop").alias("t"))))
        fired = fired.join(here, [*STRETCH, "t"], "left").select(*STRETCH, F.explode(both).alias("f"))
        fired = fired.where(F.col("f").isNotNull()).select(*STRETCH, "f.place", "f.t")
    return fired.select("k", "t")


def _starts(hops: DataFrame) -> DataFrame:
    """The first alert of each stretch, which always fires."""
    return hops.where(F.col("head") & (F.col("place") == 0)).select(*STRETCH, "place", "t")


# --- fixed values: alert wording ---------------------------------------------
ALERT_NAMES = {C.SOURCE_A: "Claude Code", C.SOURCE_B: "Codex"}
ALERT_TITLE = " needs you — "
ALERT_DEFAULT = "waiting on your input"
# ---------------------------------------------------------------------------


def alert_text(source: Column, project: Column, machine: Column, reason: Column) -> tuple[Column, Column]:
    """(title, body) of one alert."""
    name = source
    for value, shown in ALERT_NAMES.items():
        name = F.when(source == value, shown).otherwise(name)
    title = F.concat(name, F.lit(ALERT_TITLE), paths.alert_project(project))
    body = F.concat(F.lit("["), machine, F.lit("] "), F.coalesce(reason, F.lit(ALERT_DEFAULT)))
    return title, body
