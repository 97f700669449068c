"""Usage rows in the change feed, stored cards, readers that fall behind, and delivery to a sink that goes away."""

import json
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionmill import contracts as C
from sessionmill.operators import feed, registry
from sessionmill.streaming import outage
from sessionmill.streaming import registry_stream as RS
from tests.test_registry import frame, snap

START = datetime(2026, 7, 10, 9, tzinfo=timezone.utc)


def told(spark, rows):
    """Reports from (machine, used, arrival)."""
    def report(machine, used, i):
        codex = None if used is None else ((float(used), 300, None), None, "plus", None)
        return machine, None, None, codex, f"2026-07-10T09:00:{i:02d}Z", i
    return spark.createDataFrame([report(*r) for r in rows], T.StructType([*C.USAGE_REPORT.fields, T.StructField("arrival", T.LongType())]))


def shown(df):
    return sorted((r.logical_key, r.key, r.status) for r in df.collect())


def test_cards_and_reports_after_each_step(spark, tmp_path):
    """Over six steps the stored cards are the fold of the feed; a reader behind the kept steps gets a full state."""
    rng, out, panel, seen = random.Random(3), str(tmp_path), {}, []
    for step in range(6):
        now = START + timedelta(hours=5 * step)
        at = lambda m: (now - timedelta(minutes=m)).strftime("%Y-%m-%dT%H:%M:%SZ")
        rows = [snap(i, agent=f"u{rng.randrange(5)}", machine=rng.choice(["wsl", "windows"]), status=rng.choice(["thinking", "idle", "done"]),
                     at=at(rng.choice([1, 40, 1500]))) for i in range(6)]
        batch = frame(spark, rows).withColumn("received_at", F.lit(now))
        used = [(m, rng.choice([None, 1, 2]), i) for i, m in enumerate(["a", "a", "b"])]
        for m, u, _ in used:
            if m not in panel or panel[m] != u:
                seen.append((step, m, u))
            panel[m] = u
        kept = None if step < 4 else 2
        for _ in range(2 if step == 2 else 1):  # a replayed step changes nothing
            RS.apply_batch(spark, batch, step, out, F.lit(now), arrived_reports=told(spark, used), retain=kept)
        if step < 4:
            rows = RS.read_feed(spark, out)
            assert shown(RS.cards(spark, out)) == shown(feed.card_view(rows, *registry.STREAM_ORDER))
            usage = rows.where("event = 'usage'").orderBy(*registry.STREAM_ORDER).collect()
            assert [(r.batch_id, r.key, r.report.codex and int(r.report.codex.primary.used_percent)) for r in usage] == seen
        if step == 3:
            before = RS.read_feed(spark, out)
            held, schema = before.collect(), before.schema
    late = RS.follow(spark, out, after=2)  # steps 4 and 5 are kept, step 3 is gone
    assert {r.event for r in late.collect()} == {"full", "usage"}
    near = RS.follow(spark, out, after=3)
    assert {r.batch_id for r in near.collect()} == {4, 5}
    whole = spark.createDataFrame(held, schema).unionByName(near.select(*schema.fieldNames()))
    assert shown(RS.cards(spark, out)) == shown(feed.card_view(whole, *registry.STREAM_ORDER))
    for rows in (late, whole, RS.follow(spark, out)):
        newest = feed.newest_reports(rows, *registry.STREAM_ORDER).collect()
        assert {r.machine: r.codex and int(r.codex.primary.used_percent) for r in newest} == panel


def test_delivery_keeps_the_newest_until_the_sink_is_back(spark, tmp_path):
    out, sent = str(tmp_path), []
    down = {1, 2}

    def deliver(rows, batch_id):
        if batch_id in down:
            raise outage.SinkDown
        sent.append((batch_id, [(r.kind, r.key, r.payload) for r in rows.collect()]))

    steps = [
        [("session", "a", "1", 0), ("session", "a", "2", 1), ("usage", "a", "u1", 2)],
        [("session", "a", "3", 5), ("session", "b", "4", 4)],
        [("session", "a", "5", 0), ("stats", "a", "s", 0), ("session", None, "n", 0)],
        [("usage", "a", "u2", 0)],
        [("session", "c", "6", 0)],
    ]
    for i, rows in enumerate(steps):
        batch = spark.createDataFrame(rows, "kind string, key string, payload string, place long")
        for _ in range(2 if i == 2 else 1):
            took = outage.deliver_batch(spark, batch, i, out, ["place"], deliver)
        assert took == (i not in down)
        assert outage.pending(spark, out).count() == {1: 2, 2: 4}.get(i, 0)
    key = lambda rows: sorted(rows, key=json.dumps)
    assert [(i, key(rows)) for i, rows in sent] == [
        (0, key([("session", "a", "2"), ("usage", "a", "u1")])),
        (3, key([("session", "a", "5"), ("session", "b", "4"), ("session", None, "n"), ("stats", "a", "s"), ("usage", "a", "u2")])),
        (4, key([("session", "c", "6")]))]
    with pytest.raises(ValueError):
        outage.deliver_batch(spark, batch, 5, out, ["place"], lambda rows, i: int("x"))
