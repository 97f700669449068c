import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from sessionmill import contracts as C
from sessionmill.operators import alerts, entities, feed, registry, segments, views
from sessionmill.operators.segments import SEGMENT_ROWS
from sessionmill.sources import snapshots as SN

NOW = datetime(2026, 7, 10, 12, tzinfo=timezone.utc)


def snap(i, agent="u1", machine="wsl", project="demo", status="thinking", at="2026-07-10T11:59:00Z", needs=False, reason=None, branch=None, jump=None):
    return (agent, "claude-code", machine, project, status, branch, None, needs, reason, (1, 2, 3, 4, 5.0), at, jump, i)


def frame(spark, rows):
    schema = C.SNAPSHOT.jsonValue()
    from pyspark.sql.types import LongType, StructField, StructType

    return spark.createDataFrame(rows, StructType([*StructType.fromJson(schema).fields, StructField("arrival", LongType())]))


def test_changes_new_unchanged_and_edges(spark):
    rows = [snap(0), snap(1), snap(2, status="needs_you", needs=True), snap(3, status="needs_you", needs=True, reason="x"),
            snap(4), snap(5, branch="b"), snap(6, branch="b", jump=("terminal", "/x")), snap(7, machine="windows", needs=True)]
    got = {r.arrival: r for r in registry.registry_changes(frame(spark, rows)).collect()}
    assert [got[i].change_type for i in range(8)] == ["new", "unchanged", "updated", "updated", "updated", "updated", "updated", "new"]
    assert [got[i].entered_needs_you for i in range(8)] == [False, False, True, False, False, False, False, True]
    assert [got[i].status_changed for i in range(8)] == [True, False, True, False, True, False, False, True]
    moved = registry.transitions(registry.registry_changes(frame(spark, rows)))
    assert [(r.from_status, r.to_status) for r in registry.session_history(moved, "wsl/claude-code/u1").collect()] == [
        (None, "thinking"), ("thinking", "needs_you"), ("needs_you", "thinking")]


@pytest.mark.parametrize("hot_rows", [0, SEGMENT_ROWS])
def test_changes_across_segments_and_stored_rows(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(segments, "HOT_ROWS", hot_rows)
    monkeypatch.setattr(segments, "ROWS_PER_SEED", 1 if hot_rows == 0 else 100)
    far = SEGMENT_ROWS * 3
    rows = [snap(0), snap(far), snap(far + 1, status="done")]
    got = {r.arrival: r.change_type for r in registry.registry_changes(frame(spark, rows)).collect()}
    assert got == {0: "new", far: "unchanged", far + 1: "updated"}
    stored = frame(spark, [snap(0)]).drop("arrival")
    again = registry.registry_changes(frame(spark, [snap(5), snap(6, agent="u2")]), stored=stored).collect()
    assert {r.arrival: r.change_type for r in again} == {5: "unchanged", 6: "new"}


def test_ageing(spark):
    old, day, bad = "2026-07-10T11:00:00Z", "2026-07-09T11:00:00Z", "garbage"
    df = frame(spark, [
        snap(0, "fresh"), snap(1, "old", at=old), snap(2, "tool", status="tool_running", at=old), snap(3, "done", status="done", at=old),
        snap(4, "gone", status="needs_you", at=day), snap(5, "bad", at=bad), snap(6, "both", at=day)])
    now = F.lit(NOW)
    stale = {r.agent_id: r.status for r in registry.mark_stale(df, now).collect()}
    assert stale == {"fresh": "thinking", "old": "stale", "tool": "stale", "done": "done", "gone": "needs_you", "bad": "stale", "both": "stale"}
    sweep = {r.agent_id: (r.event, r.to_status) for r in registry.housekeeping(df, now).collect()}
    assert sweep == {"old": ("upsert", "stale"), "tool": ("upsert", "stale"), "gone": ("removed", None), "bad": ("removed", None), "both": ("removed", None)}
    assert {r.agent_id for r in registry.retained(df, now).collect()} == {"fresh", "old", "tool", "done"}


def test_card_view(spark):
    def row(event, key, logical, machine, status, arrival):
        return (event, key, logical, machine, status, arrival)

    rows = [
        row("upsert", "wsl/s/a", "s/a", "wsl", "old", 1), row("full", "wsl/s/b", "s/b", "wsl", "idle", 5),
        row("upsert", "windows/s/b", "s/b", "windows", "done", 6), row("removed", "wsl/s/b", "s/b", "wsl", None, 7),
        row("upsert", "wsl/s/c", "s/c", "wsl", "done", 8), row("removed", "wsl/s/c", "s/c", "wsl", None, 9),
        row("removed", "wsl/s/d", "s/d", "wsl", None, 9), row("upsert", "wsl/s/d", "s/d", "wsl", "idle", 10)]
    df = spark.createDataFrame(rows, "event string, key string, logical_key string, machine string, status string, arrival long")
    assert {(r.logical_key, r.machine, r.status) for r in feed.card_view(df).collect()} == {
        ("s/b", "windows", "done"), ("s/d", "wsl", "idle")}


def greedy(times, cooldown, fired=None):
    out = []
    for t in sorted(set(times)):
        if fired is None or t - fired >= cooldown:
            out.append(t)
            fired = t
    return out


@pytest.mark.parametrize("folded", [0, 1024])
def test_throttle_equals_greedy_fold(spark, monkeypatch, folded):
    monkeypatch.setattr(alerts, "FOLDED_ALERTS", folded)
    rnd = random.Random(2)
    start = datetime(2026, 1, 1, tzinfo=timezone.utc)
    cooldown, times = 120, {}
    for key, gap, n in (("hot", 40, 3000), ("calm", 4000, 50), ("one", 1, 1), ("burst", 1, 900), ("sparse", 200, 90), (None, 90, 200)):
        t, times[key] = 0, []
        for _ in range(n):
            t += rnd.randrange(gap + 1)
            times[key].append(t)
    rows = [(k, start + timedelta(seconds=t)) for k, ts in times.items() for t in ts]
    df = spark.createDataFrame(rows, "logical_key string, alert_at timestamp")
    got = {}
    for r in alerts.throttle(df, timedelta(seconds=cooldown)).collect():
        got.setdefault(r.logical_key, []).append(int((r.alert_at.replace(tzinfo=timezone.utc) - start).total_seconds()))
    assert {k: sorted(v) for k, v in got.items()} == {k: greedy(v, cooldown) for k, v in times.items()}
    last = spark.createDataFrame([("hot", start + timedelta(seconds=100))], "logical_key string, fired_at timestamp")
    again = [int((r.alert_at.replace(tzinfo=timezone.utc) - start).total_seconds()) for r in
             alerts.throttle(df, timedelta(seconds=cooldown), last_fired=last).where("logical_key = 'hot'").collect()]
    assert sorted(again) == greedy(times["hot"], cooldown, 100)
    assert alerts.throttle(df.limit(0)).isEmpty()
    undated = spark.createDataFrame([("a", None), ("a", start), ("a", start)], df.schema)
    assert alerts.throttle(undated).count() == 1


def test_throttle_runs_without_python_workers_and_cuts_a_hot_slot(spark, monkeypatch):
    """Alerts every few microseconds: one key, chains that never meet, many alerts in a slot."""
    monkeypatch.setattr(segments, "HOT_ROWS", 50)
    monkeypatch.setattr(segments, "ROWS_PER_SEED", 10)
    monkeypatch.setattr(alerts, "SEGMENT_ROWS", 64)
    df = spark.range(20_000).select(F.lit("k").alias("logical_key"), F.timestamp_micros(F.col("id") * 7).alias("alert_at"))
    fired = alerts.throttle(df, timedelta(microseconds=1000))
    assert "Python" not in fired._jdf.queryExecution().toString() and "Pandas" not in fired._jdf.queryExecution().toString()
    assert sorted(r.t for r in fired.select(F.unix_micros("alert_at").alias("t")).collect()) == greedy([7 * i for i in range(20_000)], 1000)


def plain_merge(rows, overlap):
    """The two merge rules on lists: by id, then lone pairs of a project."""
    def fresh(r):
        return (-r[1], r[2], r[3])

    def merge(group):
        best, asking = min(group, key=fresh), [r for r in group if r[5]]
        return (best[0], best[1], best[2], best[3], best[4], bool(asking), best[6] if best[5] else (min(asking, key=fresh)[6] if asking else None))

    ids = {}
    for r in rows:
        ids.setdefault(r[3], []).append(r)
    projects = {}
    for r in map(merge, ids.values()):
        projects.setdefault(r[0], []).append(r)
    out = []
    for group in projects.values():
        paired = len(group) == 2 and group[0][2] != group[1][2] and abs(group[0][1] - group[1][1]) <= overlap
        out += [merge(group)] if paired else group
    return sorted((r[3], r[2], r[5], str(r[6])) for r in out)


def test_merging_equals_the_rules_on_lists(spark):
    rnd = random.Random(21)
    spelled = {"q:/work/shop": ["/mnt/q/Work/Shop", "Q:\\work\\shop\\", "q:/WORK/shop/"], "/srv/app": ["/srv/app", "/srv/App/"], "": [""], "lone": ["lone"]}
    seconds = int(C.OVERLAP_WINDOW.total_seconds())
    for case in range(8):
        rows, frames = [], []
        for i in range(rnd.randrange(1, 7)):
            project = rnd.choice(list(spelled))
            t = rnd.choice([0, seconds // 2, seconds, seconds + 1, 5 * seconds])
            needs, machine, agent = rnd.random() < 0.4, rnd.choice(["wsl", "windows", "far"]), f"s{rnd.randrange(4)}"
            if any((r[2], r[3]) == (machine, agent) for r in rows):
                continue
            project = next((r[0] for r in rows if r[3] == agent), project)
            stamp = (datetime(2025, 2, 3, 4, tzinfo=timezone.utc) + timedelta(seconds=t)).strftime("%Y-%m-%dT%H:%M:%SZ")
            rows.append((project, t, machine, agent, None, needs, f"why {i}" if needs else None))
            frames.append(snap(i, agent, machine, rnd.choice(spelled[project]), at=stamp, needs=needs, reason=f"why {i}" if needs else None))
        got = entities.logical_sessions(frame(spark, frames)).collect()
        assert sorted((r.agent_id, r.machine, r.needs_user, str(r.needs_user_reason)) for r in got) == plain_merge(rows, seconds), rows


def test_presentation_orders(spark):
    """Newest first; panel by machine, rank of the status, newest first; the order is part of the result."""
    rnd = random.Random(3)
    rows = [snap(i, f"s{i}", rnd.choice(["wsl", "windows"]), f"p{i}", rnd.choice(["done", "idle", "needs_you", "thinking", "failed"]),
                 f"2025-01-0{rnd.randrange(1, 9)}T0{rnd.randrange(9)}:00:00Z") for i in range(40)]
    df = frame(spark, rows).repartition(7)
    newest = [r.last_activity for r in entities.newest_first(df).collect()]
    assert newest == sorted(newest, reverse=True)
    panel = [(r.machine, r.status_rank, r.last_activity) for r in views.panel(df).collect()]
    assert panel == sorted(sorted(panel, key=lambda r: r[2], reverse=True), key=lambda r: r[:2])


def test_bodies(spark):
    good = ('{"agent_id":"a","source":"vps","machine":"m","project":"","status":"failed","needs_user":true,'
            '"usage":{"input_tokens":1,"output_tokens":2,"cache_read_tokens":3,"cache_creation_tokens":4},"last_activity":"","jump":{"type":"ssh","target":"u@h"}}')
    bodies = {"one": good, "two": f"[{good},{good}]", "none": "[]", "mixed": f'[{good},{{"agent_id":"b"}}]', "source": good.replace("vps", "bash"),
              "negative": good.replace('"input_tokens":1', '"input_tokens":-1'), "text": "nope", "jump": good.replace("ssh", "fax")}
    df = spark.createDataFrame(list(bodies.items()), "name string, body string")
    accepted, rejected = SN.ingest_snapshots(df)
    assert sorted((r.name, r.position) for r in accepted.collect()) == [("one", 0), ("two", 0), ("two", 1)]
    assert {r.name for r in rejected.collect()} == {"mixed", "source", "negative", "text", "jump"}
    row = accepted.where("name = 'one'").first()
    assert row.jump.target == "u@h" and row.usage.context_pct is None and row.git_branch is None
