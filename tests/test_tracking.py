"""The tracking stream step by step: merged facts, retention, prompts in and out of time, increments."""

import json
import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from sessionmill import contracts as C
from sessionmill.operators import facts as FA
from sessionmill.operators import usage as U
from sessionmill.operators.records import parse_records
from sessionmill.streaming import tracking

START = datetime(2026, 7, 10, 9, tzinfo=timezone.utc)


def stamp(seconds):
    return (START + timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%SZ")


def said(rng, session, at):
    kind = rng.randrange(5)
    base = {"timestamp": stamp(at), "sessionId": session, "gitBranch": rng.choice(["", "a", "b"])}
    if kind == 0:
        return {**base, "type": "user", "message": {"content": "x"}, "cwd": rng.choice(["/a", "/b"])}
    if kind == 1:
        return {**base, "type": "assistant", "message": {"id": f"m{rng.randrange(3)}", "model": "claude-opus-4", "stop_reason": rng.choice([None, "end_turn"]),
                "usage": {"input_tokens": rng.randrange(9), "output_tokens": rng.randrange(9)}, "content": []}}
    if kind == 2:
        return {**base, "type": "assistant", "message": {"content": [{"type": "tool_use", "id": f"c{rng.randrange(3)}", "name": "Bash", "input": {"command": "ls"}}]}}
    if kind == 3:
        return {**base, "type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": f"c{rng.randrange(3)}", "content": "ok"}]}}
    return "{broken"


def total(at, given, out, cached=0):
    record = {"type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": {
        "input_tokens": given, "cached_input_tokens": cached, "output_tokens": out}}}}
    return record if at is None else {**record, "timestamp": stamp(at)}


class Stream:
    """Lines and hooks of one step after the other through the tracking stream."""

    def __init__(self, spark, folder, **limits):
        self.spark, self.folder, self.out, self.limits, self.steps = spark, folder, f"{folder}/out", {"buckets": 4, **limits}, 0
        spark.createDataFrame([], C.LINES).write.parquet(f"{folder}/lines")
        spark.createDataFrame([], "value string, received_at timestamp, ord long").write.parquet(f"{folder}/hooks")

    def step(self, rows=(), hooks=()):
        lines = [(f, source, self.steps, i, v if isinstance(v, str) else json.dumps(v)) for i, (f, source, v) in enumerate(rows)]
        told = [(json.dumps(v), START + timedelta(seconds=at), i) for i, (v, at) in enumerate(hooks)]
        self.steps += 1
        if lines:
            self.spark.createDataFrame(lines, C.LINES).coalesce(1).write.mode("append").parquet(f"{self.folder}/lines")
        if told:
            self.spark.createDataFrame(told, "value string, received_at timestamp, ord long").coalesce(1).write.mode("append").parquet(f"{self.folder}/hooks")
        live = self.spark.readStream.schema(C.LINES).parquet(f"{self.folder}/lines")
        hook = self.spark.readStream.schema("value string, received_at timestamp, ord long").parquet(f"{self.folder}/hooks")
        for q in tracking.track(live, self.out, hook, clock=tracking.event_clock, **self.limits):
            q.awaitTermination()
        return tracking.tracked(self.spark, self.out, hooks=True)

    def tables(self):
        return tracking.Tables(self.spark, self.out, **self.limits)


def table_rows(df, *columns):
    return sorted(map(str, df.select(*(columns or sorted(df.columns))).collect()))


def test_partial_facts_merge_to_the_facts(spark, lines):
    rng = random.Random(2)
    records = parse_records(lines({f"f{k}": [said(rng, f"s{k}", 60 * i) for i in range(30)] for k in range(3)}, per_chunk=7))
    part = F.pmod(F.hash("file", "seq", "line"), F.lit(4))
    partial = [FA.partial_facts(records.where(part == i)) for i in range(4)]
    merged = partial[0]
    for p in partial[1:]:
        merged = FA.merge_facts(merged.unionByName(p))
    assert table_rows(FA.finish_facts(merged)) == table_rows(FA.session_facts(records))


def test_silent_files_leave_the_state(spark, tmp_path):
    """Five steps an hour apart, retention of two hours: state holds what was active since, equal to the batch operators over it."""
    stream, rng, kept = Stream(spark, str(tmp_path), keep=timedelta(hours=2)), random.Random(4), []
    state = None
    for hour in range(5):
        step = [(f"f{hour}", C.SOURCE_A, said(rng, f"s{hour}", 3600 * hour + i)) for i in range(8)]
        step += [("all", C.SOURCE_A, said(rng, "all", 3600 * hour + i)) for i in range(6)]
        step += [(f"f{hour}", C.SOURCE_A, {"type": "user", "sessionId": f"s{hour}", "timestamp": stamp(3600 * hour + 20), "message": {"content": "x"}})]
        kept += [(hour, i, *r) for i, r in enumerate(step)]
        state = stream.step(step)
        assert {r.file for r in state.facts.collect()} == {"all", *[f"f{h}" for h in range(hour - 1, hour + 1) if h >= 0]}
    rows = [(f, s, h, i, v if isinstance(v, str) else json.dumps(v)) for h, i, f, s, v in kept if f in ("all", "f3", "f4")]
    records = parse_records(spark.createDataFrame(rows, C.LINES))
    assert table_rows(state.facts) == table_rows(FA.session_facts(records))
    assert table_rows(state.calls) == table_rows(tracking.live_calls(records))
    assert table_rows(state.messages) == table_rows(U.message_usage(records))
    tables = stream.tables()
    for table in tables.of_files:  # and nothing of older files lies in any part
        assert {r.file for r in table.raw().select("file").distinct().collect()} <= {"all", "f3", "f4"}
        assert all(x.rows + x.added <= 40 and len(x.parts) <= 8 for x in table.manifest().values())


def test_prompts_in_and_out_of_time(spark, tmp_path):
    """A prompt waits 300 seconds for its transcript, is delivered once, and goes with its answer."""
    stream = Stream(spark, str(tmp_path), keep=timedelta(hours=24))

    def asks(session, at):
        return {"session_id": session, "message": "needs your Permission"}, at

    def opens(session, at):
        return session, C.SOURCE_A, {"type": "user", "sessionId": session, "timestamp": stamp(at), "message": {"content": "x"}}

    def waiting(state):
        return {r.session_id for r in FA.unanswered(state.delivered, state.facts).collect()}

    def buffered():
        return {r.session_id for r in stream.tables().buffered.read().collect()}

    state = stream.step([opens("old", 0)], [asks("in", 10), asks("out", 8), asks("gone", 9), asks("old", 11)])
    assert waiting(state) == {"old"} and buffered() == {"in", "out", "gone"}
    state = stream.step([], [({"session_id": "gone", "hook_event_name": "PreToolUse"}, 20)])
    assert buffered() == {"in", "out"}
    state = stream.step([opens("in", 309), opens("out", 309)])  # 299 and 301 seconds after their prompts
    assert {r.session_id for r in state.delivered.collect()} == {"old", "in"} and buffered() == set()
    assert waiting(state) == set() | {"old"}  # "in" said something since
    state = stream.step([], [asks("in", 310), asks("later", 311)])
    assert waiting(state) == {"old", "in"}
    state = stream.step([opens("gone", 320)], [({"session_id": "old", "hook_event_name": "PreToolUse"}, 321)])
    assert waiting(state) == {"in"} and {r.session_id for r in state.delivered.collect()} == {"in"}  # the answer drops a delivered one too
    stream.step([opens("x", 700)])
    assert buffered() == set()


def test_increments_over_steps(spark, tmp_path):
    """A step starts from the total before it; resets and records without a time as in one pass."""
    stream, rng, rows = Stream(spark, str(tmp_path), keep=timedelta(days=9)), random.Random(6), []
    given = out = 0
    for step in range(3):
        now = []
        for i in range(6):
            given, out = (rng.randrange(5), rng.randrange(5)) if rng.random() < 0.2 else (given + rng.randrange(9), out + rng.randrange(9))
            now.append(("f", C.SOURCE_B, total(None if rng.random() < 0.3 else 100 * step + i, given, out, given // 2)))
            if step % 2:
                now.append(("g", C.SOURCE_B, total(100 * step + i, 10 * step + i, i)))
        rows += [(f, s, step, i, json.dumps(v)) for i, (f, s, v) in enumerate(now)]
        stream.step(now)
    got = tracking.usage_increments(spark, stream.out)
    assert table_rows(got) == table_rows(U.usage_deltas(parse_records(spark.createDataFrame(rows, C.LINES))))
