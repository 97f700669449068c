import random

import pytest
from pyspark.sql import functions as F

from sessionmill.operators import facts as FA
from sessionmill.operators import segments
from sessionmill.operators import timeline as TL
from sessionmill.operators.records import parse_records
from sessionmill.operators.segments import Running, newest_covering, running


def script(seed, n):
    """Random dialect-A transcript: records plus what a plain fold shows after each."""
    rnd = random.Random(seed)
    out, shown = [], []
    pending, todo, clock = {}, None, None
    interrupted = finished = False
    for i in range(n):
        ts = rnd.choice([None, 1_700_000_000 + i * 3, 1_700_000_000 + i * 3 - rnd.randrange(20)])
        stamp = {} if ts is None else {"timestamp": f"2023-11-14T{22 + (ts - 1699999200) // 3600:02d}:{(ts % 3600) // 60:02d}:{ts % 60:02d}Z"}
        kind = rnd.choice(["call", "call", "result", "text", "end", "marker", "reject", "todo"])
        if ts is not None:
            clock = ts if clock is None else max(clock, ts)
        if kind in ("call", "end", "todo"):
            interrupted = False
            content, stop = [], {}
            if kind == "end":
                stop, finished = {"stop_reason": "end_turn"}, True
            for _ in range(0 if kind == "end" else rnd.randrange(1, 4)):
                call = f"c{rnd.randrange(12)}"
                name = "TodoWrite" if kind == "todo" else f"T{i}"
                content.append({"type": "tool_use", "id": call, "name": name, "input": {}})
                if kind == "todo":
                    todo = rnd.choice([f"do {i}", None])
                    content[-1]["input"]["todos"] = [{"content": todo or "x", "status": "in_progress" if todo else "completed"}]
                since = ts if ts is not None else (clock if clock is not None else 0)
                pending[call] = (since, i, len(content), name)
            out.append({"type": "assistant", **stamp, "message": {"content": content, **stop}})
        else:
            if kind == "text":
                content, finished, interrupted = "hello", False, False
            elif kind == "marker":
                content, finished, interrupted = "[Request interrupted by user]", False, True
                pending.clear()
            else:
                call = f"c{rnd.randrange(12)}"
                pending.pop(call, None)
                content = [{"type": "tool_result", "tool_use_id": call, "content": "rejected" if kind == "reject" else "ok"}]
                interrupted = interrupted or kind == "reject"
            out.append({"type": "user", **stamp, "message": {"content": content}})
        if clock is None:
            state = None
        elif interrupted:
            state = "interrupted"
        elif pending:
            state = "tool_running"
        else:
            state = "done" if finished else "thinking"
        task = max(pending.values())[3] if pending else todo
        shown.append((state, len(pending), task))
    return out, shown


@pytest.mark.parametrize("segment_lines", [3, 17, 1 << 16])
def test_timeline_equals_a_plain_fold(lines, monkeypatch, segment_lines):
    monkeypatch.setattr(FA, "SEGMENT_LINES", segment_lines)
    files, want, counts = {}, {}, {}
    for seed in range(6):
        records, shown = script(seed, 20 if seed else 300)
        files[f"f{seed}"] = records
        last, expected = None, []
        for i, (state, _, task) in enumerate(shown):
            if state is not None and state != last:
                expected.append((i, state, task))
                last = state
        want[f"f{seed}"] = expected
        counts[f"f{seed}"] = [p for _, p, _ in shown]
    r = parse_records(lines(files, per_chunk=10_000))
    got = {f: [] for f in files}
    for x in TL.timeline(r).orderBy("file", "line").collect():
        got[x.file].append((x.line, x.state, x.task))
    assert got == want
    for x in TL.pending_counts(r).collect():
        assert x.pending == counts[x.file][x.line]


@pytest.mark.parametrize("hot_rows,rows_per_seed", [(0, 1), (200, 30), (1 << 16, 100)])
def test_running_values_equal_plain_ones(spark, monkeypatch, hot_rows, rows_per_seed):
    monkeypatch.setattr(segments, "HOT_ROWS", hot_rows)
    monkeypatch.setattr(segments, "ROWS_PER_SEED", rows_per_seed)
    rnd = random.Random(5)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), i, rnd.choice([None, rnd.randrange(50)])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, i long, v long").withColumn("seg", F.floor(F.col("i") / 7))
    got = {r.i: r for r in running(
        df, ["k"], ["seg"], ["i"], s=Running("sum", F.col("v")), m=Running("max", F.col("v")),
        l=Running("last", F.col("v")), p=Running("prev", F.col("v"))).collect()}
    state = {}
    for k, i, v in rows:
        seen = state.setdefault(k, [])
        known = [x for x in [*seen, v] if x is not None]
        assert got[i].s == (sum(known) if known else None)
        assert got[i].m == (max(known) if known else None)
        assert got[i].l == (known[-1] if known else None)
        assert got[i].p == (seen[-1] if seen else None)
        seen.append(v)


def test_newest_covering_equals_brute_force(spark):
    rnd = random.Random(9)
    spans = [(rnd.choice("xy"), a, a + rnd.randrange(-1, 60), rnd.randrange(1000)) for a in (rnd.randrange(1, 90) for _ in range(80))]
    intervals = spark.createDataFrame(spans, "k string, lo long, hi long, rank long").withColumn("val", F.concat(F.lit("v"), "rank"))
    points = spark.createDataFrame([(k, i) for k in "xyz" for i in range(1, 150)], "k string, at long")
    got = {(r.k, r.at): r.val for r in newest_covering(intervals, points, ["k"], "lo", "hi", "at", "rank", "val").collect()}
    for k in "xyz":
        for i in range(1, 150):
            ranks = [r for kk, lo, hi, r in spans if kk == k and lo <= i <= hi]
            assert got.get((k, i)) == (f"v{max(ranks)}" if ranks else None)


def test_only_hot_keys_are_cut_and_seeds_stay_few(spark, monkeypatch):
    monkeypatch.setattr(segments, "HOT_ROWS", 1000)
    # one key with most rows, one just hot but thin among them, many rare ones
    df = spark.range(60_000).select(
        F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 40 == 1, "thin").otherwise(F.concat(F.lit("r"), F.col("id") % 997)).alias("k"),
        F.col("id").alias("i"), F.floor(F.col("id") / 20).alias("seg"))
    rows, cuts = segments._cut_hot_keys(df, ["k"], ["seg"])
    assert rows.count() == 60_000
    got = {r.k: (r.n, r.cuts) for r in rows.where("__hot").groupBy("k").agg(
        F.count("*").alias("n"), F.countDistinct(*cuts).alias("cuts")).collect()}
    assert set(got) == {"hot", "thin"}
    assert all(1 < cut <= n / 100 + 1 for n, cut in got.values())
    assert rows.where(~F.col("__hot") & F.col(cuts[0]).isNotNull()).isEmpty()
