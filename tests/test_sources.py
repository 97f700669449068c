import json
import os

from pyspark.sql import functions as F

from sessionmill import contracts as C
from sessionmill.operators import facts as FA
from sessionmill.operators import usage as U
from sessionmill.operators.records import parse_records, write_records
from sessionmill.sources import transcripts as TR
from sessionmill.streaming import tracking
from sessionmill.streaming.sinks import append_log, read_log


def land(root, session, seq, text):
    os.makedirs(f"{root}/{session}", exist_ok=True)
    with open(f"{root}/{session}/{seq}.jsonl", "wb") as f:
        f.write(text.encode() if isinstance(text, str) else text)


def test_chunks(spark, tmp_path):
    a, deep = f"{tmp_path}/a", f"{tmp_path}/a/deep dir"
    land(a, "s1", 0, "one\r\n\n  \ntwo\npart")
    land(a, "s1", 10, "late\n")
    land(a, "s1", 2, b"bad \xff byte\n")
    land(a, "s1/subagents", 0, "skip\n")
    land(deep, "s2", 0, "b\n")
    land(f"{tmp_path}/ab", "s3", 0, "other root\n")
    with open(f"{a}/s1/readme.txt", "w") as f:
        f.write("no\n")
    roots = [(a, "claude-code"), (deep, "codex"), (f"{tmp_path}/missing", "codex")]
    rows = TR.read_chunks(spark, roots).orderBy("file", "seq", "line").collect()
    assert [(r.source, r.seq, r.line, r.value) for r in rows] == [
        ("codex", 0, 0, "b"), ("claude-code", 0, 0, "one"), ("claude-code", 0, 2, "  "), ("claude-code", 0, 3, "two"), ("claude-code", 2, 0, "partbad \ufffd byte"), ("claude-code", 10, 0, "late")]


def test_lines_cut_anywhere_are_put_together(spark, tmp_path):
    """Chunks of random length, some without any newline; the end of the newest chunk is withheld."""
    import random

    rnd, root, want = random.Random(5), f"{tmp_path}/r", {}
    for session in ("s1", "s2", "s3"):
        text = "".join("x" * rnd.randrange(12) + str(i) + "\n" for i in range(60)) + "unfinished"
        want[session] = text.split("\n")[:-1]
        at = seq = 0
        while at < len(text):
            size = rnd.choice([1, 2, 7, 40])
            land(root, session, seq, text[at:at + size])
            at, seq = at + size, seq + rnd.randrange(1, 3)
    rows = TR.read_chunks(spark, [(root, "codex")]).orderBy("file", "seq", "line").collect()
    for session, lines_ in want.items():
        assert [r.value for r in rows if r.file.endswith(session)] == lines_


def test_a_file_named_otherwise_is_a_session_of_its_own(spark, tmp_path):
    root = f"{tmp_path}/r"
    land(root, "slug", "4f-ab", "one\ntwo\n")
    land(root, "slug", "4f-ac", "three\n")
    rows = TR.read_chunks(spark, [(root, "codex")]).orderBy("file", "line").collect()
    assert [(os.path.basename(r.file), r.seq, r.value) for r in rows] == [("4f-ab.jsonl", 0, "one"), ("4f-ab.jsonl", 0, "two"), ("4f-ac.jsonl", 0, "three")]


def test_any_number_of_roots(spark):
    roots = [(f"/r/{i}/x", f"s{i}") for i in range(3000)] + [("/r", "rest"), ("/r/7", "seven/")]
    files = spark.createDataFrame([("/r/5/x/a.jsonl",), ("/r/5/xx/a.jsonl",), ("/r/7/y/b.jsonl",), ("/q/a.jsonl",), ("/r",)], "path string")
    assert {r.path: r.source for r in TR.tag_source(files, roots).collect()} == {
        "/r/5/x/a.jsonl": "s5", "/r/5/xx/a.jsonl": "rest", "/r/7/y/b.jsonl": "seven/"}


def test_nested_roots_are_read_once(spark, tmp_path):
    a, deep = f"{tmp_path}/a", f"{tmp_path}/a/deep"
    land(deep, "s2", 0, "b\n")
    land(a, "s1", 0, "x\n")
    roots = [(a, "claude-code"), (deep, "codex")]
    assert sorted((r.source, r.value) for r in TR.read_chunks(spark, roots).collect()) == [("claude-code", "x"), ("codex", "b")]
    assert sorted((r.source, r.value) for r in TR.read_closed_files(spark, roots).collect()) == [("claude-code", "x"), ("codex", "b")]


def test_closed_files_keep_order_over_splits(spark, tmp_path):
    root = f"{tmp_path}/big"
    land(root, "x", 0, "\n".join(str(i) for i in range(30_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = TR.read_closed_files(spark, [(root, "codex")])
        assert df.select("seq").distinct().count() > 3
        assert [int(r.value) for r in df.orderBy("file", "seq", "line").collect()] == list(range(30_000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_missing_roots(spark):
    assert TR.read_chunks(spark, [("/nope/x", "codex")]).count() == 0


def test_hooks(spark):
    rows = [('{"session_id":"a","message":"one Permission slip, please","hook_event_name":"PreToolUse"}', "2026-01-01 00:00:00", 0),
            ('{"session_id":"b","hook_event_name":"PreToolUse"}', "2026-01-01 00:00:01", 1), ('{"message":"permission"}', "2026-01-01 00:00:01", 2),
            ("junk", "2026-01-01 00:00:01", 3), ('{"session_id":"c","message":"waiting"}', "2026-01-01 00:00:01", 4)]
    df = spark.createDataFrame(rows, "value string, received_at string, ord long").withColumn("received_at", F.to_timestamp("received_at"))
    assert [(r.session_id, r.kind) for r in TR.hook_events(df).orderBy("ord").collect()] == [("a", "prompt"), ("b", "resolution")]
    assert TR.hook_events(df, F.lit("2026-01-01 00:00:01").cast("timestamp")).count() == 1


def test_prompt_rules(spark, lines):
    def user(sec, sid):
        return {"type": "user", "sessionId": sid, "timestamp": f"2026-01-01T00:{sec // 60:02d}:{sec % 60:02d}Z", "message": {"content": "x"}}

    f = FA.session_facts(parse_records(lines({
        "waits": [user(5, "waits")], "moved": [user(20, "moved")], "resolved": [user(5, "resolved")], "again": [user(5, "again")], "late": [user(400, "late")],
    })))
    hooks = [("waits", "prompt", 10), ("moved", "prompt", 10), ("resolved", "prompt", 10), ("resolved", "resolution", 11),
             ("again", "resolution", 10), ("again", "prompt", 10), ("late", "prompt", 50), ("nobody", "prompt", 10)]
    df = spark.createDataFrame([(s, k, "m", t, i) for i, (s, k, t) in enumerate(hooks)], "session_id string, kind string, message string, t long, ord long")
    df = df.withColumn("received_at", F.timestamp_seconds(F.lit(1767225600) + F.col("t"))).drop("t")
    got = {r.session_id for r in FA.waiting_prompts(FA.newest_hooks(df), f).collect()}
    assert got == {"waits", "again"}


def test_stream_equals_batch(spark, tmp_path):
    root, out = f"{tmp_path}/live", f"{tmp_path}/out"

    def record(i):
        if i % 4 == 3:
            return {"type": "user", "sessionId": f"s{i % 3}", "timestamp": f"2026-01-01T00:00:{i:02d}Z", "message": {"content": [{"type": "tool_result", "tool_use_id": f"c{i % 5}"}]}}
        return {"type": "assistant", "sessionId": f"s{i % 3}", "timestamp": f"2026-01-01T00:00:{i:02d}Z", "message": {
            "id": f"m{i // 2}", "usage": {"input_tokens": i}, "content": [{"type": "tool_use", "id": f"c{i % 5}", "name": f"T{i}"}]}}

    def chunk(session, seq, low, high):
        land(root, session, seq, "".join(json.dumps(record(i)) + "\n" for i in range(low, high)))

    roots = [(root, "claude-code")]
    chunk("x", 0, 0, 10)
    chunk("y", 0, 5, 9)

    def drain():
        for q in tracking.track(TR.stream_chunks(spark, roots), out, clock=tracking.event_clock, buckets=2):
            q.awaitTermination()
    drain()
    chunk("x", 1, 10, 23)
    chunk("z", 0, 30, 33)
    drain()
    drain()
    now = F.lit("2026-01-01T00:01:00Z").cast("timestamp")
    live = tracking.tracked(spark, out).snapshots(F.lit("wsl"), now)
    r = parse_records(TR.read_chunks(spark, roots))
    f = FA.with_pending(FA.session_facts(r), FA.call_states(FA.with_call_starts(r)))
    batch = FA.snapshots(f, FA.session_usage(f, U.message_usage(r)), None, F.lit("wsl"), now)
    assert sorted(live.drop("file").collect()) == sorted(batch.drop("file").collect())
    assert batch.count() == 3


def test_stream_carries_lines_cut_between_chunks(spark, tmp_path):
    """The root appears after the stream; chunks are cut anywhere, one has no newline; each line once over restarts."""
    root, out = f"{tmp_path}/live", f"{tmp_path}/out"
    roots = [(root, "claude-code"), (f"{tmp_path}/never", "codex")]

    def drain():
        stream = TR.stream_chunks(spark, roots)
        stream.writeStream.foreachBatch(append_log(f"{out}/log")).option("checkpointLocation", f"{out}/cp").trigger(availableNow=True).start().awaitTermination()

    drain()
    parts = ['{"a": 1}\r\n\n{"b', '": ', '2}\n{"c": "é', '"}\nlast', ' one\nopen']
    for seq, text in enumerate(parts):
        land(root, "x", seq, text)
        if seq in (0, 1, 4):
            drain()
    land(root, "y", 0, "only\n")
    drain()
    log = read_log(spark, f"{out}/log", C.LINES).drop("batch_id")
    assert sorted(map(str, log.collect())) == sorted(map(str, TR.read_chunks(spark, roots).collect()))
    assert {r.value for r in log.collect()} == {'{"a": 1}', '{"b": 2}', '{"c": "é"}', "last one", "only"}


def test_persisted_records_read_back(spark, lines, tmp_path):
    r = parse_records(lines({"f": [{"type": "user", "message": {"content": "x"}}]}))
    write_records(r, f"{tmp_path}/records")
    back = spark.read.parquet(f"{tmp_path}/records")
    assert back.count() == r.count() and set(back.columns) == set(r.columns)


def test_shared_folder_without_setting(spark, monkeypatch):
    from sessionmill.plans import tables

    monkeypatch.setattr(tables, "CHECKPOINT_CONF", "spark.not.set")
    one = tables.materialize(spark.range(3).toDF("x"), "t")
    assert one.count() == 3
    assert tables.shared_folder(spark) == tables.shared_folder(spark)


def test_bodies_are_read_whole(spark, tmp_path):
    from sessionmill.sources import snapshots as SN

    for name, text in (("a/1.json", '[\n {"x": 1},\n {"x": 2}\n]'), ("b.json", "{}"), ("c.json", "")):
        os.makedirs(os.path.dirname(f"{tmp_path}/{name}"), exist_ok=True)
        with open(f"{tmp_path}/{name}", "w") as f:
            f.write(text)
    rows = {os.path.basename(r.body_id): r for r in SN.read_bodies(spark, str(tmp_path)).collect()}
    assert {n: r.body for n, r in rows.items() if r.body} == {"1.json": '[\n {"x": 1},\n {"x": 2}\n]', "b.json": "{}"}
    assert all(r.landed_at is not None for r in rows.values())
