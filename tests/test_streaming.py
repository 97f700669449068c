from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from sessionmill import contracts as C
from sessionmill.operators import feed, registry
from sessionmill.streaming import registry_stream as RS
from sessionmill.streaming import tracking
from sessionmill.streaming.sinks import read_log, step_time
from tests.test_registry import frame, snap

START = datetime(2026, 7, 10, 9, tzinfo=timezone.utc)


def batch(spark, rows, minute):
    return frame(spark, rows).withColumn("received_at", F.lit(START + timedelta(minutes=minute)))


def state(spark, out):
    def table(name):
        return sorted(map(str, spark.read.option("basePath", f"{out}/{name}").parquet(f"{out}/{name}").collect()))
    return {**{name: table(name) for name in ("feed", "transitions", "alerts")}, "sessions": sorted(map(str, RS.sessions(spark, out).collect()))}


def test_registry_steps_and_replay(spark, tmp_path):
    out = str(tmp_path)
    one = batch(spark, [snap(0, at="2026-07-10T09:00:00Z"), snap(1, status="needs_you", needs=True, at="2026-07-10T09:00:01Z"),
                        snap(2, "gone", at="2026-07-09T01:00:00Z")], 1)
    two = batch(spark, [snap(0, status="needs_you", needs=True, at="2026-07-10T09:00:01Z"),
                        snap(1, at="2026-07-10T09:00:02Z"), snap(2, status="needs_you", needs=True, at="2026-07-10T09:00:03Z")], 2)
    three = batch(spark, [snap(0, "new", needs=True, status="needs_you", at="2026-07-10T10:00:00Z")], 70)
    for i, (df, minute) in enumerate([(one, 1), (two, 2), (three, 70)]):
        RS.apply_batch(spark, df, i, out, F.lit(START + timedelta(minutes=minute)))
    first = state(spark, out)
    changes = read_log(spark, f"{out}/transitions", spark.read.parquet(f"{out}/transitions/batch_id=0").schema)
    got = [(r.key.split("/")[2], r.from_status, r.to_status, r.batch_id) for r in changes.orderBy(*registry.STREAM_ORDER).collect()]
    assert got == [
        ("u1", None, "thinking", 0), ("u1", "thinking", "needs_you", 0), ("gone", None, "thinking", 0),
        ("u1", "needs_you", "thinking", 1), ("u1", "thinking", "needs_you", 1), ("new", None, "needs_you", 2)]
    # the second edge of u1 is within the cooldown of the first
    alerts = read_log(spark, f"{out}/alerts", RS.ALERTS).collect()
    assert sorted((r.logical_key, r.batch_id) for r in alerts) == [("claude-code/new", 2), ("claude-code/u1", 0)]
    assert {(r.agent_id, r.status) for r in RS.sessions(spark, out).collect()} == {("u1", "needs_you"), ("new", "needs_you")}
    removed = spark.read.parquet(f"{out}/feed/batch_id=0").where("event = 'removed'").collect()
    assert [r.key for r in removed] == ["wsl/claude-code/gone"]
    RS.apply_batch(spark, three, 2, out, F.lit(START + timedelta(minutes=70)))
    assert state(spark, out) == first


def test_prompts_reach_the_snapshot(spark, tmp_path, lines):
    root, out = f"{tmp_path}/lines", f"{tmp_path}/out"
    user = {"type": "user", "sessionId": "s", "timestamp": "2026-07-10T09:00:00Z", "message": {"content": "x"}}
    lines({"s": [user], "t": [{**user, "sessionId": "t"}]}).write.parquet(root)
    hooks = [('{"session_id":"s","message":"needs permission"}', START + timedelta(seconds=5), 0),
             ('{"session_id":"t","message":"needs permission"}', START + timedelta(seconds=5), 1),
             ('{"session_id":"t","hook_event_name":"PreToolUse"}', START + timedelta(seconds=6), 2)]
    spark.createDataFrame(hooks, "value string, received_at timestamp, ord long").write.parquet(f"{tmp_path}/hooks")
    live = spark.readStream.schema(C.LINES).parquet(root)
    hook = spark.readStream.schema("value string, received_at timestamp, ord long").parquet(f"{tmp_path}/hooks")
    for q in tracking.track(live, out, hook, clock=tracking.event_clock):
        q.awaitTermination()
    snaps = tracking.tracked(spark, out, hooks=True).snapshots(F.lit("wsl"), F.lit(START + timedelta(seconds=8)))
    assert {(r.agent_id, r.status, r.needs_user_reason) for r in snaps.collect()} == {
        ("s", "needs_you", "needs permission"), ("t", "thinking", None)}


def feed_rows(spark, out, after=-1):
    first = RS.opening(spark, out)
    return RS.read_feed(spark, out, after).select(*first.columns)


def test_streamed_feed_folds_to_the_registry(spark, tmp_path):
    """Changes and a sweep of later batches, read in the stream's order: the view shows what the registry holds."""
    out, limit = str(tmp_path), {"keep": timedelta(minutes=30), "stale": timedelta(minutes=20)}
    one = batch(spark, [snap(0, "a", at="2026-07-10T08:58:00Z"), snap(1, "a", status="needs_you", needs=True, at="2026-07-10T08:59:00Z"),
                        snap(2, "b", status="done", at="2026-07-10T08:35:00Z"), snap(3, "c", at="2026-07-10T08:45:00Z")], 0)
    two = batch(spark, [snap(0, "a", status="done", at="2026-07-10T09:04:00Z")], 6)
    RS.apply_batch(spark, one, 0, out, F.lit(START), **limit)
    late = RS.opening(spark, out)
    late.write.parquet(f"{out}/late")
    RS.apply_batch(spark, two, 1, out, F.lit(START + timedelta(minutes=6)), **limit)
    registry_state = {(r.agent_id, r.status) for r in RS.sessions(spark, out).collect()}
    assert registry_state == {("a", "done"), ("c", "stale")}
    columns = ["batch_id", "phase", "arrival", "event", "key", "logical_key", "agent_id", "status"]
    whole = RS.read_feed(spark, out).select(*columns)
    resumed = spark.read.parquet(f"{out}/late").select(*columns).unionByName(RS.read_feed(spark, out, after=0).select(*columns))
    for rows in (whole, resumed):
        assert {(r.agent_id, r.status) for r in feed.card_view(rows, *registry.STREAM_ORDER).collect()} == registry_state
    assert [r.to_status for r in registry.session_history(RS.history(spark, out), "wsl/claude-code/a", *registry.STREAM_ORDER).collect()] == [
        "thinking", "needs_you", "done"]


def test_feed_without_order_is_an_error(spark):
    rows = spark.createDataFrame([("upsert", "m/s/a", "s/a", None)], "event string, key string, logical_key string, arrival long")
    try:
        feed.card_view(rows).collect()
    except Exception as e:
        assert "feed row without arrival" in str(e)
    else:
        raise AssertionError("a null order passed")


def test_cooldown_holds_across_batches_when_rows_lag(spark, tmp_path):
    out, now = str(tmp_path), F.lit(START + timedelta(hours=3))  # an outage: rows of the morning arrive hours later

    def needing(i, second):
        rows = [snap(0, status="thinking", at="2026-07-10T11:00:00Z"), snap(1, status="needs_you", needs=True, at="2026-07-10T11:00:01Z")]
        RS.apply_batch(spark, frame(spark, rows).withColumn("received_at", F.lit(START + timedelta(seconds=second))), i, out, now)

    for i, second in enumerate((0, 10, 119, 120, 500)):
        needing(i, second)
    fired = read_log(spark, f"{out}/alerts", RS.ALERTS).collect()
    assert sorted((r.batch_id, r.logical_key, r.title, r.body) for r in fired) == [
        (i, "claude-code/u1", "Claude Code needs you — demo", "[wsl] waiting on your input") for i in (0, 3, 4)]


def test_two_machines_at_one_instant_raise_one_alert(spark, tmp_path):
    out = str(tmp_path)
    rows = [snap(0, status="needs_you", needs=True, reason="first"), snap(1, machine="windows", status="needs_you", needs=True, reason="second")]
    RS.apply_batch(spark, batch(spark, rows, 0), 0, out, F.lit(START))
    assert [(r.machine, r.body) for r in read_log(spark, f"{out}/alerts", RS.ALERTS).collect()] == [("windows", "[windows] second")]


def test_steps_leave_no_scratch_and_few_versions(spark, tmp_path):
    import os

    from sessionmill.plans import tables

    out, scratch = str(tmp_path), f"{tables.shared_folder(spark)}/sessionmill"
    before = set(os.listdir(scratch)) if os.path.isdir(scratch) else set()
    for i in range(4):
        RS.apply_batch(spark, batch(spark, [snap(0, at=f"2026-07-10T09:0{i}:00Z")], i), i, out, F.lit(START + timedelta(minutes=i)))
    assert set(os.listdir(scratch)) == before
    for table in ("sessions", "last_fired"):
        assert sorted(n for n in os.listdir(f"{out}/{table}/manifest") if n.startswith("batch")) == ["batch_id=2", "batch_id=3"]


def test_step_time_is_taken_once(spark, tmp_path):
    rows = batch(spark, [snap(0)], 0)
    ticks = iter([START, START + timedelta(hours=1)])

    def clock(df):
        return df.sparkSession.createDataFrame([(next(ticks),)], "now timestamp")

    first, again = (spark.range(1).select(step_time(rows, 0, str(tmp_path), clock)).first()[0] for _ in range(2))
    assert first == again


def test_sweeps_emit_what_changed(spark, tmp_path):
    out = str(tmp_path)
    first = frame(spark, [snap(0, "a"), snap(0, "b"), snap(0, "a", at="2026-07-10T09:00:00Z", status="idle")])  # a has two files
    second = frame(spark, [snap(0, "a"), snap(0, "b", status="done"), snap(0, "c")])
    assert sorted((r.agent_id, r.status) for r in tracking.emit_changed(spark, out, first, 0).collect()) == [("a", "thinking"), ("b", "thinking")]
    for _ in range(2):  # a repeated sweep gives the same
        assert sorted(r.agent_id for r in tracking.emit_changed(spark, out, second, 1).collect()) == ["b", "c"]
    assert tracking.emit_changed(spark, out, second, 2).count() == 0
    assert [r.agent_id for r in tracking.emit_changed(spark, out, frame(spark, [snap(0, "a", branch="x"), snap(1, "c", jump=("ssh", "h"))]), 3).collect()] == []


def test_record_log_holds_each_line_once(spark, tmp_path, lines):
    root, out = f"{tmp_path}/lines", f"{tmp_path}/out"
    for k in range(2):
        lines({"s": [{"type": "user", "message": {"content": f"x{k}{i}"}} for i in range(3)]}).withColumn("seq", F.lit(k).cast("long")).write.mode("append").parquet(root)
        tracking.log_records(spark.readStream.schema(C.LINES).parquet(root), out).awaitTermination()
    rows = tracking.logged_records(spark, out)
    assert rows.where("pos = -1").count() == 6 and rows.where("pos = -1").select("seq", "line").distinct().count() == 6
