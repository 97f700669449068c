"""Keyed tables against a plain dictionary, what a step writes, and the sweep of a silent stream."""

import os
import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionmill.operators import registry
from sessionmill.streaming import keyed
from sessionmill.streaming import registry_stream as RS
from sessionmill.streaming.sinks import read_log
from tests.test_registry import frame, snap

START = datetime(2026, 7, 10, 9, tzinfo=timezone.utc)
SCHEMA = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.LongType())])


def size_of(folder):
    return sum(os.path.getsize(f"{d}/{f}") for d, _, fs in os.walk(folder) for f in fs if f.startswith("part"))


def test_table_holds_the_newest_row_of_each_key(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "MOST_PARTS", 3)
    monkeypatch.setattr(keyed, "FEW_ROWS", 3)
    table = keyed.KeyedTable(spark, str(tmp_path), SCHEMA, ["k"], due=F.when(~F.col("gone"), F.col("v")), buckets=4)
    rng, want = random.Random(1), {}
    assert table.read().collect() == [] and table.manifest() == {}
    for step in range(8):
        rows = [(f"k{i}", rng.randrange(1000), rng.random() < 0.3) for i in rng.sample(range(12), rng.choice([0, 1, 5]))]
        df = spark.createDataFrame(rows, "k string, v long, gone boolean")
        for _ in range(2 if step == 5 else 1):  # a step that runs again
            table.write(df, step)
        for k, v, gone in rows:
            want.pop(k, None) if gone else want.update({k: v})
        assert {r.k: r.v for r in table.read().collect()} == want
        before = {r.k: r.v for r in table.read(step).collect()}  # a replay of the step reads the state before it
        assert set(before.items()) - set(want.items()) <= {(k, v) for k, v in before.items() if k in {r[0] for r in rows}}
        state = table.manifest()
        for b, x in state.items():
            assert len(x.parts) <= 3 + 1
            own = [r.v for r in table.read(buckets=[b]).collect()]
            assert not own or x.due <= min(own)
    found = {(int(d.split("=")[-2].split("/")[0]), int(d.split("=")[-1])) for d, _, fs in os.walk(f"{tmp_path}/rows") if any(f.startswith("part") for f in fs)}
    kept = {(i, b) for v in (8, 7) for b, x in table.manifest(v).items() for i in x.parts}
    assert found == kept


def test_a_step_writes_what_changed(spark, tmp_path):
    """A hundred times the stored rows, the same batch: the same bytes."""
    written = []
    for rows in (500, 50_000):
        table = keyed.KeyedTable(spark, f"{tmp_path}/{rows}", SCHEMA, ["k"], buckets=8)
        table.write(spark.range(rows).select(F.concat(F.lit("k"), "id").alias("k"), F.col("id").alias("v"), F.lit(False).alias("gone")), 0, rewrite=range(8))
        for step in (1, 2):
            table.write(spark.createDataFrame([("k1", 7, False), ("k2", 8, True)], "k string, v long, gone boolean"), step)
        written.append(size_of(f"{tmp_path}/{rows}/rows/batch_id=2"))
        assert size_of(f"{tmp_path}/{rows}/rows/batch_id=0") > 5 * written[-1]
        assert table.read().count() == rows - 1
    assert written[0] == written[1]


def observed(spark, rows, minute):
    return frame(spark, rows).withColumn("received_at", F.lit(START + timedelta(minutes=minute)))


def test_silent_stream_turns_stale_and_leaves(spark, tmp_path):
    """No new rows, only ticks: a session turns stale, then is removed; a finished one is only removed."""
    out, rows, ticks = str(tmp_path / "out"), str(tmp_path / "rows"), str(tmp_path / "ticks")
    first = observed(spark, [snap(0, "a", at="2026-07-10T09:00:00Z"), snap(1, "b", status="done", at="2026-07-10T09:00:00Z"),
                             snap(2, "c", at="2026-07-10T11:00:00Z")], 0).drop("arrival").withColumn("sent", F.lit(0))
    first.coalesce(1).write.parquet(rows)

    def run(*minutes):
        for m in minutes:
            spark.range(1).select(F.lit(START + timedelta(minutes=m)).alias("now")).coalesce(1).write.mode("append").parquet(ticks)
        tick = spark.readStream.schema("now timestamp").option("maxFilesPerTrigger", 1).parquet(ticks)
        stream = spark.readStream.schema(first.schema).parquet(rows)
        RS.run_registry(stream, out, ["sent"], clock=lambda b: b.agg(F.max("received_at").alias("now")), ticks=tick).awaitTermination()

    run(1)
    assert {r.status for r in RS.sessions(spark, out).collect()} == {"thinking", "done"}
    run(29, 30, 31, 24 * 60 + 1)  # each its own step
    events = read_log(spark, f"{out}/feed", RS.FEED).where(f"phase = {RS.SWEPT}").orderBy(*registry.STREAM_ORDER)
    assert [(r.batch_id, r.event, r.agent_id, r.status) for r in events.collect()] == [
        (2, "upsert", "a", "stale"), (4, "removed", "a", "stale"), (4, "removed", "b", "done"), (4, "upsert", "c", "stale")]
    assert [(r.agent_id, r.status) for r in RS.sessions(spark, out).collect()] == [("c", "stale")]
    history = RS.history(spark, out).where("to_status = 'stale'").collect()
    assert sorted((r.key, r.at) for r in history) == [("wsl/claude-code/a", "2026-07-10T09:30:00.000Z"), ("wsl/claude-code/c", "2026-07-11T09:01:00.000Z")]
    # a tick before anything is due opens no bucket
    table = RS.session_table(spark, out)
    assert table.due_by(int((START + timedelta(hours=25)).timestamp() * 1e6)) == set()
    assert len(table.due_by(int((START + timedelta(hours=27)).timestamp() * 1e6))) == 1
