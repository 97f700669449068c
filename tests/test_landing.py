"""Landed transcripts at growing event numbers."""

from datetime import datetime, timedelta
from pathlib import Path

import pytest

from sessionmill.plans import catalog, standin
from sessionmill.sources import transcripts as TR


def events(spark, folder, rows):
    """``rows``: (event_id, user_id, event_type); a minute apart."""
    start = datetime(2024, 1, 1)
    full = [(i, start + timedelta(minutes=n), u, kind, 1.0, "{}") for n, (i, u, kind) in enumerate(rows)]
    spark.createDataFrame(full, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string") \
        .coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


KINDS = ["signup", "click", "view", "purchase", "error"]


@pytest.mark.parametrize("name", ["landed_records", "closed_records"])
def test_files_follow_sessions_not_event_numbers(spark, tmp_path, name):
    """Forty events of four sessions, 100,000 numbers apart: they were forty files, moved one by one by the driver."""
    sf = events(spark, tmp_path, [(i * 100_000 + 1, i % 4, KINDS[i % 5]) for i in range(40)])
    root = catalog._landed_files(spark, sf)
    assert len(list(Path(root.removeprefix("file:")).rglob("part-*"))) <= 4 + 4  # sessions and tasks
    assert {r.session: r.lines for r in catalog.QUERIES[name](spark, sf).collect()} == {f"s{u}": 10 for u in range(4)}


def test_chunks_of_a_session_in_the_order_of_their_names(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "LANDED_LINES", 3)
    sf = events(spark, tmp_path, [(i + 1, 1, "signup") for i in range(40)])
    lines = TR.read_chunks(spark, [(catalog._landed_files(spark, sf), "a")], "part-*")
    assert lines.select("seq").distinct().count() >= 13
    found = [int(r.value.split("go on ")[1].split('"')[0]) for r in lines.orderBy("seq", "line").collect()]
    assert found == list(range(1, 41))


def test_more_rows_are_more_tasks(spark, monkeypatch):
    """The number of tasks was that of the cores, so the longest one grew with the rows."""
    monkeypatch.setattr(standin, "TASK_ROWS", 100)
    assert standin.spread(spark.range(0, 5_000, 1, 2)).rdd.getNumPartitions() == 50
    assert standin.spread(spark.range(0, 50, 1, 2)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_hook_lines_over_all_tasks(spark, tmp_path, monkeypatch):
    """They were parsed in the few splits of the events file, one here."""
    sf = events(spark, tmp_path, [(i + 1, i % 4, KINDS[i % 5]) for i in range(800)])
    monkeypatch.setattr(standin, "TASK_ROWS", 100)
    hooks = standin.hook_lines(spark, sf)
    assert hooks.rdd.getNumPartitions() == 8
    plan = TR.hook_events(hooks)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parsejson") + plan.lower().count("parse_json") == 1  # the filter parsed each line again
    assert TR.hook_events(hooks).groupBy("kind").count().orderBy("kind").collect() == [("prompt", 160), ("resolution", 160)]


@pytest.mark.parametrize("files,triggers", [(8, 2), (80, 8)])
def test_triggers_of_the_landed_lines(spark, tmp_path, files, triggers):
    """A trigger took four files however many there were: 20 triggers of 80 files."""
    row = ("s1", "claude-code", 0, 0, "{}")
    spark.createDataFrame([row] * files, "file string, source string, seq long, line long, value string").repartition(files) \
        .write.option("maxRecordsPerFile", 1).parquet(f"{tmp_path}/in")
    seen = []
    stream = catalog._landed_lines(spark, f"{tmp_path}/in")
    stream.writeStream.foreachBatch(lambda batch, i: seen.append(batch.count())).trigger(availableNow=True) \
        .option("checkpointLocation", f"{tmp_path}/check").start().awaitTermination()
    assert len(seen) == triggers and sum(seen) == files
