from datetime import datetime, timedelta, timezone
import random

import pytest
from pyspark.sql import functions as F

from sessionmill import contracts as C
from sessionmill.functions import display as D
from sessionmill.functions import paths as P
from sessionmill.operators import blocks, periods, reports, usage

NOW = datetime(2026, 7, 10, 12, tzinfo=timezone.utc)


def events(spark, rows):
    data = [("f", "claude-code", "m", t, (n, n // 2, 0, 0)) for t, n in rows]
    from pyspark.sql.types import StringType, StructField, StructType, TimestampType

    schema = StructType([StructField("file", StringType()), StructField("source", StringType()), StructField("machine", StringType()),
                         StructField("ts", TimestampType()), StructField("tokens", C.TOKENS)])
    return spark.createDataFrame(data, schema)


def estimate(spark, rows, now=NOW):
    df = events(spark, rows)
    return blocks.plan_estimate(df, spark.createDataFrame([("m",)], "machine string"), ["machine"], F.lit(now)).first().claude


def plain_estimate(rows, now):
    """The current block and the week by walking the events in time order."""
    past = sorted((t, n) for t, n in rows if t <= now)
    start, block = None, []
    for t, n in past:
        if start is None or t >= start + timedelta(hours=C.BLOCK_HOURS):
            start, block = t.replace(minute=0, second=0, microsecond=0), []
        block.append(n)
    live = start is not None and now < start + timedelta(hours=C.BLOCK_HOURS)
    week = [n for t, n in past if now - t <= C.WEEK]
    return (sum(block) if live else 0, len(block) if live else 0, (start + timedelta(hours=C.BLOCK_HOURS)) if live else None, sum(week), len(week))


def test_estimate_equals_a_walk_over_events(spark):
    rnd = random.Random(11)
    for case in range(6):
        now = datetime(2025, 3, 20 + case, rnd.randrange(24), rnd.randrange(60), tzinfo=timezone.utc)
        back = [rnd.choice([-30, 5, 50, 200, 290, 310, 900, 5000, 10080, 10081, 14000]) + rnd.randrange(40) * (case > 0) for _ in range(rnd.randrange(12))]
        rows = [(now - timedelta(minutes=m), rnd.randrange(2, 900)) for m in back]
        e = estimate(spark, rows, now)
        ends = e.five_hour_resets_at and e.five_hour_resets_at.replace(tzinfo=timezone.utc)
        got = (e.five_hour.tokens.input_tokens, e.five_hour.messages, ends, e.weekly.tokens.input_tokens, e.weekly.messages)
        assert got == plain_estimate(rows, now) and e.confidence == "estimated"


def test_blocks_equal_event_fold(spark):
    rnd, t, rows = random.Random(4), 0, []
    for _ in range(600):
        t += rnd.choice([1, 20, 90, 400])
        rows.append((datetime(2026, 1, 1, tzinfo=timezone.utc) + timedelta(minutes=t), 10))
    want, start = {}, None
    for ts, n in rows:
        if start is None or ts >= start + timedelta(hours=5):
            start = ts.replace(minute=0)
        want[start] = want.get(start, 0) + 1
    got = blocks.blocks(blocks.hourly_usage(events(spark, rows), ["machine"], F.lit(NOW)), ["machine"]).collect()
    assert {r.block_start.replace(tzinfo=timezone.utc): r.messages for r in got} == want


@pytest.mark.parametrize("model,cost", [
    ("claude-fable-5", 10.0), ("claude-mythos", 10.0), ("claude-3-opus-x", 15.0), ("opus-3", 15.0), ("claude-opus-4-8", 5.0),
    ("Claude-SONNET-4", 3.0), ("claude-haiku", 1.0), ("gpt-5", None), (None, None)])
def test_prices(spark, model, cost):
    tokens = F.struct(*[F.lit(n).cast("bigint").alias(f) for f, n in zip(C.TOKEN_FIELDS, (1_000_000, 0, 0, 0))])
    row = spark.range(1).select(
        usage.event_cost(F.lit("claude-code"), F.lit(model).cast("string"), tokens).alias("a"),
        usage.event_cost(F.lit("codex"), F.lit(model).cast("string"), tokens).alias("b")).first()
    assert row.a == cost and row.b is None


def test_cache_multipliers(spark):
    tokens = F.struct(*[F.lit(1_000_000).cast("bigint").alias(f) for f in C.TOKEN_FIELDS])
    got = spark.range(1).select(usage.event_cost(F.lit("claude-code"), F.lit("sonnet"), tokens)).first()[0]
    assert got == pytest.approx(3 + 15 + 0.3 + 3.75)


def test_periods_overlap_and_keep_empty_rows(spark):
    df = events(spark, [(NOW, 10), (NOW - timedelta(days=7), 20), (NOW - timedelta(days=7, seconds=1), 40), (NOW - timedelta(days=99), 80),
                        (NOW + timedelta(seconds=1), 1000)])
    models = spark.createDataFrame([("f", "unknown")], "file string, model string")
    got = {(r.period, r.source): r for r in periods.period_totals(df, models, F.lit(NOW)).collect()}
    assert len(got) == 8
    assert [got[p, "claude-code"].input_tokens for p in periods.PERIODS] == [10, 30, 70, 150]
    assert all(got[p, "claude-code"].sessions == 1 for p in periods.PERIODS)
    assert got["all", "claude-code"].est_cost_usd is None and got["all", "codex"].messages == 0


def test_local_midnight():
    berlin = datetime(2026, 7, 10, 22, 30, tzinfo=timezone.utc)
    assert periods.local_midnight(berlin, "Europe/Berlin") == datetime(2026, 7, 10, 22, tzinfo=timezone.utc)
    # Havana skips midnight on 2026-03-08 and repeats it on 2026-11-01
    skipped = datetime(2026, 3, 8, 15, tzinfo=timezone.utc)
    assert periods.local_midnight(skipped, "America/Havana") == skipped - timedelta(days=1)
    twice = datetime(2026, 11, 1, 15, tzinfo=timezone.utc)
    assert periods.local_midnight(twice, "America/Havana") == datetime(2026, 11, 1, 4, tzinfo=timezone.utc)


def test_zone_midnight_equals_local_midnight(spark):
    instants = [datetime(2026, m, d, h, 30, tzinfo=timezone.utc) for m, d, h in
                [(7, 10, 22), (3, 8, 15), (3, 8, 3), (11, 1, 15), (11, 1, 4), (10, 25, 0), (3, 29, 12), (1, 1, 0)]]
    zones = ["UTC", "Europe/Berlin", "America/Havana", "America/New_York", "Asia/Kolkata", "Africa/Cairo", "Asia/Beirut"]
    df = spark.createDataFrame([(i, z) for i in instants for z in zones], "now timestamp, zone string")
    for r in df.withColumn("m", periods.zone_midnight(F.col("now"), F.col("zone"))).selectExpr("unix_micros(now) AS n", "zone", "unix_micros(m) AS m").collect():
        now = datetime.fromtimestamp(r.n // 10**6, timezone.utc)
        assert r.m == int(periods.local_midnight(now, r.zone).timestamp()) * 10**6, (now, r.zone)


def test_display(spark):
    def one(*cols):
        return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())

    n = [0, 999, 1000, 1234, 1250, 50050, 999999, 1000000, 3400000, 1234567890123]
    assert one(*[D.compact(F.lit(x).cast("bigint")) for x in n]) == (
        "0", "999", "1.0k", "1.2k", "1.3k", "50.0k", "1000.0k", "1.0M", "3.4M", "1234567.9M")
    now = F.lit(NOW)
    assert one(*[D.ago(F.lit(x), now) for x in (
        "2026-07-10T12:00:05Z", "2026-07-10T11:59:51Z", "2026-07-10T11:59:10Z", "2026-07-10T11:10:00Z", "2026-07-09T13:00:00Z", "2026-07-01T00:00:00Z", "bad")]) == (
        "now", "now", "50s ago", "50m ago", "23h ago", "9d ago", "")
    soon = [timedelta(0), timedelta(minutes=5), timedelta(hours=2, minutes=5), timedelta(hours=24, minutes=1), timedelta(hours=49)]
    assert one(*[D.resets_in(F.lit(NOW + x), now) for x in soon]) == ("", "resets in 5m", "resets in 2h 05m", "resets in 24h 01m", "resets in 2d 1h")
    assert one(*[D.money(F.lit(x).cast("double")) for x in (None, 1.005, 0.125, 99.999, 100.5, 12345.4)]) == ("—", "$1.00", "$0.13", "$100.00", "$101", "$12,345")
    assert one(*[D.tone(F.lit(x)) for x in (50, 51, 71, 91)]) == ("ok", "elevated", "high", "critical")
    assert one(D.tone(F.lit(50), (10, 20, 40)), D.status_label(F.lit("odd")), D.status_rank(F.lit("odd"))) == ("critical", "odd", 9)


def test_paths(spark):
    def col(fn, *values):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
        return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]

    assert col(P.normalize_project, "/mnt/q/Work/Shop", "Q:\\Work\\Shop\\", "\\\\wsl$\\Debian\\srv\\App", "\\\\WSL.localhost\\Ubuntu\\mnt\\c\\x",
               "/", "//", "", "/mnt/cc/x", "/mnt/c", "//wsl$/Ubuntu") == [
        "q:/work/shop", "q:/work/shop", "/srv/app", "/mnt/c/x", "/", "/", "", "/mnt/cc/x", "/mnt/c", "//wsl$/ubuntu"]
    assert col(P.project_name, "/a/b/", "C:\\x\\y", "/", "") == ["b", "y", "/", ""]
    assert col(P.alert_project, "/a/b", "/a/b/", "x") == ["b", "/a/b/", "x"]
    assert col(P.encode_path, "/a b/c:d~_.-", "/é#%*+'()") == ["/a%20b/c:d~_.-", "/%C3%A9%23%25%2A%2B%27%28%29"]
    links = spark.range(1).select(
        P.editor_link(F.lit("wsl"), F.lit("/home/a b")).alias("a"), P.editor_link(F.lit("windows"), F.lit("C:\\x y")).alias("b"),
        P.terminal_path(F.lit("vps"), F.lit("/home/x")).alias("c"), P.terminal_path(F.lit("windows"), F.lit("/home/x")).alias("d")).first()
    assert tuple(links) == ("vscode://vscode-remote/wsl+Ubuntu/home/a%20b", "vscode://file/C:/x%20y", "\\\\wsl.localhost\\Ubuntu\\home\\x", "/home/x")


def test_reports(spark):
    bodies = [("a", '{"five_hour":{"utilization":1.5,"resets_at":"2026-07-10T13:00:00Z"},"seven_day":{"utilization":2}}', NOW - timedelta(minutes=20)),
              ("b", '{"five_hour":{"utilization":7},"seven_day":{"utilization":2},"x":[]}', NOW - timedelta(minutes=14)),
              ("b", '{"five_hour":null,"seven_day":{"utilization":2}}', NOW), ("b", "[]", NOW)]
    r = reports.parse_plan_windows(spark.createDataFrame(bodies, "machine string, body string, observed_at timestamp"))
    assert [x.error is None for x in r.orderBy("observed_at", "body").collect()] == [True, True, False, False]
    fresh = reports.fresh_readings(r, F.lit(NOW)).collect()
    assert [(x.machine, x.claude_exact.five_hour.used_percent) for x in fresh] == [("b", 7.0)]
    assert reports.account_exact(r.withColumnRenamed("reading", "claude_exact")).first().claude_exact.five_hour.used_percent == 7.0


def test_blocks_of_ten_years_without_a_gap(spark):
    """The fold by pieces equals a plain fold: dense, sparse and null accounts, hours before the epoch, tiny pieces."""
    rng = random.Random(1)
    hours = {"a": [h for h in range(2000) if rng.random() < 0.7], "b": [h for h in range(-300, 900) if rng.random() < 0.2], None: [5, 6, 300], "c": range(24 * 3650)}
    rows = [(k, h * 3600, 1, 1, 1, 1, 1) for k, hs in hours.items() for h in hs]
    df = spark.createDataFrame(rows, "account string, hour long, " + ", ".join(f"{f} long" for f in C.TOKEN_FIELDS) + ", messages long")

    def fold(name):
        start, found = None, {}
        for h in hours[name]:
            start = h if start is None or h >= start + C.BLOCK_HOURS else start
            found[name, start * 3600] = found.get((name, start * 3600), 0) + 1
        return found

    for piece, names in ((blocks.PIECE_HOURS, ["a", "b", None, "c"]), (7, ["a", "b", None])):
        some = df if "c" in names else df.where("account IS NULL OR account <> 'c'")
        got = blocks.blocks(some, ["account"], piece).select("account", F.unix_seconds("block_start").alias("s"), "messages").collect()
        assert {(r.account, r.s): r.messages for r in got} == {k: n for name in names for k, n in fold(name).items()}
