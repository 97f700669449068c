"""Registered queries: every operator over whole tables, with its expected result in SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionmill import contracts as C
from sessionmill.functions import display as D
from sessionmill.functions import paths as P
from sessionmill.functions.times import render_millis
from sessionmill.operators import alerts, blocks, entities, facts, feed, periods, records, registry, reports, timeline, usage, views
from sessionmill.plans import oracle as O
from sessionmill.plans import standin as S
from sessionmill.plans.tables import materialize, new_folder
from sessionmill.sources import snapshots as SN
from sessionmill.sources import transcripts as TR
from sessionmill.streaming import outage, registry_stream, tracking
from sessionmill.streaming.sinks import append_log, read_log

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

TOK = list(zip(C.TOKEN_FIELDS, ["tin", "tout", "tread", "twrite"]))
SQL_TOK = "CAST(tin AS BIGINT) AS input_tokens, CAST(tout AS BIGINT) AS output_tokens, CAST(tread AS BIGINT) AS cache_read_tokens, CAST(twrite AS BIGINT) AS cache_creation_tokens"


def query(*sql: str):
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = O.sql(*sql)
        return fn
    return add


def us(col: str | Column) -> Column:
    return F.unix_micros(col)


def event_id() -> Column:
    return (F.col("seq") * S.CHUNK + F.col("line")).alias("event_id")


def tokens(col: str = "tokens") -> list[Column]:
    return [F.col(f"{col}.{f}").alias(f) for f in C.TOKEN_FIELDS]


def user_of(col: str = "file") -> Column:
    return F.substring(col, 2, 20).cast("bigint")


def machine_of(col: str = "file") -> Column:
    return F.when(user_of(col) % 2 == 0, "wsl").otherwise("windows")


# --- records ---------------------------------------------------------------

@query(O.FX, """
SELECT source, kind, count(*) AS n FROM (
  SELECT source, CASE WHEN env AND event_type = 'click' THEN 'call' WHEN env AND event_type = 'view' THEN 'result' ELSE 'record' END AS kind FROM fx
  UNION ALL SELECT source, CASE WHEN says THEN 'call' WHEN event_type = 'view' THEN 'result' ELSE 'text' END FROM fx WHERE asks OR (says AND event_type = 'click')
) GROUP BY 1, 2""")
def record_kinds(spark, sf):
    return S.records(spark, sf).groupBy("source", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(O.FX, O.FACTS, "SELECT file, source, lines, parse_errors, sidechain_records FROM facts")
def data_quality(spark, sf):
    return facts.session_facts(S.records(spark, sf)).select("file", "source", "lines", "parse_errors", "sidechain_records")


@query(O.FX, O.FACTS, """
SELECT file, session_id, cwd, git_branch, model, approval_policy, CASE WHEN todo_writes > 0 THEN 2 ELSE 0 END AS todos FROM facts""")
def session_metadata(spark, sf):
    return facts.session_facts(S.records(spark, sf)).select(
        "file", "session_id", "cwd", "git_branch", "model", "approval_policy",
        F.when(F.col("todos").isNull(), 0).otherwise(F.size("todos")).alias("todos"))


@query(O.FX, """
SELECT file, event_id, call_id, call_name, call_label, epoch_us(since) AS since_us FROM fx WHERE opens""")
def tool_calls(spark, sf):
    rows = facts.with_call_starts(S.records(spark, sf)).where("opens")
    return rows.select("file", event_id(), "call_id", "call_name", "call_label", us("since").alias("since_us"))


@query(O.FX, """
SELECT file, event_id, call_id, coalesce(interrupted, false) AS rejected,
  CASE WHEN b THEN NULL WHEN event_id % 2 = 0 THEN CASE WHEN event_id % 13 = 0 THEN 'The user Rejected it' ELSE 'fine' END
    ELSE 'line one' || chr(10) || CASE WHEN event_id % 13 = 0 THEN 'REJECTED' ELSE 'two' END END AS result_text
FROM fx WHERE opens = false""")
def tool_results(spark, sf):
    rows = S.records(spark, sf).where(~F.col("opens"))
    return rows.select("file", event_id(), "call_id", F.coalesce("interrupted", F.lit(False)).alias("rejected"), "result_text")


@query(O.FX, f"SELECT file, event_id, {SQL_TOK} FROM fx WHERE says")
def token_fields(spark, sf):
    return S.records(spark, sf).where(F.col("tokens").isNotNull()).select("file", event_id(), *tokens())


@query(O.FX, """
SELECT file, event_id, 'old' AS first_content, CASE WHEN event_id % 2 = 0 THEN 'in_progress' ELSE 'pending' END AS second_status,
  CASE WHEN event_id % 3 = 0 THEN 'doing ' || event_id END AS second_form, todo_text AS shown FROM
  (SELECT * REPLACE (CASE WHEN event_id % 2 = 0 THEN todo_text END AS todo_text) FROM fx) WHERE todos_set""")
def todo_lists(spark, sf):
    rows = S.records(spark, sf).where(F.col("todos").isNotNull())
    return rows.select(
        "file", event_id(), F.col("todos")[0]["content"].alias("first_content"), F.col("todos")[1]["status"].alias("second_status"),
        F.col("todos")[1]["active_form"].alias("second_form"), facts.todo_task(F.col("todos")).alias("shown"))


@query(O.FX, """
SELECT file, event_id, event_id % 101 + 0.5::DOUBLE AS primary_used, CAST(1700000000 + event_id AS BIGINT) AS primary_resets,
  CASE WHEN event_id % 4 <> 0 THEN CAST(event_id % 11 AS DOUBLE) END AS secondary_used, 'plus' AS plan_type, epoch_us(t) AS observed_us
FROM fx WHERE limited""")
def rate_limit_windows(spark, sf):
    rows = S.records(spark, sf).where(F.col("rate_limits").isNotNull())
    r = "rate_limits."
    return rows.select(
        "file", event_id(), F.col(r + "primary.used_percent").alias("primary_used"), F.col(r + "primary.resets_at").alias("primary_resets"),
        F.col(r + "secondary.used_percent").alias("secondary_used"), F.col(r + "plan_type").alias("plan_type"),
        us(r + "observed_at").alias("observed_us"))


@query(O.FX, """
SELECT file, CASE WHEN arg_min(env, event_id) THEN 'codex' ELSE 'claude-code' END AS source FROM fx GROUP BY 1""")
def format_sniff(spark, sf):
    return TR.sniff_source(S.transcript_lines(spark, sf).drop("source"))


ROOTS = [("/data", "script"), ("/data/a", "claude-code"), ("/data/a/deep", "codex"), ("/data/cron/", "cron")]
_PATH_SQL = """CASE user_id % 5 WHEN 0 THEN '/data/a/u' || user_id WHEN 1 THEN '/data/a/deep/u' || user_id WHEN 2 THEN '/data/abc/u' || user_id
  WHEN 3 THEN '/other/u' || user_id ELSE '/data/cron/u' || user_id END || CASE WHEN event_id % 4 = 0 THEN '/subagents' ELSE '' END || '/' || event_id || '.jsonl'"""


@query(f"p AS (SELECT event_id, user_id, {_PATH_SQL} AS path FROM events)", """
SELECT path, CASE user_id % 5 WHEN 0 THEN 'claude-code' WHEN 1 THEN 'codex' WHEN 2 THEN 'script' ELSE 'cron' END AS source
FROM p WHERE user_id % 5 <> 3 AND event_id % 4 <> 0""")
def source_tagging(spark, sf):
    files = S.events(spark, sf).select(F.expr(_PATH_SQL).alias("path"))
    return TR.tag_source(files.where(~TR.is_subagent(F.col("path"))), ROOTS)


@query("""pieces AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS value, unnest(range(len(string_split(text, chr(10))))) AS line,
  len(string_split(text, chr(10))) AS n FROM documents)""", """
SELECT doc_id, CAST(line AS BIGINT) AS line, value FROM pieces WHERE line < n - 1 AND value <> ''""")
def complete_lines(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("text").alias("value"))
    return TR.complete_lines(docs).select("doc_id", "line", "value")


@query("""pieces AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS value, unnest(range(len(string_split(text, chr(10))))) AS line,
  len(string_split(text, chr(10))) AS n FROM documents)""", """
SELECT doc_id, value, count(*) AS n FROM pieces WHERE line < n - 1 AND value <> '' GROUP BY 1, 2""")
def carried_lines(spark, sf):
    """Texts landed in chunks of 700 characters, cut anywhere, give the lines of the whole text."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("text <> ''")
    starts = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 700).cast("int"))
    chunks = docs.select("doc_id", "text", F.explode(starts).alias("seq")).select(
        "doc_id", "seq", F.col("text").substr(F.col("seq") * 700 + 1, F.lit(700)).alias("value"))
    return TR.carried_lines(chunks, ["doc_id"], "seq").groupBy("doc_id", "value").agg(F.count("*").alias("n"))


@query("""pieces AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS value, unnest(range(len(string_split(text, chr(10))))) AS line,
  len(string_split(text, chr(10))) AS n FROM documents)""", """
SELECT doc_id, value, count(*) AS n FROM pieces WHERE line < n - 1 AND value <> '' GROUP BY 1, 2""")
def stream_lines(spark, sf):
    """The same chunks landing one after the other: a stream with a trigger for each quarter of a text's chunks."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("text <> ''")
    last = F.floor((F.length("text") - 1) / 700).cast("int")
    chunks = docs.select("doc_id", "text", last.alias("last"), F.explode(F.sequence(F.lit(0), last)).alias("seq"))
    value = F.col("text").substr(F.col("seq") * 700 + 1, F.lit(700)).alias("value")
    quarter = F.floor(F.col("seq") * 4 / (F.col("last") + 1)).cast("int").alias("quarter")
    landed, out = new_folder(spark, "chunks"), new_folder(spark, "lines")
    chunks.select("doc_id", "seq", value, quarter).write.partitionBy("quarter").parquet(f"{landed}/all")
    for q in range(4):
        spark.read.schema("doc_id long, seq int, value string").parquet(f"{landed}/all/quarter={q}").write.mode("append").parquet(f"{landed}/live")
        live = spark.readStream.schema("doc_id long, seq int, value string").parquet(f"{landed}/live")
        lines = TR.stream_carried_lines(live, ["doc_id"], "seq")
        lines.writeStream.foreachBatch(append_log(f"{out}/log")).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    log = read_log(spark, f"{out}/log", T.StructType.fromDDL("doc_id long, seq int, line long, value string"))
    return log.groupBy("doc_id", "value").agg(F.count("*").alias("n"))


@query(O.FX, """
SELECT file AS session_id, CASE WHEN event_type = 'error' THEN 'prompt' ELSE 'resolution' END AS kind,
  CASE WHEN event_type = 'error' THEN 'Needs your PERMISSION to use ' || (event_id % 4) ELSE '' END AS message, event_id AS ord
FROM base WHERE event_type IN ('error', 'click') AND ts + INTERVAL 1 MINUTE >= (SELECT now - INTERVAL 20 DAY FROM nowt)""")
def hook_events(spark, sf):
    since = F.lit(S.latest_time(spark, sf) - timedelta(days=20))
    return TR.hook_events(S.hook_lines(spark, sf), since).select("session_id", "kind", "message", "ord")


# --- usage -----------------------------------------------------------------

@query(O.FX, O.MSG, f"SELECT file, message_id, epoch_us(ts) AS ts_us, {SQL_TOK} FROM message")
def message_usage(spark, sf):
    return usage.message_usage(S.records(spark, sf)).select("file", "message_id", us("ts").alias("ts_us"), *tokens())


@query(O.FX, O.MSG, O.FACTS, f"SELECT file, {SQL_TOK}, round(CAST(pct AS DOUBLE), 4) AS context_pct FROM used")
def session_usage(spark, sf):
    r = S.records(spark, sf)
    u = facts.session_usage(facts.session_facts(r), usage.message_usage(r))
    return u.select("file", *tokens("usage"), F.round(F.col("usage.context_pct").cast("double"), 4).alias("context_pct"))


@query(O.FX, O.MSG, f"SELECT file, event_id, epoch_us(ts) AS ts_us, {SQL_TOK} FROM deltas")
def usage_deltas(spark, sf):
    return usage.usage_deltas(S.records(spark, sf)).select("file", event_id(), us("ts").alias("ts_us"), *tokens())


@query(O.FX, O.MSG, f"SELECT message_id, file, epoch_us(ts) AS ts_us, {SQL_TOK} FROM owned")
def owned_messages(spark, sf):
    return usage.owned_messages(usage.message_usage(S.records(spark, sf))).select(
        "message_id", "file", us("ts").alias("ts_us"), *tokens())


@query(O.FX, O.MSG, f"""
SELECT source, file, message_id, epoch_us(ts) AS ts_us, {SQL_TOK}, CAST(tin + tout + tread + twrite AS BIGINT) AS total_tokens
FROM uev WHERE ts <= (SELECT now - INTERVAL 1 DAY FROM nowt)""")
def past_usage_events(spark, sf):
    """What was known a day before the newest event: later ones are future events there."""
    now = F.lit(S.latest_time(spark, sf) - timedelta(days=1))
    return usage_events(spark, sf).where(F.col("ts_us") <= F.unix_micros(now))


@query(O.FX, O.MSG, f"""
SELECT source, file, message_id, epoch_us(ts) AS ts_us, {SQL_TOK}, CAST(tin + tout + tread + twrite AS BIGINT) AS total_tokens FROM uev""")
def usage_events(spark, sf):
    return usage.usage_events(S.records(spark, sf)).select(
        "source", "file", "message_id", us("ts").alias("ts_us"), *tokens(), usage.total_tokens(F.col("tokens")).alias("total_tokens"))


def _accounts(spark, sf) -> DataFrame:
    return usage.owned_messages(usage.message_usage(S.records(spark, sf))).withColumn("account", user_of() % 5)


@query(O.FX, O.MSG, O.HOURS, f"""
SELECT account, epoch_us(start) AS start_us, epoch_us(start + INTERVAL 5 HOUR) AS end_us, {SQL_TOK}, CAST(n AS BIGINT) AS messages FROM blk""")
def billing_blocks(spark, sf):
    hourly = blocks.hourly_usage(_accounts(spark, sf), ["account"], S.now_of(spark, sf))
    return blocks.blocks(hourly, ["account"]).select(
        "account", us("block_start").alias("start_us"), us("block_end").alias("end_us"), *C.TOKEN_FIELDS, "messages")


@query(O.FX, O.MSG, O.HOURS, """
b5 AS (SELECT blk.* FROM blk, nowt WHERE start <= now AND start + INTERVAL 5 HOUR > now),
wk AS (SELECT user_id % 5 AS account, sum(tin + tout + tread + twrite) AS tot, count(*) AS n FROM owned, nowt
  WHERE ts <= now AND now - ts <= INTERVAL 7 DAY GROUP BY 1),
ac AS (SELECT DISTINCT user_id % 5 AS account FROM owned)""", """
SELECT ac.account, CAST(coalesce(b5.tin + b5.tout + b5.tread + b5.twrite, 0) AS BIGINT) AS block_tokens, CAST(coalesce(b5.n, 0) AS BIGINT) AS block_messages,
  epoch_us(b5.start + INTERVAL 5 HOUR) AS resets_us, CAST(coalesce(wk.tot, 0) AS BIGINT) AS week_tokens, CAST(coalesce(wk.n, 0) AS BIGINT) AS week_messages
FROM ac LEFT JOIN b5 ON b5.account = ac.account LEFT JOIN wk ON wk.account = ac.account""")
def plan_estimate(spark, sf):
    events = _accounts(spark, sf)
    est = blocks.plan_estimate(events, events, ["account"], S.now_of(spark, sf))
    return est.select(
        "account", usage.total_tokens(F.col("claude.five_hour.tokens")).alias("block_tokens"),
        F.col("claude.five_hour.messages").alias("block_messages"), us("claude.five_hour_resets_at").alias("resets_us"),
        usage.total_tokens(F.col("claude.weekly.tokens")).alias("week_tokens"), F.col("claude.weekly.messages").alias("week_messages"))


_PRICED = """
price AS (
  SELECT file, model, CASE WHEN lower(model) LIKE 'claude-fable%' OR lower(model) LIKE 'claude-mythos%' THEN 10
      WHEN lower(model) LIKE '%3-opus%' OR lower(model) LIKE '%opus-3%' THEN 15 WHEN lower(model) LIKE '%opus%' THEN 5
      WHEN lower(model) LIKE '%sonnet%' THEN 3 WHEN lower(model) LIKE '%haiku%' THEN 1 END AS r FROM facts
),
per AS (
  SELECT 'today' AS period, date_trunc('day', now) AS start FROM nowt UNION ALL SELECT '7d', now - INTERVAL 7 DAY FROM nowt
  UNION ALL SELECT '30d', now - INTERVAL 30 DAY FROM nowt UNION ALL SELECT 'all', TIMESTAMP '0001-01-01'
),
hit AS (
  SELECT CASE WHEN u.user_id % 2 = 0 THEN 'wsl' ELSE 'windows' END AS machine, per.period, u.*,
    CASE WHEN u.source <> 'codex' THEN r END AS rate
  FROM uev u JOIN per ON u.ts >= per.start JOIN price ON price.file = u.file WHERE u.ts <= (SELECT now FROM nowt)
),
grid AS (
  SELECT DISTINCT CASE WHEN user_id % 2 = 0 THEN 'wsl' ELSE 'windows' END AS machine, period, s.source
  FROM uev, per, (SELECT 'codex' AS source UNION ALL SELECT 'claude-code') s
),
sums AS (
  SELECT machine, period, source, count(DISTINCT file) AS sessions, count(*) AS messages, sum(tin) AS tin, sum(tout) AS tout, sum(tread) AS tread, sum(twrite) AS twrite,
    sum((tin * 100 + tout * 500 + tread * 10 + twrite * 125) * rate) AS cents
  FROM hit GROUP BY 1, 2, 3
),
tot AS (
  SELECT g.machine, g.period, g.source, coalesce(sessions, 0) AS sessions, coalesce(messages, 0) AS messages, coalesce(tin, 0) AS tin,
    coalesce(tout, 0) AS tout, coalesce(tread, 0) AS tread, coalesce(twrite, 0) AS twrite, cents
  FROM grid g LEFT JOIN sums s ON s.machine = g.machine AND s.period = g.period AND s.source = g.source
)"""


def _totals(spark, sf, cost=None) -> DataFrame:
    r = S.records(spark, sf)
    events = usage.usage_events(r).withColumn("machine", machine_of())
    return periods.period_totals(events, usage.file_models(r), S.now_of(spark, sf), cost=cost)


def scaled_cost(source: Column, model: Column, t: Column) -> Column:
    """Cost in 1e-8 USD as an integer, so that sums do not depend on their order."""
    rate = usage.price_per_mtok(model)["input"].cast("bigint")
    units = t["input_tokens"] * 100 + t["output_tokens"] * 500 + t["cache_read_tokens"] * 10 + t["cache_creation_tokens"] * 125
    return F.when(source != C.SOURCE_B, units * rate)


@query(O.FX, O.MSG, O.FACTS, _PRICED, f"""
SELECT machine, period, source, sessions, messages, {SQL_TOK}, CAST(cents AS BIGINT) AS cost_e8 FROM tot""")
def period_totals(spark, sf):
    return _totals(spark, sf, scaled_cost).withColumn("cost_e8", F.col("est_cost_usd").cast("bigint")).drop("est_cost_usd")


ZONES = {"wsl": "Europe/Berlin", "windows": "America/New_York"}


@query(O.FX, O.MSG, """
d AS (SELECT *, CASE WHEN user_id % 2 = 0 THEN 1 ELSE -5 END AS shift FROM (SELECT u.*, CAST(substr(file, 2) AS BIGINT) AS user_id FROM uev u)),
t AS (SELECT d.*, date_trunc('day', now + shift * INTERVAL 1 HOUR) - shift * INTERVAL 1 HOUR AS midnight, now FROM d, nowt)""", f"""
SELECT CASE WHEN user_id % 2 = 0 THEN 'wsl' ELSE 'windows' END AS machine, epoch_us(midnight) AS since_us, source, count(DISTINCT file) AS sessions, count(*) AS messages,
  CAST(sum(tin) AS BIGINT) AS input_tokens FROM t WHERE ts <= now AND ts >= midnight GROUP BY ALL""")
def local_today(spark, sf):
    """Usage since local midnight, each machine in its own zone."""
    r, now = S.records(spark, sf), S.now_of(spark, sf)
    zone = F.when(F.col("machine") == "wsl", ZONES["wsl"]).otherwise(ZONES["windows"])
    events = usage.usage_events(r).withColumn("machine", machine_of()).withColumn("since", periods.zone_midnight(now, zone))
    totals = periods.period_totals(events, usage.file_models(r), now, midnight=F.col("since"), scope=("machine", "since"), cost=scaled_cost)
    return totals.where("period = 'today' AND messages > 0").select("machine", us("since").alias("since_us"), "source", "sessions", "messages", "input_tokens")


@query(O.FX, O.MSG, O.FACTS, _PRICED, f"""
SELECT coalesce(source, 'all') AS source, CAST(sum(sessions) AS BIGINT) AS sessions, CAST(sum(messages) AS BIGINT) AS messages,
  CAST(sum(tin + tout + tread + twrite) AS BIGINT) AS total_tokens, round(CAST(sum(cents) AS DOUBLE) / 1e8, 4) AS est_cost_usd
FROM tot WHERE period = '7d' GROUP BY ROLLUP (source)""")
def all_machine_totals(spark, sf):
    return periods.all_machines(_totals(spark, sf), "7d").select(
        F.coalesce("source", F.lit("all")).alias("source"), "sessions", "messages", "total_tokens",
        F.round("est_cost_usd", 4).alias("est_cost_usd"))


@query(O.FX, O.MSG, O.FACTS, _PRICED, """
SELECT machine, period, source, sessions, messages, round(CAST(cents AS DOUBLE) / 1e8, 4) AS est_cost_usd,
  (SELECT strftime(now, '%Y-%m-%dT%H:%M:%S.%gZ') FROM nowt) AS computed_at FROM tot""")
def usage_stats(spark, sf):
    nested = periods.usage_stats(_totals(spark, sf), S.now_of(spark, sf))
    return nested.select("machine", "computed_at", F.explode("periods").alias("p")).select(
        "machine", "computed_at", F.col("p.key").alias("period"), F.explode(F.create_map(
            F.lit(C.SOURCE_A), F.col("p.claude"), F.lit(C.SOURCE_B), F.col("p.codex"))).alias("source", "t")).select(
        "machine", "period", "source", "t.sessions", "t.messages", F.round("t.est_cost_usd", 4).alias("est_cost_usd"), "computed_at")


_LIMITS = """
lim AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'wsl' ELSE 'windows' END AS machine, arg_max({'e': event_id, 't': t}, {'t': coalesce(t, TIMESTAMP '1970-01-01'), 'f': file}) AS m
  FROM (SELECT file, user_id, arg_max(event_id, event_id) AS event_id, arg_max({'t': t}, event_id).t AS t FROM fx WHERE limited GROUP BY 1, 2) GROUP BY 1)"""


@query(O.FX, _LIMITS, """
SELECT machine, CAST(m.e % 101 AS DOUBLE) + 0.5 AS primary_used, epoch_us(m.t) AS observed_us FROM lim""")
def newest_limits(spark, sf):
    f = facts.session_facts(S.records(spark, sf)).withColumn("machine", machine_of())
    return reports.newest_limits(f).select(
        "machine", F.col("codex.primary.used_percent").alias("primary_used"), us("codex.observed_at").alias("observed_us"))


def _plan_bodies(spark, sf) -> DataFrame:
    """Plan-window responses from the events: four machines, some bodies without a window."""
    body = F.expr("""CASE WHEN event_id % 19 = 0 THEN 'oops' ELSE concat(
        '{"five_hour":', IF(event_id % 7 = 0, 'null', concat('{"utilization":', IF(event_id % 11 = 0, 'null', CAST(event_id % 100 AS STRING)),
            ',"resets_at":"2024-02-01T00:00:00Z","extra":1}')),
        ',"seven_day":{"utilization":', event_id % 60, '.25,"resets_at":null},"seven_day_opus":',
        IF(event_id % 2 = 0, '{"utilization":null}', '{"utilization":3}'), ',"limits":[1,2]}') END""")
    return S.events(spark, sf).select(
        F.concat(F.lit("m"), (F.col("user_id") % 4).cast("string")).alias("machine"), body.alias("body"),
        F.col("ts").alias("observed_at"), F.col("event_id").alias("arrival"))


@query("""SELECT event_id AS arrival, CASE WHEN event_id % 19 = 0 THEN 'invalid body' WHEN event_id % 7 = 0 OR event_id % 11 = 0 THEN 'missing five_hour window' END AS error,
  CASE WHEN event_id % 19 <> 0 AND event_id % 7 <> 0 AND event_id % 11 <> 0 THEN CAST(event_id % 100 AS DOUBLE) END AS five_hour,
  CASE WHEN event_id % 19 <> 0 AND event_id % 7 <> 0 AND event_id % 11 <> 0 THEN epoch_us(TIMESTAMP '2024-02-01') END AS five_hour_resets,
  CASE WHEN event_id % 19 <> 0 AND event_id % 7 <> 0 AND event_id % 11 <> 0 THEN event_id % 60 + 0.25::DOUBLE END AS seven_day,
  CASE WHEN event_id % 19 <> 0 AND event_id % 7 <> 0 AND event_id % 11 <> 0 AND event_id % 2 <> 0 THEN 3.0::DOUBLE END AS opus FROM events""")
def plan_windows(spark, sf):
    r = reports.parse_plan_windows(_plan_bodies(spark, sf))
    return r.select("arrival", "error", F.col("reading.five_hour.used_percent").alias("five_hour"),
                    us("reading.five_hour.resets_at").alias("five_hour_resets"),
                    F.col("reading.seven_day.used_percent").alias("seven_day"), F.col("reading.seven_day_opus.used_percent").alias("opus"))


_READ = """
rd AS (SELECT 'm' || (user_id % 4) AS machine, arg_max(event_id, ts) AS e, max(ts) AS ts FROM events
  WHERE event_id % 19 <> 0 AND event_id % 7 <> 0 AND event_id % 11 <> 0 AND ts <= (SELECT max(ts) FROM events) GROUP BY 1),
exact AS (SELECT rd.* FROM rd WHERE (SELECT max(ts) FROM events) - ts < INTERVAL 15 MINUTE)"""


@query(_READ, "SELECT machine, CAST(e % 100 AS DOUBLE) AS five_hour, epoch_us(ts) AS observed_us FROM exact")
def fresh_readings(spark, sf):
    r = reports.fresh_readings(reports.parse_plan_windows(_plan_bodies(spark, sf)), S.now_of(spark, sf))
    return r.select("machine", F.col("claude_exact.five_hour.used_percent").alias("five_hour"), us("claude_exact.observed_at").alias("observed_us"))


@query(_READ, "SELECT CAST(arg_max(e % 100, ts) AS DOUBLE) AS five_hour, epoch_us(max(ts)) AS observed_us FROM rd")
def account_exact(spark, sf):
    good = reports.parse_plan_windows(_plan_bodies(spark, sf)).withColumnRenamed("reading", "claude_exact")
    return reports.account_exact(good).select(
        F.col("claude_exact.five_hour.used_percent").alias("five_hour"), us("claude_exact.observed_at").alias("observed_us"))


def _reports(spark, sf) -> DataFrame:
    """Assembled usage reports of the two machines at ``now``."""
    r, now = S.records(spark, sf), S.now_of(spark, sf)
    f = materialize(facts.session_facts(r), "facts").withColumn("machine", machine_of())
    messages = usage.message_usage(r).withColumn("machine", machine_of())
    owned = usage.owned_messages(messages, ("machine",))
    est = blocks.plan_estimate(owned, f, ["machine"], now)
    readings = reports.parse_plan_windows(_plan_bodies(spark, sf).withColumn(
        "machine", F.when(F.col("machine").isin("m0", "m2"), "wsl").otherwise("windows")))
    return reports.usage_report(f, est, reports.fresh_readings(readings, now), reports.newest_limits(f), now)


_BY_MACHINE = """
om AS (SELECT * EXCLUDE (rn) FROM (SELECT *, CASE WHEN user_id % 2 = 0 THEN 'wsl' ELSE 'windows' END AS machine,
  row_number() OVER (PARTITION BY user_id % 2, message_id ORDER BY ts DESC, file DESC) AS rn FROM message WHERE ts IS NOT NULL) WHERE rn = 1),
wk AS (SELECT machine, sum(tin + tout + tread + twrite) AS tot, count(*) AS n FROM om, nowt WHERE ts <= now AND now - ts <= INTERVAL 7 DAY GROUP BY 1),
ex AS (SELECT CASE WHEN machine IN ('m0', 'm2') THEN 'wsl' ELSE 'windows' END AS machine, arg_max(e, ts) AS e, max(ts) AS ts FROM exact GROUP BY 1)"""


@query(O.FX, O.MSG, _LIMITS, _READ, _BY_MACHINE, O.HOURS.replace("user_id % 5 AS account", "machine AS account").replace("FROM owned", "FROM om"),
       "b5 AS (SELECT blk.* FROM blk, nowt WHERE start <= now AND start + INTERVAL 5 HOUR > now)", """
SELECT wk.machine, CAST(coalesce(b5.tin + b5.tout + b5.tread + b5.twrite, 0) AS BIGINT) AS five_hour_tokens, CAST(coalesce(b5.n, 0) AS BIGINT) AS five_hour_messages,
  epoch_us(b5.start + INTERVAL 5 HOUR) AS five_hour_resets_us, CAST(wk.tot AS BIGINT) AS week_tokens, wk.n AS week_messages, 'estimated' AS confidence, CAST(ex.e % 100 AS DOUBLE) AS exact_used,
  CAST(lim.m.e % 101 AS DOUBLE) + 0.5 AS codex_used, strftime(now, '%Y-%m-%dT%H:%M:%S.%gZ') AS reported_at
FROM wk LEFT JOIN ex ON ex.machine = wk.machine LEFT JOIN lim ON lim.machine = wk.machine LEFT JOIN b5 ON b5.account = wk.machine, nowt""")
def usage_report(spark, sf):
    return _reports(spark, sf).select(
        "machine", usage.total_tokens(F.col("claude.five_hour.tokens")).alias("five_hour_tokens"), F.col("claude.five_hour.messages").alias("five_hour_messages"),
        us("claude.five_hour_resets_at").alias("five_hour_resets_us"), usage.total_tokens(F.col("claude.weekly.tokens")).alias("week_tokens"), F.col("claude.weekly.messages").alias("week_messages"),
        F.col("claude.confidence").alias("confidence"), F.col("claude_exact.five_hour.used_percent").alias("exact_used"),
        F.col("codex.primary.used_percent").alias("codex_used"), "reported_at")


def _report_stream(spark, sf) -> DataFrame:
    """A report per event: machines m0..m3, codex used in coarse steps, report time = event time."""
    window = F.struct((F.floor(F.col("event_id") / 40) % 100).cast("double").alias("used_percent"), F.lit(300).cast("bigint").alias("window_minutes"),
                      F.lit(None).cast("bigint").alias("resets_at"))
    none = F.lit(None)
    return S.events(spark, sf).select(
        F.concat(F.lit("m"), (F.col("user_id") % 4).cast("string")).alias("machine"),
        none.cast(C.PLAN_ESTIMATE).alias("claude"), none.cast(C.PLAN_WINDOWS).alias("claude_exact"),
        F.struct(window.alias("primary"), none.cast(C.LIMIT_WINDOW).alias("secondary"), F.lit("plus").alias("plan_type"),
                 none.cast("timestamp").alias("observed_at")).alias("codex"),
        render_millis(F.col("ts")).alias("reported_at"), F.col("event_id").alias("arrival"))


@query("""r AS (SELECT event_id, 'm' || (user_id % 4) AS machine, event_id // 40 % 100 AS used, lag(event_id // 40 % 100) OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS was FROM events)""",
       "SELECT machine, event_id AS arrival, CAST(used AS DOUBLE) AS used FROM r WHERE was IS NULL OR was <> used")
def changed_reports(spark, sf):
    r = reports.changed_reports(_report_stream(spark, sf), "arrival")
    return r.select("machine", "arrival", F.col("codex.primary.used_percent").alias("used"))


@query("""r AS (SELECT 'm' || (user_id % 4) AS machine, max(event_id) AS arrival, max(ts) AS ts FROM events GROUP BY 1)""",
       """SELECT machine, arrival, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS reported_at FROM r
WHERE (SELECT max(ts) FROM events) + INTERVAL 1 MINUTE - date_trunc('milliseconds', ts) < INTERVAL 3 MINUTE""")
def live_reports(spark, sf):
    now = F.lit(S.latest_time(spark, sf) + timedelta(minutes=1))
    newest = reports.newest_per_machine(_report_stream(spark, sf), "arrival")
    return reports.live_reports(newest, now).select("machine", "arrival", "reported_at")


# --- sessions --------------------------------------------------------------

def _sessions(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts with pending and task, usage, waiting prompts)."""
    r = S.records(spark, sf)
    base = materialize(facts.session_facts(r), "facts")  # one row per file, read by all three
    f = materialize(facts.with_pending(base, facts.call_states(facts.with_call_starts(r))), "sessions")
    hooks = facts.newest_hooks(TR.hook_events(S.hook_lines(spark, sf)))
    return f, facts.session_usage(base, usage.message_usage(r)), facts.waiting_prompts(hooks, base)


@query(O.FX, O.FACTS, """
SELECT file, intr AS interrupted, fin AS finished, nullif(stop, '') AS stop_reason, epoch_us(last_activity) AS last_activity_us FROM
  (SELECT * REPLACE (CASE WHEN source = 'codex' THEN NULL ELSE stop END AS stop) FROM facts)""")
def turn_flags(spark, sf):
    f = facts.session_facts(S.records(spark, sf))
    return f.select("file", F.coalesce("interrupted", F.lit(False)).alias("interrupted"), F.coalesce("finished", F.lit(False)).alias("finished"),
                    F.col("stop.reason").alias("stop_reason"), us("last_activity").alias("last_activity_us"))


@query(O.FX, O.FACTS, "SELECT file, session_id, prompt, epoch_us(prompt_ts) AS prompt_us FROM waiting")
def waiting_prompts(spark, sf):
    return _sessions(spark, sf)[2].select("file", "session_id", "prompt", us("prompt_ts").alias("prompt_us"))


@query(O.FX, O.FACTS, "SELECT file, state, pending, current_task FROM stated")
def session_states(spark, sf):
    f, _, prompts = _sessions(spark, sf)
    f = f.join(prompts.select("file", "prompt"), "file", "left")
    return f.select("file", facts.state_at(S.now_of(spark, sf), F.col("prompt").isNotNull()).alias("state"), "pending", "current_task")


@query(O.FX, O.MSG, O.FACTS, f"""
SELECT coalesce(session_id, 'unknown') AS agent_id, s.source, CASE WHEN user_id % 2 = 0 THEN 'wsl' ELSE 'windows' END AS machine, coalesce(cwd, '') AS project,
  CASE WHEN state = 'interrupted' THEN 'needs_you' ELSE state END AS status, git_branch, current_task,
  state IN ('needs_you', 'interrupted') AS needs_user, CASE WHEN state = 'needs_you' THEN prompt WHEN state = 'interrupted' THEN 'interrupted by user' END AS needs_user_reason,
  {SQL_TOK}, round(CAST(pct AS DOUBLE), 4) AS context_pct, coalesce(strftime(last_activity, '%Y-%m-%dT%H:%M:%S.%gZ'), '') AS last_activity, cwd AS jump_target
FROM stated s JOIN used u ON u.file = s.file WHERE session_id IS NOT NULL OR last_activity IS NOT NULL""")
def session_snapshots(spark, sf):
    f, u, prompts = _sessions(spark, sf)
    snap = facts.snapshots(f, u, prompts, machine_of(), S.now_of(spark, sf))
    return snap.select(
        "agent_id", "source", "machine", "project", "status", "git_branch", "current_task", "needs_user", "needs_user_reason",
        *tokens("usage"), F.round(F.col("usage.context_pct").cast("double"), 4).alias("context_pct"), "last_activity",
        F.col("jump.target").alias("jump_target"))


@query(O.FX, O.STATE, """
ch AS (SELECT * FROM (SELECT *, lag(state) OVER (PARTITION BY file ORDER BY event_id) AS was FROM st) WHERE state IS NOT NULL AND state IS DISTINCT FROM was),
cov AS (
  SELECT ch.file, ch.event_id, arg_max(o.task, {'s': o.since, 'e': o.event_id}) AS task FROM ch
  JOIN st o ON o.file = ch.file AND o.epoch = ch.epoch AND o.opens AND o.event_id <= ch.event_id AND ch.event_id < coalesce(o.ends, o.epoch_end + 1)
  WHERE ch.pending > 0 GROUP BY 1, 2)""", """
SELECT ch.file, ch.event_id, strftime(last_activity, '%Y-%m-%dT%H:%M:%S.%gZ') AS ts, state, CASE WHEN pending > 0 THEN cov.task ELSE todo.x END AS task
FROM ch LEFT JOIN cov ON cov.file = ch.file AND cov.event_id = ch.event_id""")
def state_timeline(spark, sf):
    return timeline.timeline(S.records(spark, sf)).select("file", event_id(), "ts", "state", "task")


@query(O.FX, O.STATE, "SELECT file, event_id, CAST(pending AS BIGINT) AS pending FROM st WHERE useful")
def pending_counts(spark, sf):
    return timeline.pending_counts(S.records(spark, sf)).select("file", event_id(), "pending")


@query(O.OBS, """
s AS (SELECT *, lag({'s': status, 't': current_task, 'l': last_activity, 'n': needs_user}) OVER (PARTITION BY machine, source, agent_id ORDER BY arrival) AS p FROM obs)""", """
SELECT machine, agent_id, arrival FROM s WHERE p IS NULL OR p <> {'s': status, 't': current_task, 'l': last_activity, 'n': needs_user}""")
def changed_snapshots(spark, sf):
    return timeline.changed_snapshots(S.observations(spark, sf), registry.KEY, "arrival").select("machine", "agent_id", "arrival")


# --- registry --------------------------------------------------------------

def _changes(spark, sf) -> DataFrame:
    return registry.registry_changes(S.observations(spark, sf))


@query(O.OBS, "SELECT arrival, key, change_type, status_changed, entered_needs_you, from_status FROM chg")
def registry_changes(spark, sf):
    return _changes(spark, sf).select("arrival", "key", "change_type", "status_changed", "entered_needs_you", "from_status")


@query(O.OBS, "SELECT key, last_activity AS at, from_status, status AS to_status, arrival FROM chg WHERE change_type <> 'unchanged' AND status_changed")
def status_transitions(spark, sf):
    return registry.transitions(_changes(spark, sf))


@query(O.OBS, "SELECT machine, source, agent_id, status, needs_user, last_activity, arrival FROM cur")
def latest_sessions(spark, sf):
    return registry.latest(S.observations(spark, sf)).select("machine", "source", "agent_id", "status", "needs_user", "last_activity", "arrival")


@query(O.OBS, "SELECT machine, agent_id, decays AND silent30 AS staled, CASE WHEN decays AND silent30 THEN 'stale' ELSE status END AS status FROM aged")
def stale_sessions(spark, sf):
    return registry.mark_stale(registry.latest(S.observations(spark, sf)), S.now_of(spark, sf)).select("machine", "agent_id", "staled", "status")


@query(O.OBS, "SELECT machine, agent_id, last_activity FROM aged WHERE NOT silent24")
def retained_sessions(spark, sf):
    current, now = registry.latest(S.observations(spark, sf)), S.now_of(spark, sf)
    keyed = current.withColumn("key", registry.session_key())
    return registry.remove_sessions(keyed, registry.expired(keyed, now)).select("machine", "agent_id", "last_activity")


@query(O.OBS, """
SELECT machine || '/' || source || '/' || agent_id AS key, CASE WHEN silent24 THEN 'removed' ELSE 'upsert' END AS event,
  CASE WHEN NOT silent24 THEN strftime(now, '%Y-%m-%dT%H:%M:%S.%gZ') END AS at, CASE WHEN NOT silent24 THEN 'stale' END AS to_status
FROM aged WHERE silent24 OR (decays AND silent30)""")
def housekeeping(spark, sf):
    return registry.housekeeping(registry.latest(S.observations(spark, sf)), S.now_of(spark, sf)).select("key", "event", "at", "to_status")


def _feed(spark, sf) -> DataFrame:
    """Opening state behind a third of the arrivals, all diffs, then one sweep at the end.

    The order of the feed is (arrival, step): the opening state follows the change of the same arrival.
    """
    changes, obs = _changes(spark, sf), S.observations(spark, sf)
    top = obs.agg(F.max("arrival")).first()[0]
    # one row per logical session, as a full state has
    seen = registry.latest(obs.where(F.col("arrival") <= top // 3), keys=["source", "agent_id"])
    opening = feed.full_state(seen, arrival=F.lit(top // 3).cast("bigint"), step=F.lit(1))
    sweep = registry.housekeeping(registry.latest(obs), S.now_of(spark, sf)).withColumn(
        "arrival", F.when(F.col("machine") == "wsl", top + 2).otherwise(top + 1).cast("bigint"))
    rows = feed.change_feed(changes, sweep).withColumn("step", F.lit(0))
    keep = ["event", "key", "logical_key", "machine", "status", "arrival", "step"]
    return rows.select(*keep).unionByName(opening.select(*keep))


_FEED = """
top AS (SELECT max(event_id) AS top, max(event_id) // 3 AS cut FROM events),
opening AS (SELECT * EXCLUDE (r) FROM (SELECT obs.*, row_number() OVER (PARTITION BY source, agent_id ORDER BY arrival DESC) AS r FROM obs, top WHERE arrival <= cut) WHERE r = 1),
fd AS (
  SELECT 'upsert' AS event, key, logical_key, machine, status, arrival, 0 AS step FROM chg WHERE change_type <> 'unchanged'
  UNION ALL SELECT CASE WHEN silent24 THEN 'removed' ELSE 'upsert' END, machine || '/' || source || '/' || agent_id, source || '/' || agent_id, machine,
    CASE WHEN decays AND silent30 THEN 'stale' ELSE status END, top + CASE WHEN machine = 'wsl' THEN 2 ELSE 1 END, 0 FROM aged, top WHERE silent24 OR (decays AND silent30)
  UNION ALL SELECT 'full', machine || '/' || source || '/' || agent_id, source || '/' || agent_id, machine, status, cut, 1 FROM opening, top
)"""


@query(O.OBS, _FEED, "SELECT event, key, logical_key, machine, status, arrival, step FROM fd")
def change_feed(spark, sf):
    return _feed(spark, sf)


@query(O.OBS, _FEED, """
v AS (SELECT fd.* FROM fd, top WHERE (arrival, step) >= (cut, 1)),
sh AS (SELECT logical_key, arg_max({'k': key, 's': status, 'a': arrival, 'm': machine}, {'a': arrival, 's': step}) AS w FROM v WHERE event <> 'removed' GROUP BY 1)""", """
SELECT logical_key, w.k AS key, w.m AS machine, w.s AS status FROM sh
WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.event = 'removed' AND v.key = sh.w.k AND v.arrival >= sh.w.a)""")
def card_view(spark, sf):
    return feed.card_view(_feed(spark, sf), "arrival", "step").select("logical_key", "key", "machine", "status")


COOLDOWN = timedelta(hours=12)
_ALERTS = """
al AS (SELECT DISTINCT logical_key, ts FROM chg WHERE entered_needs_you),
nx AS (SELECT a.logical_key, a.ts, min(b.ts) AS nxt FROM al a LEFT JOIN al b ON a.logical_key = b.logical_key AND b.ts >= a.ts + INTERVAL 12 HOUR GROUP BY 1, 2),
fired AS (
  SELECT logical_key, min(ts) AS ts FROM al GROUP BY 1
  UNION ALL SELECT f.logical_key, nx.nxt FROM fired f JOIN nx ON nx.logical_key = f.logical_key AND nx.ts = f.ts WHERE nx.nxt IS NOT NULL
)"""


def _fired(spark, sf) -> tuple[DataFrame, DataFrame]:
    edges = registry_stream.edges_of(_changes(spark, sf), "ts")
    return edges, alerts.throttle(edges, COOLDOWN)


@query(O.OBS, _ALERTS, "SELECT logical_key, epoch_us(ts) AS at_us FROM fired")
def alert_throttle(spark, sf):
    return _fired(spark, sf)[1].select("logical_key", us("alert_at").alias("at_us"))


@query(O.OBS, _ALERTS, r"""
SELECT c.logical_key, epoch_us(f.ts) AS at_us,
  CASE WHEN c.source = 'codex' THEN 'Codex' ELSE 'Claude Code' END || ' needs you — ' || CASE user_id % 4 WHEN 1 THEN c.project WHEN 3 THEN c.project ELSE 'p' || (user_id % 10) END AS title,
  '[' || c.machine || '] ' || coalesce(c.needs_user_reason, 'waiting on your input') AS body
FROM fired f JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY logical_key, ts ORDER BY arrival DESC) AS last FROM chg WHERE entered_needs_you) WHERE last = 1) c
  ON c.logical_key = f.logical_key AND c.ts = f.ts""")
def alert_view(spark, sf):
    edges, fired = _fired(spark, sf)
    return views.alert_view(edges.join(fired, ["logical_key", "alert_at"])).select("logical_key", us("alert_at").alias("at_us"), "title", "body")


# --- entities and views ----------------------------------------------------

@query(O.OBS, "SELECT arrival, source || '/' || agent_id AS logical_key, norm AS project FROM obs")
def normalized_projects(spark, sf):
    return S.observations(spark, sf).select("arrival", registry.logical_key().alias("logical_key"), P.normalize_project(F.col("project")).alias("project"))


@query(O.OBS, O.LOGICAL, "SELECT logical_key, machine, project, status, needs_user, needs_user_reason, last_activity FROM logical")
def logical_sessions(spark, sf):
    merged = entities.logical_sessions(registry.latest(S.observations(spark, sf)), timedelta(days=5))
    return entities.newest_first(merged).select("logical_key", "machine", "project", "status", "needs_user", "needs_user_reason", "last_activity")


@query(O.OBS, """
c AS (SELECT count(*) FILTER (WHERE status IN ('thinking', 'tool_running')) AS working, count(*) FILTER (WHERE status = 'needs_you') AS needs_you,
  count(*) FILTER (WHERE status = 'failed') AS failed FROM cur)""", """
SELECT working, needs_you, failed, working + needs_you AS active,
  CASE WHEN failed > 0 THEN 'failed' WHEN needs_you > 0 THEN 'needs-you' WHEN working > 0 THEN 'working' ELSE 'quiet' END AS tone FROM c""")
def live_counters(spark, sf):
    return views.live_counters(registry.latest(S.observations(spark, sf)))


@query(O.OBS, """
SELECT machine, agent_id, status, last_activity, CASE status WHEN 'needs_you' THEN 0 WHEN 'failed' THEN 1 WHEN 'tool_running' THEN 2 WHEN 'thinking' THEN 3
  WHEN 'done' THEN 4 WHEN 'idle' THEN 5 WHEN 'stale' THEN 6 ELSE 9 END AS status_rank FROM cur ORDER BY machine, status_rank, last_activity DESC""")
def panel(spark, sf):
    return views.panel(registry.latest(S.observations(spark, sf))).select("machine", "agent_id", "status", "last_activity", "status_rank")


@query(O.OBS, r"""
SELECT machine, agent_id,
  CASE status WHEN 'tool_running' THEN 'running' WHEN 'needs_you' THEN 'needs you' WHEN 'done' THEN 'done · waiting' ELSE status END AS status_label,
  CASE WHEN source = 'codex' THEN 'codex' ELSE 'claude' END AS source_label, 'p' || (user_id % 10) AS project_name,
  CASE WHEN act IS NULL THEN '' WHEN now - act < INTERVAL 10 SECOND THEN 'now' WHEN now - act < INTERVAL 1 MINUTE THEN (epoch_us(now) - epoch_us(act)) // 1000000 || 's ago'
    WHEN now - act < INTERVAL 1 HOUR THEN (epoch_us(now) - epoch_us(act)) // 60000000 || 'm ago' WHEN now - act < INTERVAL 24 HOUR THEN (epoch_us(now) - epoch_us(act)) // 3600000000 || 'h ago'
    ELSE (epoch_us(now) - epoch_us(act)) // 86400000000 || 'd ago' END AS ago,
  CASE WHEN user_id * 1001 >= 1000000 THEN printf('%.1fM', (user_id * 1001 + CASE WHEN user_id * 1001 % 1000000 IN (250000, 750000) THEN 50000 ELSE 0 END) / 1e6)
    WHEN user_id * 1001 >= 1000 THEN printf('%.1fk', (user_id * 1001 + CASE WHEN user_id * 1001 % 1000 IN (250, 750) THEN 50 ELSE 0 END) / 1e3)
    ELSE CAST(user_id * 1001 AS VARCHAR) END AS tokens,
  CASE WHEN user_id % 100 > 90 THEN 'critical' WHEN user_id % 100 > 70 THEN 'high' WHEN user_id % 100 > 50 THEN 'elevated' ELSE 'ok' END AS context_tone,
  CASE WHEN machine <> 'windows' AND user_id % 2 = 0 AND user_id % 4 = 0 OR machine <> 'windows' AND user_id % 4 = 3 THEN 'vscode://vscode-remote/wsl+Ubuntu' || project
    ELSE 'vscode://file/' || replace(replace(project, '\', '/'), '$', '%24') END AS editor_link,
  CASE WHEN machine <> 'windows' AND user_id % 4 IN (0, 3) THEN '\\wsl.localhost\Ubuntu' || replace(project, '/', '\') ELSE project END AS terminal_path
FROM aged""")
def session_cards(spark, sf):
    cards = views.session_cards(registry.latest(S.observations(spark, sf)), S.now_of(spark, sf))
    return cards.select("machine", "agent_id", "status_label", "source_label", "project_name", "ago", "tokens", "context_tone", "editor_link", "terminal_path")


@query("""u AS (SELECT page_id, url, string_split(url, '/') AS p FROM pages)""", """
SELECT page_id, list_last(list_filter(p, lambda x: x <> '')) AS name,
  replace(replace(replace(replace(replace(url, '%', '%25'), '?', '%3F'), '=', '%3D'), '&', '%26'), '#', '%23') AS encoded FROM u""")
def page_paths(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    return pages.select("page_id", P.project_name(F.col("url")).alias("name"), P.encode_path(F.col("url")).alias("encoded"))


_COUNTDOWN = """CASE WHEN s IS NULL OR s <= 0 THEN '' WHEN s // 3600 > 24 THEN 'resets in ' || (s // 3600 // 24) || 'd ' || (s // 3600 % 24) || 'h'
  WHEN s // 3600 > 0 THEN 'resets in ' || (s // 3600) || 'h ' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || 'm' ELSE 'resets in ' || (s // 60) || 'm' END"""


@query("nowt AS (SELECT max(ts) AS now FROM events)", """
SELECT event_id, """ + _COUNTDOWN + """ AS resets,
  CASE WHEN value >= 100 THEN '$' || CAST(CAST(floor(value + 0.5) AS BIGINT) AS VARCHAR) ELSE printf('$%.2f', value) END AS money
FROM (SELECT event_id, value, CAST(floor((epoch_ms(ts + INTERVAL 20 DAY) - epoch_ms(now)) / 1000) AS BIGINT) AS s FROM events, nowt)""")
def countdowns(spark, sf):
    now = S.now_of(spark, sf)
    return S.events(spark, sf).select(
        "event_id", D.resets_in(F.col("ts") + F.lit(timedelta(days=20)), now).alias("resets"), D.money(F.col("value")).alias("money"))


@query(O.FX, O.MSG, _LIMITS, _READ, _BY_MACHINE, O.HOURS.replace("user_id % 5 AS account", "machine AS account").replace("FROM owned", "FROM om"), """
b5 AS (SELECT blk.* FROM blk, nowt WHERE start <= now AND start + INTERVAL 5 HOUR > now),
best AS (SELECT arg_max(e, ts) AS e FROM ex HAVING count(*) > 0),
shown AS (
  SELECT 'account' AS machine, 'claude' AS who, 'exact' AS confidence, '5h' AS label, CAST(e % 100 AS DOUBLE) AS used, NULL AS tok, epoch_ms(TIMESTAMP '2024-02-01') AS target FROM best
  UNION ALL SELECT 'account', 'claude', 'exact', 'week', e % 60 + 0.25, NULL, NULL FROM best
  UNION ALL SELECT 'account', 'claude', 'exact', 'opus', 3.0, NULL, NULL FROM best WHERE e % 2 <> 0
  UNION ALL SELECT machine, 'codex', 'exact', '5h', m.e % 101 + 0.5, NULL, (1700000000 + m.e) * 1000 FROM lim
  UNION ALL SELECT machine, 'codex', 'exact', 'week', m.e % 11, NULL, NULL FROM lim WHERE m.e % 4 <> 0
  UNION ALL SELECT mm.machine, 'claude', 'estimated', '5h', NULL, coalesce(b5.tin + b5.tout + b5.tread + b5.twrite, 0), epoch_ms(b5.start + INTERVAL 5 HOUR)
    FROM (SELECT DISTINCT machine FROM om) mm LEFT JOIN b5 ON b5.account = mm.machine WHERE NOT EXISTS (SELECT 1 FROM best)
  UNION ALL SELECT mm.machine, 'claude', 'estimated', 'week', NULL, coalesce(wk.tot, 0), NULL
    FROM (SELECT DISTINCT machine FROM om) mm LEFT JOIN wk ON wk.machine = mm.machine WHERE NOT EXISTS (SELECT 1 FROM best)
)""", f"""
SELECT machine, who, confidence, label, CAST(floor(used + 0.5) AS BIGINT) AS pct,
  CASE WHEN used IS NULL THEN NULL WHEN used > 90 THEN 'critical' WHEN used > 70 THEN 'high' WHEN used > 50 THEN 'elevated' ELSE 'ok' END AS tone,
  CASE WHEN tok >= 1000000 THEN printf('%.1fM', (tok + CASE WHEN tok % 1000000 IN (250000, 750000) THEN 50000 ELSE 0 END) / 1e6)
    WHEN tok >= 1000 THEN printf('%.1fk', (tok + CASE WHEN tok % 1000 IN (250, 750) THEN 50 ELSE 0 END) / 1e3) ELSE CAST(tok AS VARCHAR) END AS tokens,
  {_COUNTDOWN} AS resets
FROM (SELECT shown.*, CAST(floor((target - epoch_ms(now)) / 1000) AS BIGINT) AS s FROM shown, nowt)""")
def usage_panel(spark, sf):
    # one row per machine, read once for each kind of panel row
    rows = materialize(reports.newest_per_machine(_reports(spark, sf).withColumn("arrival", F.lit(1)), "arrival"), "reports")
    return views.usage_panel(rows, reports.account_exact(rows), S.now_of(spark, sf))


@query(O.FX, O.MSG, O.FACTS, _PRICED, """
s AS (SELECT coalesce(source, 'all') AS source, sum(sessions) AS sessions, sum(messages) AS messages, sum(tin + tout + tread + twrite) AS n, sum(cents) / 1e8 AS c
  FROM tot WHERE period = '30d' GROUP BY ROLLUP (source))""", """
SELECT source, CAST(sessions AS BIGINT) AS sessions, CAST(messages AS BIGINT) AS messages,
  CASE WHEN n >= 1000000 THEN printf('%.1fM', (n + CASE WHEN n % 1000000 IN (250000, 750000) THEN 50000 ELSE 0 END) / 1e6)
    WHEN n >= 1000 THEN printf('%.1fk', (n + CASE WHEN n % 1000 IN (250, 750) THEN 50 ELSE 0 END) / 1e3) ELSE CAST(n AS VARCHAR) END AS tokens,
  CASE WHEN c IS NULL THEN '—' WHEN c >= 100 THEN '$' || format('{:,}', CAST(floor(c + 0.5) AS BIGINT)) ELSE printf('$%.2f', c) END AS cost FROM s""")
def stats_panel(spark, sf):
    return views.stats_panel(periods.all_machines(_totals(spark, sf), "30d"))


# --- bodies and persisted rows ---------------------------------------------

def _bodies(spark, sf) -> DataFrame:
    """One snapshot body per event: an object, or an array of two; every 17th holds a bad element."""
    obs = S.spread(S.observations(spark, sf)).withColumn("extra", F.lit(1))
    one = F.to_json(F.struct(*[f.name for f in C.SNAPSHOT.fields], "extra"))
    bad = F.when(F.col("arrival") % 34 == 0, F.regexp_replace(one, '"status":"', '"status":"x')).otherwise(F.regexp_replace(one, '"needs_user":(true|false)', '"needs_user":"no"'))
    body = (
        F.when(F.col("arrival") % 17 == 0, F.concat(F.lit("["), one, F.lit(","), bad, F.lit("]")))
        .when(F.col("arrival") % 2 == 0, F.concat(F.lit("["), one, F.lit(","), one, F.lit("]")))
        .when(F.col("arrival") % 101 == 0, F.substring(one, 1, 50)).otherwise(one))
    return obs.select("arrival", body.alias("body"))


@query(O.OBS, """
SELECT arrival, CAST(k AS BIGINT) AS position, agent_id, machine, status, git_branch, needs_user, needs_user_reason, user_id * 1000 AS input_tokens, project AS jump_target
FROM obs, (SELECT 0 AS k UNION ALL SELECT 1) WHERE arrival % 17 <> 0 AND (arrival % 2 = 0 OR (k = 0 AND arrival % 101 <> 0))""")
def ingested_snapshots(spark, sf):
    accepted, _ = SN.ingest_snapshots(_bodies(spark, sf))
    return accepted.select("arrival", F.col("position").cast("bigint").alias("position"), "agent_id", "machine", "status", "git_branch",
                           "needs_user", "needs_user_reason", F.col("usage.input_tokens").alias("input_tokens"), F.col("jump.target").alias("jump_target"))


@query(O.OBS, "SELECT arrival FROM obs WHERE arrival % 17 = 0 OR (arrival % 2 = 1 AND arrival % 101 = 0)")
def rejected_bodies(spark, sf):
    return SN.ingest_snapshots(_bodies(spark, sf))[1].select("arrival")


@query(O.OBS, "SELECT agent_id, machine, source, status, project, needs_user_reason, last_activity FROM cur WHERE user_id % 7 <> 0")
def warm_start(spark, sf):
    now = S.now_of(spark, sf)
    stored = SN.to_stored(registry.latest(S.observations(spark, sf)), now)
    older = user_of("agent_id") % 7 == 0
    stored = stored.withColumn("snapshot", F.when(older, F.regexp_replace("snapshot", '"machine"', '"host"')).otherwise(F.col("snapshot")))
    return SN.load_sessions(stored).select("agent_id", "machine", "source", "status", "project", "needs_user_reason", "last_activity")


@query("SELECT 'm' || (user_id % 4) AS machine, max(event_id) AS arrival, CAST(max(event_id) // 40 % 100 AS DOUBLE) AS used FROM events GROUP BY 1")
def ingested_reports(spark, sf):
    r = _report_stream(spark, sf)
    body = F.to_json(F.struct(*[f.name for f in C.USAGE_REPORT.fields]))
    newest = reports.newest_per_machine(SN.parse_reports(r.select("arrival", body.alias("body"))), "arrival")
    return newest.select("machine", "arrival", F.col("codex.primary.used_percent").alias("used"))


@query(O.FX, O.MSG, O.FACTS, _PRICED, """
SELECT machine, period, CAST(max(CASE WHEN source = 'codex' THEN messages END) AS BIGINT) AS codex_messages,
  CAST(max(CASE WHEN source <> 'codex' THEN tin END) AS BIGINT) AS claude_input FROM tot GROUP BY 1, 2""")
def ingested_stats(spark, sf):
    sent = periods.usage_stats(_totals(spark, sf), S.now_of(spark, sf))
    body = F.to_json(F.struct(*[f.name for f in C.USAGE_STATS.fields]))
    newest = reports.newest_per_machine(SN.parse_stats(sent.select(body.alias("body"))), "computed_at")
    return newest.select("machine", F.explode("periods").alias("p")).select(
        "machine", F.col("p.key").alias("period"), F.col("p.codex.messages").alias("codex_messages"),
        F.col("p.claude.input_tokens").alias("claude_input"))


@query(O.OBS, """
SELECT c.key, c.from_status, c.status AS to_status, cur.status AS now_status, count(*) AS n FROM chg c JOIN cur ON c.key = cur.machine || '/' || cur.source || '/' || cur.agent_id
WHERE c.change_type <> 'unchanged' AND c.status_changed GROUP BY ALL""")
def history_by_sql(spark, sf):
    """The read interface: derived tables under names, read by SQL."""
    current = registry.latest(S.observations(spark, sf)).withColumn("key", registry.session_key())
    views.register_views(spark, session_changes=registry.transitions(_changes(spark, sf)), live_sessions=current)
    return spark.sql("""
        SELECT key, from_status, to_status, s.status AS now_status, count(*) AS n
        FROM session_changes JOIN live_sessions s USING (key) GROUP BY ALL""")


# --- landed files and streams ----------------------------------------------

def _land(spark, sf) -> str:
    """Write the derived transcript lines into a landing folder for the file stream."""
    root = new_folder(spark, "landing")
    S.transcript_lines(spark, sf).write.parquet(root)
    return root


def _landed_lines(spark, root: str) -> DataFrame:
    """The landed lines in several triggers, each of enough files for all cores."""
    files, cores = len(spark.read.schema(C.LINES).parquet(root).inputFiles()), spark.sparkContext.defaultParallelism
    return spark.readStream.schema(C.LINES).option(
        "maxFilesPerTrigger", max(4, min(cores, files // 3), files // 8)).parquet(root)


STEPS = 5


def _tracking_run(spark, sf) -> str:
    """The tracking stream over fifths of the lines and hooks, with the real retention; one run per application."""
    key = ("tracking", spark.sparkContext.applicationId, sf)
    if key not in _RUNS:
        root, hooks, out = new_folder(spark, "landing"), new_folder(spark, "hooks"), new_folder(spark, "tracking")
        lines = materialize(S.transcript_lines(spark, sf).withColumn("event_id", event_id()), "lines")
        told, top = S.hook_lines(spark, sf), lines.agg(F.max("event_id")).first()[0]
        for part in range(STEPS):
            low, high = top * part // STEPS if part else -1, top * (part + 1) // STEPS
            now = lambda c: (F.col(c) > low) & (F.col(c) <= high)  # noqa: B023, E731
            lines.where(now("event_id")).drop("event_id").write.mode("append").parquet(root)
            told.where(now("ord")).write.mode("append").parquet(hooks)
            live, hook = spark.readStream.schema(C.LINES).parquet(root), spark.readStream.schema(TR.HOOK_COLUMNS).parquet(hooks)
            for q in tracking.track(live, out, hook, clock=tracking.event_clock):
                q.awaitTermination()
        _RUNS[key] = out
    return _RUNS[key]


def _lives_sql() -> str:
    """Which files the tracking stream holds after each step, and since which step: a file leaves when it has been silent for a day."""
    cut = " ".join(f"WHEN event_id <= top * {i + 1} // {STEPS} THEN {i}" for i in range(STEPS))
    parts = ["edge AS (SELECT max(event_id) AS top FROM events)", f"ev AS (SELECT fx.*, CASE {cut} END AS batch FROM fx, edge)", """
nb AS (SELECT batch, max(greatest(active_ts, CASE WHEN event_type IN ('error', 'click') THEN ts + INTERVAL 1 MINUTE END)) AS now FROM ev GROUP BY 1)"""]
    for i in range(STEPS):
        now = f"(SELECT now FROM nb WHERE batch = {i})"
        parts.append(f"n{i} AS (SELECT file, max(active_ts) AS act FROM ev WHERE batch = {i} GROUP BY 1)")
        parts.append(f"""st{i} AS (SELECT coalesce(k.file, n.file) AS file, CASE WHEN k.file IS NULL THEN {i} ELSE k.start END AS start, greatest(k.act, n.act) AS act,
  CASE WHEN n.file IS NOT NULL THEN {now} ELSE k.landed END AS landed FROM kp{i - 1} k FULL JOIN n{i} n ON k.file = n.file)""" if i else f"""
st0 AS (SELECT file, 0 AS start, act, {now} AS landed FROM n0)""")
        parts.append(f"kp{i} AS (SELECT * FROM st{i} WHERE coalesce(act, landed) + INTERVAL 24 HOUR > {now})")
    lives = " UNION ALL ".join(f"SELECT file, start, {i} AS batch FROM st{i}" for i in range(STEPS))
    parts.append(f"lives AS ({lives})")
    parts.append(f"fxk AS (SELECT ev.* EXCLUDE (batch) FROM ev JOIN kp{STEPS - 1} k ON k.file = ev.file WHERE batch >= start)")
    parts.append("fxl AS (SELECT ev.* EXCLUDE (batch) REPLACE (ev.file || '#' || start AS file) FROM ev JOIN lives ON lives.file = ev.file AND lives.batch = ev.batch)")
    return ",".join(parts)


_LIVES = _lives_sql()
_KEPT = [O.FX, _LIVES, O.MSG.replace("FROM fx ", "FROM fxk "), O.FACTS.replace("FROM fx ", "FROM fxk ")]


@query(*_KEPT, f"""
SELECT s.file, s.source, state, pending, {SQL_TOK}, parse_errors, sidechain_records FROM stated s JOIN used u ON u.file = s.file""")
def stream_tracking(spark, sf):
    """State of every file that was active in the last day, after five steps."""
    state = tracking.tracked(spark, _tracking_run(spark, sf), hooks=True)
    f = facts.with_pending(state.facts, state.calls)
    waits = facts.unanswered(state.delivered, f).select("file", F.lit(True).alias("waits"))
    u = facts.session_usage(f, state.messages).drop("source")
    return f.join(u, "file").join(waits, "file", "left").select(
        "file", "source", facts.state_at(S.now_of(spark, sf), F.coalesce("waits", F.lit(False))).alias("state"), "pending", *tokens("usage"),
        "parse_errors", "sidechain_records")


@query(O.FX, _LIVES, O.MSG.replace("FROM fx ", "FROM fxl "), f"""
SELECT split_part(file, '#', 1) AS file, event_id, epoch_us(ts) AS ts_us, {SQL_TOK} FROM deltas""")
def stream_usage_deltas(spark, sf):
    """Increments appended step by step; a file that left the state starts again from nothing."""
    return tracking.usage_increments(spark, _tracking_run(spark, sf)).select("file", event_id(), us("ts").alias("ts_us"), *tokens())


# Most lines of a landed chunk, about a megabyte of text: files grow with the sessions and the text, not with the numbers of the events.
LANDED_LINES = 4096


def _landed_files(spark, sf) -> str:
    """The derived transcripts as text, as Spark's writer lands them: ``session=<session>/part-…``, chunks in the order of their names."""
    key = ("landed files", spark.sparkContext.applicationId, sf)
    if key not in _RUNS:
        root = new_folder(spark, "jsonl")
        lines = S.transcript_lines(spark, sf).select(F.col("file").alias("session"), "seq", "line", "value")
        # tasks put their own files in place; the driver would move them one by one
        lines.repartitionByRange("session", "seq", "line").sortWithinPartitions("session", "seq", "line").select("session", "value") \
            .write.options(**{"mapreduce.fileoutputcommitter.algorithm.version": "2", "maxRecordsPerFile": LANDED_LINES}) \
            .partitionBy("session").text(root)
        _RUNS[key] = root
    return _RUNS[key]


_RUNS: dict[tuple[str, ...], str] = {}
BATCHES = 3


def _registry_run(spark, sf) -> str:
    """The registry stream over thirds of the observations, with real limits and the sweep on; one run per application."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _RUNS:
        root, out = new_folder(spark, "snapshots"), new_folder(spark, "registry")
        obs = S.observations(spark, sf).withColumnRenamed("ts", "received_at").withColumnRenamed("arrival", "sent")
        told = _report_stream(spark, sf).withColumnRenamed("arrival", "sent")
        top = obs.agg(F.max("sent")).first()[0]
        clock = lambda batch: batch.agg(F.max("received_at").alias("now"))
        for part in range(BATCHES):
            low, high = top * part // BATCHES if part else -1, top * (part + 1) // BATCHES
            for rows, name in ((obs, "sessions"), (told, "reports")):
                rows.where((F.col("sent") > low) & (F.col("sent") <= high)).write.mode("append").parquet(f"{root}/{name}")
            stream = spark.readStream.schema(obs.schema).parquet(f"{root}/sessions")
            usage_reports = spark.readStream.schema(told.schema).parquet(f"{root}/reports")
            registry_stream.run_registry(stream, out, ["sent"], clock=clock, usage=usage_reports).awaitTermination()
            if not part:
                first = registry_stream.opening(spark, out)
                first.write.parquet(f"{out}/opening")
        _RUNS[key] = out
    return _RUNS[key]


def _stream_sql() -> str:
    """The same run in SQL: rows, changes, newest rows and survivors of each batch."""
    same = "{'s': status, 'n': needs_user, 't': current_task, 'r': needs_user_reason, 'l': last_activity}"
    carried = "agent_id, source, machine, project, norm, status, current_task, needs_user, needs_user_reason, last_activity, act"
    parts = ["edge AS (SELECT max(event_id) AS top FROM events)"]
    for i in range(BATCHES):
        low = f"top * {i} // {BATCHES}" if i else "-1"
        stored = f"SELECT {carried}, false AS live, NULL AS arrival, NULL AS ts FROM kept{i - 1} UNION ALL " if i else ""
        parts.append(f"""
rows{i} AS (SELECT {carried}, true AS live, arrival, ts FROM obs, edge WHERE arrival > {low} AND arrival <= top * {i + 1} // {BATCHES}),
now{i} AS (SELECT max(ts) AS now FROM rows{i}),
all{i} AS (SELECT *, lag({same}) OVER w AS was, row_number() OVER w AS rn FROM ({stored}SELECT * FROM rows{i}) WINDOW w AS (PARTITION BY machine, source, agent_id ORDER BY live, arrival)),
step{i} AS (SELECT *, machine || '/' || source || '/' || agent_id AS key, source || '/' || agent_id AS logical_key, was.s AS from_status, rn = 1 OR was.s <> status AS status_changed,
  needs_user AND NOT coalesce(was.n, false) AS entered FROM all{i} WHERE live),
new{i} AS (SELECT * EXCLUDE (r) FROM (SELECT {carried}, row_number() OVER (PARTITION BY machine, source, agent_id ORDER BY live DESC, arrival DESC) AS r FROM all{i}) WHERE r = 1),
age{i} AS (SELECT *, machine || '/' || source || '/' || agent_id AS key, source || '/' || agent_id AS logical_key, now, act IS NULL OR now - act >= INTERVAL 24 HOUR AS gone,
  status NOT IN ('stale', 'done', 'needs_you', 'failed') AND (act IS NULL OR now - act >= INTERVAL 30 MINUTE) AS staled FROM new{i}, now{i}),
kept{i} AS (SELECT * REPLACE (CASE WHEN staled THEN 'stale' ELSE status END AS status) FROM age{i} WHERE NOT gone)""")
    union = lambda sql: " UNION ALL ".join(sql.replace("#", str(i)) for i in range(BATCHES))
    parts.append("hist AS (" + union("""SELECT # AS batch_id, 1 AS phase, key, last_activity AS at, from_status, status AS to_status FROM step# WHERE status_changed
      UNION ALL SELECT #, 2, key, strftime(now, '%Y-%m-%dT%H:%M:%S.%gZ'), NULL, 'stale' FROM age# WHERE staled AND NOT gone""") + ")")
    parts.append("fd AS (" + union(f"""SELECT # AS batch_id, 1 AS phase, arrival, 'upsert' AS event, key, logical_key, machine, status FROM step# WHERE rn = 1 OR was <> {same}
      UNION ALL SELECT #, 2, row_number() OVER (ORDER BY key), CASE WHEN gone THEN 'removed' ELSE 'upsert' END, key, logical_key, machine, CASE WHEN staled THEN 'stale' ELSE status END
      FROM age# WHERE gone OR staled""") + ")")
    parts.append("edges AS (" + union("SELECT logical_key, ts, arrival, source, project, machine, needs_user_reason FROM step# WHERE entered") + ")")
    return ",".join(parts)


def _partition_value(folder: Column) -> Column:
    return F.substring_index(folder, "=", -1)


def _by_session(lines: DataFrame, session: Column) -> DataFrame:
    """Records of landed text, counted by session. Files of either dialect lie under one root, so the first line tells."""
    lines = materialize(lines, "landed")  # read by both, and opening a session's files again costs more than the text
    dialect = TR.sniff_source(lines)
    found = records.parse_records(lines.drop("source").join(dialect, "file"))
    own = found.withColumn("session", session).groupBy("session", "source")
    return own.agg(F.count_if((F.col("pos") < 0)).alias("lines"), F.count_if(F.col("parse_error")).alias("parse_errors"), F.count_if(F.col("opens")).alias("calls"))


_LANDED = ("""
    d AS (SELECT file, CASE WHEN arg_min(env, event_id) THEN 'codex' ELSE 'claude-code' END AS found FROM fx GROUP BY 1)""", """
SELECT fx.file AS session, d.found AS source, count(*) AS lines, count(*) FILTER (WHERE event_id % 97 = 0) AS parse_errors, count(*) FILTER (WHERE opens AND b = (d.found = 'codex')) AS calls
FROM fx JOIN d ON d.file = fx.file GROUP BY ALL""")


@query(O.FX, *_LANDED)
def landed_records(spark, sf):
    """Text chunks of each session read by ``read_chunks`` and parsed."""
    lines = TR.read_chunks(spark, [(_landed_files(spark, sf), C.SOURCE_A)], "part-*")
    lines = lines.withColumn("file", _partition_value(F.element_at(F.split("file", "/"), -1)))
    return _by_session(lines, F.col("file"))


@query(O.FX, *_LANDED)
def closed_records(spark, sf):
    """The same text read as closed files; a session's chunks are put in order by their names."""
    lines = TR.read_closed_files(spark, [(_landed_files(spark, sf), C.SOURCE_A)], "part-*")
    parts = F.split("file", "/")
    chunk = TR.part_number(F.element_at(parts, -1))
    lines = lines.withColumn("seq", chunk * (1 << 32) + F.col("seq")).withColumn("file", _partition_value(F.element_at(parts, -2)))
    return _by_session(lines, F.col("file"))


@query(*_KEPT, "SELECT file, session_id, prompt, epoch_us(prompt_ts) AS prompt_us FROM waiting")
def stream_prompts(spark, sf):
    """Prompts that the tracking stream delivered to a transcript in which nothing happened since."""
    state = tracking.tracked(spark, _tracking_run(spark, sf), hooks=True)
    return facts.unanswered(state.delivered, state.facts).select("file", "session_id", "prompt", us("prompt_ts").alias("prompt_us"))


@query(O.FX, O.MSG, f"""
SELECT source, file, message_id, epoch_us(ts) AS ts_us, {SQL_TOK}, CAST(tin + tout + tread + twrite AS BIGINT) AS total_tokens FROM uev""")
def stream_usage_events(spark, sf):
    """Usage events of a stream: lines parsed once into the record log, events read from it."""
    root, out = _land(spark, sf), new_folder(spark, "tracking")
    tracking.log_records(_landed_lines(spark, root), out).awaitTermination()
    return usage.usage_events(tracking.logged_records(spark, out)).select(
        "source", "file", "message_id", us("ts").alias("ts_us"), *tokens(), usage.total_tokens(F.col("tokens")).alias("total_tokens"))


_STREAM = _stream_sql()
_FIRES = """
al AS (SELECT DISTINCT logical_key, ts FROM edges),
nx AS (SELECT a.logical_key, a.ts, min(b.ts) AS nxt FROM al a LEFT JOIN al b ON a.logical_key = b.logical_key AND b.ts >= a.ts + INTERVAL 120 SECOND GROUP BY 1, 2),
fired AS (
  SELECT logical_key, min(ts) AS ts FROM al GROUP BY 1
  UNION ALL SELECT f.logical_key, nx.nxt FROM fired f JOIN nx ON nx.logical_key = f.logical_key AND nx.ts = f.ts WHERE nx.nxt IS NOT NULL
)"""


@query(O.OBS, _STREAM, "SELECT machine, agent_id, status, last_activity FROM kept2")
def stream_registry(spark, sf):
    return registry_stream.sessions(spark, _registry_run(spark, sf)).select("machine", "agent_id", "status", "last_activity")


@query(O.OBS, _STREAM, 'SELECT batch_id, phase, key, "at", from_status, to_status FROM hist')
def stream_history(spark, sf):
    log = registry_stream.history(spark, _registry_run(spark, sf))
    return log.select(F.col("batch_id").cast("int").alias("batch_id"), "phase", "key", "at", "from_status", "to_status")


_TOLD = f"""
usd AS (SELECT *, used IS DISTINCT FROM lag(used) OVER (PARTITION BY machine ORDER BY event_id) AS moved
  FROM (SELECT event_id, 'm' || (user_id % 4) AS machine, event_id // 40 % 100 AS used FROM events)),
urow AS (SELECT list_filter(range({BATCHES}), lambda p: event_id <= top * (p + 1) // {BATCHES})[1] AS batch_id, event_id, machine, used FROM usd, edge WHERE moved)"""


@query(O.OBS, _STREAM, _TOLD, """
SELECT batch_id, phase, event, key, status FROM fd
UNION ALL SELECT CAST(batch_id AS INTEGER), 0, 'usage', machine, NULL FROM urow""")
def stream_feed(spark, sf):
    rows = registry_stream.read_feed(spark, _registry_run(spark, sf))
    return rows.select(F.col("batch_id").cast("int").alias("batch_id"), "phase", "event", "key", "status")


_TICK_HOURS = (0, 6, 13, 48, 100, 130)


@query(O.OBS, f"""
ticks AS (SELECT i, now + h * INTERVAL 1 HOUR AS t FROM nowt, (SELECT unnest(range({len(_TICK_HOURS)})) AS i, unnest([{", ".join(map(str, _TICK_HOURS))}]) AS h)),
life AS (SELECT machine || '/' || source || '/' || agent_id AS key, decays,
    (SELECT min(i) FROM ticks WHERE act IS NULL OR t - act >= INTERVAL 36 HOUR) AS s, (SELECT min(i) FROM ticks WHERE act IS NULL OR t - act >= INTERVAL 120 HOUR) AS r
  FROM aged)""", """
SELECT CAST(s AS INTEGER) AS batch_id, 'upsert' AS event, key, strftime(t, '%Y-%m-%dT%H:%M:%S.%gZ') AS at FROM life JOIN ticks ON i = s WHERE decays AND (r IS NULL OR s < r)
UNION ALL SELECT CAST(r AS INTEGER), 'removed', key, NULL FROM life WHERE r IS NOT NULL""")
def stream_sweep(spark, sf):
    """All observations in one step, then ticks only: sessions turn stale after 36 hours and leave after five days, each at its tick."""
    root, ticks, out = new_folder(spark, "snapshots"), new_folder(spark, "ticks"), new_folder(spark, "registry")
    obs = S.observations(spark, sf).withColumnRenamed("ts", "received_at").withColumnRenamed("arrival", "sent")
    obs.write.parquet(root)
    now = S.now_of(spark, sf)
    for some in (_TICK_HOURS[:1], _TICK_HOURS[1:]):
        for hours in some:
            spark.range(1).select((now + F.make_dt_interval(hours=F.lit(hours))).alias("now")).coalesce(1).write.mode("append").parquet(ticks)
        tick = spark.readStream.schema("now timestamp").option("maxFilesPerTrigger", 1).parquet(ticks)
        registry_stream.run_registry(
            spark.readStream.schema(obs.schema).parquet(root), out, ["sent"], clock=lambda b: b.agg(F.max("received_at").alias("now")), ticks=tick,
            stale=timedelta(hours=36), keep=timedelta(hours=120)).awaitTermination()
    swept = read_log(spark, f"{out}/feed", registry_stream.FEED).where(F.col("phase") == registry_stream.SWEPT)
    times = registry_stream.history(spark, out).select("batch_id", "key", "phase", "at")
    return swept.join(times, ["batch_id", "key", "phase"], "left").select(F.col("batch_id").cast("int").alias("batch_id"), "event", "key", "at")


@query(O.OBS, _STREAM, _TOLD, "SELECT machine, CAST(arg_max(used, event_id) AS DOUBLE) AS used FROM urow GROUP BY 1")
def stream_usage_panel(spark, sf):
    """Each machine's plan usage as a reader shows it who came after the first step: from the feed alone."""
    out = _registry_run(spark, sf)
    columns = ["batch_id", "phase", "arrival", "event", "key", "report"]
    rows = spark.read.parquet(f"{out}/opening").select(*columns).unionByName(registry_stream.read_feed(spark, out, after=0).select(*columns))
    return feed.newest_reports(rows, *registry.STREAM_ORDER).select("machine", F.col("codex.primary.used_percent").alias("used"))


@query(O.OBS, _STREAM, """
sh AS (SELECT logical_key, arg_max({'k': key, 'm': machine, 's': status, 'o': {'b': batch_id, 'p': phase, 'a': arrival}}, {'b': batch_id, 'p': phase, 'a': arrival}) AS w
  FROM fd WHERE event <> 'removed' GROUP BY 1)""", """
SELECT logical_key, w.k AS key, w.m AS machine, w.s AS status FROM sh
WHERE NOT EXISTS (SELECT 1 FROM fd WHERE event = 'removed' AND fd.key = sh.w.k AND {'b': batch_id, 'p': phase, 'a': arrival} > sh.w.o)""")
def stream_cards(spark, sf):
    """The cards kept by the registry steps: the fold of the whole feed."""
    return registry_stream.cards(spark, _registry_run(spark, sf)).select("logical_key", "key", "machine", "status")


_OUTAGE_STEPS, _OUTAGE = 5, (1, 2)


@query(f"""
edge AS (SELECT max(event_id) AS top FROM events),
step AS (SELECT *, list_filter(range({_OUTAGE_STEPS}), lambda p: event_id <= top * (p + 1) // {_OUTAGE_STEPS})[1] AS p FROM events, edge),
sent AS (SELECT CASE WHEN p IN {_OUTAGE} THEN {_OUTAGE[-1] + 1} ELSE p END AS batch_id, event_id, user_id, unnest(['session', 'usage']) AS kind FROM step)""", """
SELECT CAST(batch_id AS INTEGER) AS batch_id, kind, CASE kind WHEN 'session' THEN 's' || user_id ELSE 'm' || (user_id % 4) END AS key, CAST(max(event_id) AS VARCHAR) AS payload
FROM sent GROUP BY 1, 2, 3""")
def outage_buffer(spark, sf):
    """Every event as a session and as a usage payload, in five steps; the sink is down for two of them."""
    root, out = new_folder(spark, "payloads"), new_folder(spark, "delivery")
    events = S.events(spark, sf).select(
        "event_id", F.col("event_id").cast("string").alias("payload"),
        F.explode(F.create_map(
            F.lit("session"), F.concat(F.lit("s"), F.col("user_id").cast("string")),
            F.lit("usage"), F.concat(F.lit("m"), (F.col("user_id") % 4).cast("string")))).alias("kind", "key"))
    top = events.agg(F.max("event_id")).first()[0]

    def sink(rows: DataFrame, batch_id: int) -> None:
        if batch_id in _OUTAGE:
            raise outage.SinkDown
        append_log(f"{out}/sent")(rows, batch_id)

    for part in range(_OUTAGE_STEPS):
        low, high = top * part // _OUTAGE_STEPS if part else -1, top * (part + 1) // _OUTAGE_STEPS
        events.where((F.col("event_id") > low) & (F.col("event_id") <= high)).write.mode("append").parquet(root)
        outage.run_delivery(spark.readStream.schema(events.schema).parquet(root), out, ["event_id"], sink).awaitTermination()
    return read_log(spark, f"{out}/sent", outage.PAYLOAD).select(F.col("batch_id").cast("int").alias("batch_id"), "kind", "key", "payload")


@query(O.OBS, _STREAM, O.LOGICAL.replace("FROM cur", "FROM kept0").replace("INTERVAL 5 DAY", "INTERVAL 90 SECOND"), """
v AS (SELECT * FROM fd WHERE batch_id > 0 UNION ALL SELECT 0, 3, 0, 'full', machine || '/' || source || '/' || agent_id, logical_key, machine, status FROM logical),
sh AS (SELECT logical_key, arg_max({'k': key, 'm': machine, 's': status, 'o': {'b': batch_id, 'p': phase, 'a': arrival}}, {'b': batch_id, 'p': phase, 'a': arrival}) AS w
  FROM v WHERE event <> 'removed' GROUP BY 1)""", """
SELECT logical_key, w.k AS key, w.m AS machine, w.s AS status FROM sh
WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.event = 'removed' AND v.key = sh.w.k AND {'b': batch_id, 'p': phase, 'a': arrival} > sh.w.o)""")
def stream_card_view(spark, sf):
    out = _registry_run(spark, sf)
    first = spark.read.parquet(f"{out}/opening")  # a reader that came after the first batch
    columns = ["batch_id", "phase", "arrival", "event", "key", "logical_key", "machine", "status"]
    rows = first.select(*columns).unionByName(registry_stream.read_feed(spark, out, after=0).select(*columns))
    return feed.card_view(rows, *registry.STREAM_ORDER).select("logical_key", "key", "machine", "status")


@query(O.OBS, _STREAM, _FIRES, """
SELECT f.logical_key, epoch_us(f.ts) AS at_us, CASE WHEN e.source = 'codex' THEN 'Codex' ELSE 'Claude Code' END AS name,
  '[' || e.machine || '] ' || coalesce(e.needs_user_reason, 'waiting on your input') AS body
FROM fired f JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY logical_key, ts ORDER BY arrival DESC) AS last FROM edges) WHERE last = 1) e
  ON e.logical_key = f.logical_key AND e.ts = f.ts""")
def stream_alerts(spark, sf):
    log = read_log(spark, f"{_registry_run(spark, sf)}/alerts", registry_stream.ALERTS)
    return log.select("logical_key", us("fired_at").alias("at_us"), F.substring_index("title", " needs", 1).alias("name"), "body")
