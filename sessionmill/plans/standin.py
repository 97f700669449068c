"""Transcripts, hook lines and snapshot observations derived from the ``events`` table.

The driver tables hold no transcripts. Each event becomes one transcript line
(one file per user), so every operator runs on whole tables through the real
JSON text. ``oracle`` states the same mapping in SQL without any JSON.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionmill import contracts as C
from sessionmill.operators.records import parse_records
from sessionmill.plans.tables import materialize
from sessionmill.session import configure

# Lines per landed chunk of the derived transcripts.
CHUNK = 2048


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def latest_time(spark: SparkSession, sf_dir: str) -> datetime:
    """Evaluation instant of all queries: the newest event (one value)."""
    value = events(spark, sf_dir).agg(F.unix_micros(F.max("ts"))).first()[0]
    return datetime.fromtimestamp(value // 1_000_000, timezone.utc).replace(microsecond=value % 1_000_000)


def now_of(spark: SparkSession, sf_dir: str) -> Column:
    return F.lit(latest_time(spark, sf_dir))


_FIELDS = {
    "b": "user_id % 3 = 0",
    "stamp": """CASE WHEN event_id % 41 = 0 THEN ''
                     WHEN event_id % 43 = 0 THEN ',"timestamp":"2024-01-01"'
                     ELSE concat(',"timestamp":"', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), '"') END""",
    "dir": r"""CASE user_id % 4 WHEN 0 THEN concat('/mnt/c/Work/p', user_id % 10) WHEN 1 THEN concat('C:\\\\Work\\\\p', user_id % 10)
                    WHEN 2 THEN concat('/home/dev/p', user_id % 10) ELSE '' END""",
    "branch": "CASE WHEN event_id % 3 = 0 THEN '' ELSE concat('b', event_id % 3) END",
    "call": "concat('c', event_id % 7)",
    "model": """CASE user_id % 6 WHEN 0 THEN 'claude-fable-x' WHEN 1 THEN 'claude-3-opus' WHEN 2 THEN 'claude-opus-4'
                     WHEN 3 THEN 'claude-sonnet-4' WHEN 4 THEN 'Claude-Haiku-4' ELSE 'gpt-x' END""",
    "msg": """CASE WHEN event_id % 2 = 0 THEN concat(user_id, '-', CAST(CAST(ts AS DATE) AS STRING))
                   ELSE concat('x', CAST(floor(event_id / 4) AS BIGINT)) END""",
}

_USAGE = """concat('"usage":{"input_tokens":', CASE WHEN event_id % 31 = 0 THEN '"12"' ELSE CAST(CAST(round(value * 100) AS BIGINT) AS STRING) END,
    ',"output_tokens":', CASE WHEN event_id % 37 = 0 THEN -5 ELSE event_id % 500 END,
    ',"cache_read_input_tokens":', CASE WHEN event_id % 47 = 0 THEN '5.5' ELSE CAST(event_id % 9000 AS STRING) END,
    ',"cache_creation_input_tokens":', event_id % 70, ',"service_tier":"standard"}')"""

_A_BODY = f"""CASE event_type
  WHEN 'signup' THEN concat('"type":"user"', IF(event_id % 11 = 0, ',"isMeta":true', ''),
       ',"message":{{"role":"user","content":"please go on ', event_id, '"}}')
  WHEN 'click' THEN concat('"type":"assistant","message":{{"id":"', msg, '","model":"', model, '","stop_reason":"tool_use",', {_USAGE},
       ',"content":[{{"type":"thinking"}},{{"type":"tool_use","id":"', call, '"',
       CASE WHEN event_id % 23 = 0 THEN '' WHEN event_id % 5 = 0 THEN ',"name":"TodoWrite"' ELSE concat(',"name":"Tool', event_id % 4, '"') END,
       ',"input":{{"x":1', IF(event_id % 2 = 0, concat(',"description":"step ', event_id, '"'), ''),
       IF(event_id % 5 = 0 AND event_id % 23 <> 0, concat(',"todos":[{{"content":"old","status":"completed"}},{{"content":"do ', event_id, '","status":"',
           IF(event_id % 2 = 0, 'in_progress', 'pending'), '"', IF(event_id % 3 = 0, concat(',"activeForm":"doing ', event_id, '"'), ''), '}}]'), ''),
       '}}}}]}}')
  WHEN 'view' THEN concat('"type":"user","message":{{"role":"user","content":[{{"type":"tool_result","tool_use_id":"', call, '","content":',
       CASE WHEN event_id % 2 = 0 THEN concat('"', IF(event_id % 13 = 0, 'The user Rejected it', 'fine'), '"')
            ELSE concat('[{{"type":"text","text":"line one"}},{{"type":"image"}},{{"type":"text","text":"', IF(event_id % 13 = 0, 'REJECTED', 'two'), '"}}]') END,
       '}}]}}')
  WHEN 'purchase' THEN concat('"type":"assistant","message":{{"id":"', msg, '","model":"', model, '","stop_reason":',
       CASE WHEN event_id % 6 = 0 THEN '"max_tokens"' WHEN event_id % 6 = 1 THEN 'null' ELSE '"end_turn"' END, ',', {_USAGE},
       ',"content":[{{"type":"text","text":"ok"}}]}}')
  ELSE IF(event_id % 3 = 0,
       '"type":"user","message":{{"role":"user","content":[{{"type":"text","text":"[Request interrupted by user at step 3]"}}]}}',
       '"type":"system","level":"info"') END"""

_B_BODY = """CASE event_type
  WHEN 'signup' THEN IF(event_id % 2 = 0,
       concat('"type":"event_msg","payload":{"type":"task_started","model_context_window":', 200000 + event_id % 7, '}'),
       '"type":"event_msg","payload":{"type":"user_message","message":"hi"}')
  WHEN 'click' THEN concat('"type":"response_item","payload":{"type":"', IF(event_id % 2 = 0, 'custom_tool_call', 'function_call'),
       '","call_id":"', call, '"', IF(event_id % 23 = 0, '', concat(',"name":"shell', event_id % 4, '"')), '}')
  WHEN 'view' THEN concat('"type":"response_item","payload":{"type":"', IF(event_id % 2 = 0, 'custom_tool_call_output', 'function_call_output'),
       '","call_id":"', call, '","output":"x"}')
  WHEN 'purchase' THEN IF(event_id % 3 = 0, '"type":"event_msg","payload":{"type":"task_complete"}',
       concat('"type":"event_msg","payload":{"type":"token_count","info":', IF(event_id % 5 = 0, 'null', concat(
           '{"total_token_usage":{"input_tokens":', event_id * 7 % 100000, ',"cached_input_tokens":', event_id * 3 % 50000, ',"output_tokens":', event_id * 2 % 30000,
           '},"last_token_usage":{"total_tokens":', event_id % 300000, '},"model_context_window":', 190000 + event_id % 3, '}')),
           ',"rate_limits":', IF(event_id % 2 = 0, concat('{"primary":{"used_percent":', event_id % 101, '.5,"window_minutes":300,"resets_at":', 1700000000 + event_id,
           '},"secondary":', IF(event_id % 4 = 0, '{"window_minutes":10080}', concat('{"used_percent":', event_id % 11, '}')), ',"plan_type":"plus"}'), 'null'), '}'))
  ELSE CASE event_id % 4
       WHEN 0 THEN concat('"type":"session_meta","payload":{"id":"s', user_id, '","cwd":"', dir, '","originator":"cli","git":{"branch":"', branch, '"}}')
       WHEN 1 THEN concat('"type":"turn_context","payload":{"cwd":"', dir, '","model":"', model, '","approval_policy":"p', event_id % 3, '"}')
       WHEN 2 THEN '"type":"event_msg","payload":{"type":"turn_aborted"}'
       ELSE concat('"type":"response_item","payload":{"type":"message","role":"user","content":[{"type":"input_text","text":"',
            IF(event_id % 8 = 3, 'x <turn_aborted> y', 'hello'), '"}]}') END END"""


# Rows of the events that one task turns into lines and parses, some ten seconds of work.
TASK_ROWS = 50_000


def spread(df: DataFrame) -> DataFrame:
    """Test tables come as few splits, some of them empty: use all cores for the CPU-heavy derivation, and more tasks, not longer ones,
    for more rows. Results do not depend on it."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS)))


def transcript_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, source, seq, line, value): one JSON line per event, broken every 97th."""
    base = spread(events(spark, sf_dir))
    for name, text in _FIELDS.items():
        base = base.withColumn(name, F.expr(text))
    whole = F.when(F.col("b"), F.concat(F.lit("{"), F.expr(_B_BODY), F.col("stamp"), F.lit("}"))).otherwise(F.concat(
        F.lit("{"), F.expr(_A_BODY), F.col("stamp"),
        F.expr("""concat(',"sessionId":"s', user_id, '","cwd":"', dir, '","gitBranch":"', branch, '"', IF(event_id % 29 = 0, ',"isSidechain":true', ''))"""),
        F.lit("}")))
    broken = F.col("event_id") % 97 == 0
    return base.withColumn("w", whole).select(
        F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("file"),
        F.when(F.col("b"), C.SOURCE_B).otherwise(C.SOURCE_A).alias("source"),
        F.floor(F.col("event_id") / CHUNK).cast("bigint").alias("seq"),
        (F.col("event_id") % CHUNK).alias("line"),
        F.when(broken, F.expr("substr(w, 1, length(w) - 1)")).otherwise(F.col("w")).alias("value"),
    )


_TABLES: dict[tuple[str, str], DataFrame] = {}


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed record table, written once per application and table folder."""
    configure(spark)
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _TABLES:
        _TABLES[key] = materialize(parse_records(transcript_lines(spark, sf_dir)), "records")
    return _TABLES[key]


def hook_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hook log lines (value, received_at, ord) from the same events, a minute later."""
    value = F.expr("""CASE event_type
        WHEN 'error' THEN concat('{"session_id":"s', user_id, '","message":"Needs your PERMISSION to use ', event_id % 4, '","hook_event_name":"Notification"}')
        WHEN 'click' THEN concat('{"session_id":"s', user_id, '","hook_event_name":"PreToolUse"}')
        WHEN 'view' THEN concat('{"session_id":"s', user_id, '","message":"waiting for input","hook_event_name":"Notification"}')
        WHEN 'signup' THEN concat('{"message":"permission", "n":', event_id, '}')
        ELSE 'not json' END""")
    return spread(events(spark, sf_dir)).select(
        value.alias("value"), F.expr("ts + INTERVAL 1 MINUTE").alias("received_at"), F.col("event_id").alias("ord"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as one snapshot observation (registry input), arrival = event id."""
    e = events(spark, sf_dir)
    status = F.expr("""CASE event_type WHEN 'signup' THEN 'thinking' WHEN 'click' THEN 'tool_running'
        WHEN 'view' THEN 'idle' WHEN 'purchase' THEN 'done' ELSE 'needs_you' END""")
    project = F.expr(r"""CASE user_id % 4 WHEN 0 THEN concat('/mnt/c/Work/p', user_id % 10) WHEN 1 THEN concat('C:\\Work\\p', user_id % 10, '\\')
        WHEN 2 THEN concat('\\\\wsl$\\Ubuntu\\home\\dev\\p', user_id % 10) ELSE concat('/home/Dev/p', user_id % 10, '//') END""")
    day = F.date_trunc("day", "ts")
    needs = F.col("event_type") == "error"
    return e.select(
        F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("agent_id"),
        F.when(F.col("user_id") % 3 == 0, C.SOURCE_B).otherwise(C.SOURCE_A).alias("source"),
        F.when(F.col("event_id") % 2 == 0, "wsl").otherwise("windows").alias("machine"),
        project.alias("project"), status.alias("status"),
        F.when(F.col("user_id") % 5 != 0, F.concat(F.lit("b"), (F.col("user_id") % 3).cast("string"))).alias("git_branch"),
        F.when(F.col("event_type") == "click", "shell").alias("current_task"),
        needs.alias("needs_user"),
        F.when(needs & (F.col("event_id") % 2 == 0), C.INTERRUPTED_REASON).alias("needs_user_reason"),
        F.struct(
            (F.col("user_id") * 1000).alias("input_tokens"), F.col("user_id").alias("output_tokens"),
            F.lit(0).cast("bigint").alias("cache_read_tokens"), F.lit(0).cast("bigint").alias("cache_creation_tokens"),
            (F.col("user_id") % 100).cast("float").alias("context_pct")).alias("usage"),
        F.when(F.col("event_id") % 113 == 0, "garbage").otherwise(F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).alias("last_activity"),
        F.struct(F.lit("terminal").alias("type"), project.alias("target")).alias("jump"),
        F.col("event_id").alias("arrival"), "ts",
    )
