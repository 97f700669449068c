"""Row contracts and fixed vocabulary shared by all operators."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import types as T

# --- fixed values: vocabulary of the data, must be matched exactly ----------
SOURCE_A = "claude-code"
SOURCE_B = "codex"
SOURCES = ["claude-code", "codex", "gemini", "vps", "script", "cron"]
STATUSES = ["thinking", "tool_running", "needs_you", "done", "failed", "idle", "stale"]
JUMP_TYPES = ["vs_code", "terminal", "url", "ssh"]

INTERRUPT_MARKER = "[Request interrupted by user"
ABORT_MARKER = "<turn_aborted>"
REJECTED_WORD = "rejected"
PERMISSION_WORD = "permission"
RESOLVING_HOOK = "PreToolUse"
TODO_TOOL = "TodoWrite"
DEFAULT_TOOL = "tool"
END_TURN = "end_turn"
WAITING_REASON = "waiting for you"
INTERRUPTED_REASON = "interrupted by user"
UNKNOWN_AGENT = "unknown"
SUBAGENT_DIR = "subagents"

IDLE_SILENCE = timedelta(seconds=10)
STALE_SILENCE = timedelta(minutes=30)
RETENTION = timedelta(hours=24)
BLOCK_HOURS = 5
WEEK = timedelta(days=7)
OVERLAP_WINDOW = timedelta(seconds=90)
ALERT_COOLDOWN = timedelta(seconds=120)
PROMPT_TTL = timedelta(seconds=300)
EXACT_FRESH = timedelta(minutes=15)
REPORT_FRESH = timedelta(minutes=3)
CONTEXT_WINDOW_TOKENS = 200_000
# ---------------------------------------------------------------------------

TOKEN_FIELDS = ["input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens"]


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


STR, LONG, DOUBLE, BOOL, TIME = (
    T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType(),
)

TOKENS = _struct(**{f: LONG for f in TOKEN_FIELDS})
TODO = _struct(content=STR, status=STR, active_form=STR)
JUMP = _struct(type=STR, target=STR)
USAGE = _struct(**{f: LONG for f in TOKEN_FIELDS}, context_pct=T.FloatType())

# One normalized observation of a session.
SNAPSHOT = _struct(
    agent_id=STR, source=STR, machine=STR, project=STR, status=STR, git_branch=STR,
    current_task=STR, needs_user=BOOL, needs_user_reason=STR, usage=USAGE,
    last_activity=STR, jump=JUMP,
)

LIMIT_WINDOW = _struct(used_percent=DOUBLE, window_minutes=LONG, resets_at=LONG)
RATE_LIMITS = _struct(primary=LIMIT_WINDOW, secondary=LIMIT_WINDOW, plan_type=STR, observed_at=TIME)

PLAN_WINDOW = _struct(used_percent=DOUBLE, resets_at=TIME)
PLAN_WINDOWS = _struct(
    five_hour=PLAN_WINDOW, seven_day=PLAN_WINDOW, seven_day_opus=PLAN_WINDOW,
    seven_day_sonnet=PLAN_WINDOW, observed_at=TIME,
)
WINDOW_USAGE = _struct(tokens=TOKENS, messages=LONG)
PLAN_ESTIMATE = _struct(
    five_hour=WINDOW_USAGE, five_hour_resets_at=TIME, weekly=WINDOW_USAGE, confidence=STR,
)
USAGE_REPORT = _struct(
    machine=STR, claude=PLAN_ESTIMATE, claude_exact=PLAN_WINDOWS, codex=RATE_LIMITS, reported_at=STR,
)
PERIOD_TOTALS = _struct(
    sessions=LONG, messages=LONG, **{f: LONG for f in TOKEN_FIELDS}, est_cost_usd=DOUBLE,
)
USAGE_STATS = _struct(
    machine=STR,
    periods=T.ArrayType(_struct(key=STR, claude=PERIOD_TOTALS, codex=PERIOD_TOTALS)),
    computed_at=STR,
)

# A raw transcript line with its place in the file.
LINES = _struct(file=STR, source=STR, seq=LONG, line=LONG, value=STR)

# Long record table: one ``record`` row per line (pos = -1) and one row per
# content block that has an effect (pos = block position).
RECORD_FIELDS: dict[str, T.DataType] = dict(
    kind=STR, pos=T.IntegerType(), ts=TIME, active_ts=TIME,
    parse_error=BOOL, sidechain=BOOL,
    session_id=STR, cwd=STR, git_branch=STR, repository_url=STR, originator=STR,
    model=STR, approval_policy=STR,
    message_id=STR, tokens=TOKENS,
    total=_struct(input_tokens=LONG, cached_input_tokens=LONG, output_tokens=LONG),
    last_total_tokens=LONG, context_window=LONG, rate_limits=RATE_LIMITS,
    interrupted=BOOL, finished=BOOL, stop=_struct(reason=STR), clears=BOOL,
    call_id=STR, opens=BOOL, call_name=STR, call_label=STR,
    todos=T.ArrayType(TODO), result_text=STR,
)
RECORDS = T.StructType(
    [T.StructField("file", STR), T.StructField("source", STR),
     T.StructField("seq", LONG), T.StructField("line", LONG)]
    + [T.StructField(n, t) for n, t in RECORD_FIELDS.items()]
)
