"""Transcript lines to the typed long record table, in one pass.

Each line is parsed once. Both dialects yield the same effect columns, so all
later operators are dialect-neutral:

* ``active_ts``    instant that moves the activity clock
* ``interrupted``  sets (true) or clears (false) the interrupted flag
* ``finished``     sets or clears the finished-turn flag
* ``clears``       drops all pending calls
* ``call_id`` with ``opens``  opens or closes one call
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionmill import contracts as C
from sessionmill.functions import variants as V
from sessionmill.functions.times import parse_rfc3339

# The members of a line, of a content block and of a dialect-B payload that are read; strings as ``binary``.
LINE = """type: binary, timestamp: binary, isSidechain: variant, isMeta: variant, sessionId: binary, cwd: binary, gitBranch: binary,
  message: struct<content: variant, stop_reason: binary, model: binary, id: binary, usage: variant>, payload: variant"""
BLOCK = "type: binary, id: binary, tool_use_id: binary, content: variant, text: binary, name: binary, input: struct<description: binary, todos: array<variant>>"
PAYLOAD = """type: binary, id: binary, cwd: binary, model: binary, approval_policy: binary, originator: binary, role: binary, call_id: binary, name: binary,
  git: struct<branch: binary, repository_url: binary>"""


def _string(member: str) -> Column:
    return F.col(member).cast("string")


def _stage_a() -> list[dict[str, Column]]:
    """Helper columns of dialect A, computed once per line."""
    dialect = ~F.col("__in_b")
    says = dialect & ~F.col("__side") & F.coalesce(F.col("__type") == "assistant", F.lit(False))
    asks = dialect & ~F.col("__side") & F.coalesce(F.col("__type") == "user", F.lit(False))
    content, usage = F.col("__m.message.content"), F.col("__m.message.usage")
    return [
        {"__side": F.coalesce(dialect & V.flag(F.col("__m.isSidechain"), "$"), F.lit(False)),
         "__meta": F.coalesce(dialect & V.flag(F.col("__m.isMeta"), "$"), F.lit(False))},
        {"__says": says, "__asks": asks},
        {"__blocks": F.when(F.col("__says") | F.col("__asks"), F.try_variant_get(content, "$", f"array<struct<{BLOCK}>>")),
         "__stop": F.when(F.col("__says"), _string("__m.message.stop_reason")),
         "__tokens": F.when(F.col("__says") & usage.isNotNull(), F.struct(
             V.unsigned_or_zero(usage, "$.input_tokens").alias("input_tokens"),
             V.unsigned_or_zero(usage, "$.output_tokens").alias("output_tokens"),
             V.unsigned_or_zero(usage, "$.cache_read_input_tokens").alias("cache_read_tokens"),
             V.unsigned_or_zero(usage, "$.cache_creation_input_tokens").alias("cache_creation_tokens"),
         )),
         "__session": V.nonempty(_string("__m.sessionId")), "__cwd": V.nonempty(_string("__m.cwd")), "__branch": V.nonempty(_string("__m.gitBranch")),
         "__model": F.when(F.col("__says"), _string("__m.message.model")), "__message": F.when(F.col("__says"), _string("__m.message.id"))},
        {"__fresh": F.col("__asks") & ~F.col("__meta") & ~F.coalesce(
            F.exists("__blocks", lambda b: b["type"].cast("string") == "tool_result"), F.lit(False)),
         "__whole": F.when(F.col("__asks") & F.col("__blocks").isNull(), V.text(content, "$"))},
    ]


def _record_a() -> dict[str, Column]:
    """Effects of a dialect-A record as a whole."""
    says, cleared, stop, tokens = (F.col(c) for c in ("__says", "__fresh", "__stop", "__tokens"))
    return dict(
        kind=F.lit("record"),
        active_ts=F.when(says | F.col("__asks"), F.col("__ts")),
        sidechain=F.col("__side"),
        session_id=F.col("__session"), cwd=F.col("__cwd"), git_branch=F.col("__branch"), model=F.col("__model"),
        message_id=F.when(tokens.isNotNull(), F.col("__message")), tokens=tokens,
        interrupted=F.when(says, F.lit(False)),
        finished=F.when(says & stop.isNotNull(), stop == C.END_TURN).when(cleared, F.lit(False)),
        stop=F.when(says & stop.isNotNull(), F.struct(stop.alias("reason")))
        .when(cleared, F.struct(F.lit(None).cast("string").alias("reason"))),
    )


def _call_a() -> dict[str, Column]:
    name = F.coalesce(_string("__block.name"), F.lit(C.DEFAULT_TOOL))
    todos = F.transform("__block.input.todos", lambda t: F.struct(
        F.coalesce(V.text(t, "$.content"), F.lit("")).alias("content"),
        F.coalesce(V.text(t, "$.status"), F.lit("")).alias("status"),
        V.text(t, "$.activeForm").alias("active_form"),
    ))
    call_id = F.col("__id")
    return dict(
        kind=F.lit("call"), call_id=call_id, opens=F.when(call_id.isNotNull(), F.lit(True)),
        call_name=name, call_label=_string("__block.input.description"),
        todos=F.when(name == C.TODO_TOOL, todos),
    )


def _result_a() -> dict[str, Column]:
    text, call_id = F.col("__text"), F.col("__id")
    return dict(
        kind=F.lit("result"), call_id=call_id, opens=F.when(call_id.isNotNull(), F.lit(False)),
        interrupted=F.when(F.lower(text).contains(C.REJECTED_WORD), F.lit(True)),
        result_text=text,
    )


def _text_a() -> dict[str, Column]:
    text = F.col("__text")
    marked = text.contains(C.INTERRUPT_MARKER)
    return dict(
        kind=F.lit("text"),
        interrupted=F.when(marked, F.lit(True)).when(~F.col("__meta") & (text != ""), F.lit(False)),
        clears=F.when(marked, F.lit(True)),
    )


def _limit_window(v: Column, path: str) -> Column:
    used = V.number(v, f"{path}.used_percent")
    return F.when(used.isNotNull(), F.struct(
        used.alias("used_percent"),
        V.unsigned(v, f"{path}.window_minutes").alias("window_minutes"),
        V.integer(v, f"{path}.resets_at").alias("resets_at"),
    ))


ENVELOPES = ("session_meta", "turn_context", "event_msg", "response_item")


def _stage_b(v: Column) -> list[dict[str, Column]]:
    """Helper columns of dialect B from its payload ``v``, computed once per line."""
    event, item = F.col("__event_msg"), F.col("__response_item")
    inner, counts = F.col("__inner"), F.col("__event_msg") & (F.col("__inner") == "token_count")
    return [
        {"__inner": _string("__p.type"), **{f"__{name}": F.col("__enveloped") & (F.col("__type") == name) for name in ENVELOPES}},
        {"__calls": F.coalesce(item & inner.isin("function_call", "custom_tool_call"), F.lit(False)),
         "__outputs": F.coalesce(item & inner.isin("function_call_output", "custom_tool_call_output"), F.lit(False)),
         "__aborted": F.coalesce(event & (inner == "turn_aborted"), F.lit(False)) | F.coalesce(F.when(
             item & (inner == "message"),
             (_string("__p.role") == "user") & V.flat_text(v, "$.content").contains(C.ABORT_MARKER)), F.lit(False)),
         "__counted": F.coalesce(F.when(counts, V.present_nonnull(v, "$.info")), F.lit(False)),
         "__limited": F.coalesce(F.when(counts, V.present_nonnull(v, "$.rate_limits")), F.lit(False))},
    ]


def _record_b(v: Column) -> dict[str, Column]:
    """Effects of a dialect-B envelope with payload ``v``; one row holds them all."""
    ts = F.col("__ts")
    inner = F.col("__inner")
    meta, context, event, item = (F.col(f"__{name}") for name in ENVELOPES)

    def says(*names: str) -> Column:
        return F.coalesce(event & inner.isin(*names), F.lit(False))

    calls, outputs, aborted, counted, limited = (F.col(c) for c in ("__calls", "__outputs", "__aborted", "__counted", "__limited"))
    started, completed, prompted = says("task_started"), says("task_complete"), says("user_message")
    total = "$.info.total_token_usage"
    call_id = F.when(calls | outputs, _string("__p.call_id"))

    return dict(
        kind=F.when(calls, "call").when(outputs, "result").otherwise("record"),
        active_ts=F.when(meta | context | event | item, ts),
        sidechain=F.lit(False),
        session_id=F.when(meta, _string("__p.id")),
        cwd=F.when(meta | context, _string("__p.cwd")),
        git_branch=F.when(meta, _string("__p.git.branch")),
        repository_url=F.when(meta, _string("__p.git.repository_url")),
        originator=F.when(meta, _string("__p.originator")),
        model=F.when(context, _string("__p.model")),
        approval_policy=F.when(context, _string("__p.approval_policy")),
        total=F.when(counted & V.present(v, total), F.struct(
            V.unsigned_or_zero(v, f"{total}.input_tokens").alias("input_tokens"),
            V.unsigned_or_zero(v, f"{total}.cached_input_tokens").alias("cached_input_tokens"),
            V.unsigned_or_zero(v, f"{total}.output_tokens").alias("output_tokens"),
        )),
        last_total_tokens=F.when(
            counted & V.present(v, "$.info.last_token_usage"),
            V.unsigned_or_zero(v, "$.info.last_token_usage.total_tokens")),
        context_window=F.when(started, V.unsigned(v, "$.model_context_window"))
        .when(counted, V.unsigned(v, "$.info.model_context_window")),
        rate_limits=F.when(limited, F.struct(
            _limit_window(v, "$.rate_limits.primary").alias("primary"),
            _limit_window(v, "$.rate_limits.secondary").alias("secondary"),
            V.text(v, "$.rate_limits.plan_type").alias("plan_type"),
            ts.alias("observed_at"),
        )),
        interrupted=F.when(aborted, F.lit(True)).when(started | prompted, F.lit(False)),
        finished=F.when(completed, F.lit(True)).when(started | prompted, F.lit(False)),
        clears=F.when(started | completed | aborted, F.lit(True)),
        call_id=call_id,
        opens=F.when(call_id.isNotNull(), calls),
        call_name=F.when(calls, F.coalesce(_string("__p.name"), F.lit(C.DEFAULT_TOOL))),
    )


def parse_records(lines: DataFrame) -> DataFrame:
    """(file, source, seq, line, value) to the record table. Works on streams too."""
    stages = lines.select("file", "source", "seq", "line", (F.col("source") == C.SOURCE_B).alias("__in_b"), F.try_parse_json("value").alias("v"))
    in_b, payload = F.col("__in_b"), F.col("__payload")
    stages = stages.withColumns({"__broken": F.col("v").isNull(), "__m": V.members(F.col("v"), LINE)}).drop("v")
    stages = stages.withColumns({
        "__stamp": _string("__m.timestamp"), "__type": _string("__m.type"), "__payload": F.when(in_b, F.col("__m.payload"))})
    stages = stages.withColumns({
        "__ts": parse_rfc3339(F.col("__stamp")), "__p": V.members(payload, PAYLOAD), "__enveloped": payload.isNotNull()})
    for columns in _stage_a():
        stages = stages.withColumns(columns)
    stages = stages.drop("__m", "__stamp")
    for columns in _stage_b(payload):
        stages = stages.withColumns(columns)
    # the record itself comes first, then its content blocks; plain text counts as one block
    nothing = F.array(F.lit(None).cast(f"struct<{BLOCK}>"))
    parts = F.when(F.col("__blocks").isNotNull(), F.concat(nothing, F.col("__blocks"))).when(
        F.col("__whole").isNotNull(), F.concat(nothing, nothing)).otherwise(nothing)
    rows = stages.select("*", F.posexplode(parts).alias("__at", "__block")).drop("__blocks")
    rows = rows.withColumn("__kind", F.when(
        F.col("__at") > 0, F.coalesce(_string("__block.type"), F.when(F.col("__whole").isNotNull(), "text"))))
    rows = rows.withColumns({
        "__head": F.col("__at") == 0,
        "__call": F.coalesce(F.col("__says") & (F.col("__kind") == "tool_use"), F.lit(False)),
        "__result": F.coalesce(F.col("__asks") & (F.col("__kind") == "tool_result"), F.lit(False)),
        "__said": F.coalesce(F.col("__asks") & (F.col("__kind") == "text"), F.lit(False)),
    })
    head, call, result, said = (F.col(f"__{c}") for c in ("head", "call", "result", "said"))
    staged = rows.where(head | call | result | said).withColumns({
        "__id": F.when(call, _string("__block.id")).when(result, _string("__block.tool_use_id")),
        "__text": F.when(result, V.flat_text(F.col("__block.content"), "$")).when(said, F.coalesce("__whole", _string("__block.text"), F.lit(""))),
    })
    variants = [
        (in_b, _record_b(payload)), (head, _record_a()), (call, _call_a()), (result, _result_a()), (said, _text_a()),
    ]
    fixed = {"pos": F.col("__at") - 1, "ts": F.col("__ts"), "parse_error": F.col("__broken")}
    broken = {"kind": F.lit("record"), "sidechain": F.lit(False)}

    def column(name: str) -> Column:
        out = F.when(F.col("__broken"), broken.get(name, F.lit(None)))
        for test, effects in variants:
            if name in effects:
                out = out.when(test, effects[name])
        return out

    return staged.select(
        "file", "source", "seq", "line",
        *[(fixed[n] if n in fixed else column(n)).cast(kind).alias(n) for n, kind in C.RECORD_FIELDS.items()],
    )


def write_records(records: DataFrame, path: str) -> None:
    """Persist the typed table once; later jobs prune columns instead of re-parsing."""
    records.write.mode("append").partitionBy("source").parquet(path)
