from pyspark.sql import functions as F

from sessionmill.functions.times import parse_rfc3339
from sessionmill.operators import facts as FA
from sessionmill.operators import usage as U
from sessionmill.operators.records import parse_records

T0 = "2026-03-01T10:00:%02dZ"


def said(sec, *blocks, **message):
    return {"type": "assistant", "timestamp": T0 % sec, "message": {"content": list(blocks), **message}}


def asked(sec, content, **extra):
    return {"type": "user", "timestamp": T0 % sec, "message": {"content": content}, **extra}


def use(call, name="Bash", **inputs):
    return {"type": "tool_use", "id": call, "name": name, "input": inputs}


def result(call, content="ok"):
    return {"type": "tool_result", "tool_use_id": call, "content": content}


def final(records, at="2026-03-01T10:00:59Z"):
    f = FA.with_pending(FA.session_facts(records), FA.call_states(FA.with_call_starts(records)))
    rows = f.withColumn("state", FA.state_at(F.lit(at).cast("timestamp"))).collect()
    return {r.file: r for r in rows}


def test_states_of_dialect_a(lines):
    got = final(parse_records(lines({
        "running": [asked(1, "go"), said(2, use("a", description="build"))],
        "answered": [said(2, use("a")), asked(3, [result("a")])],
        "rejected": [said(2, use("a")), asked(3, [result("a", [{"type": "text", "text": "User REJECTED"}])])],
        "marker": [said(2, use("a")), asked(3, [{"type": "text", "text": "[Request interrupted by user]"}])],
        "resumed": [asked(1, "[Request interrupted by user]"), asked(2, "again")],
        "meta": [asked(1, "[Request interrupted by user]"), asked(2, "note", isMeta=True)],
        "done": [said(2, {"type": "text", "text": "x"}, stop_reason="end_turn")],
        "prompted": [said(2, stop_reason="end_turn"), asked(3, "more")],
        "side": [asked(1, "go"), {**said(2, use("a")), "isSidechain": True}],
        "fresh": [asked(55, "go")],
        "garbage": [asked(55, "go"), "{oops", "", "5"],
        "reopened": [said(1, use("a")), asked(2, [result("a")]), said(3, use("a"))],
        "undated": [said(1, use("a", "First")), {"type": "assistant", "message": {"content": [use("b", "Second")]}}],
    })))
    assert {k: v.state for k, v in got.items()} == {
        "running": "tool_running", "answered": "idle", "rejected": "interrupted", "marker": "interrupted",
        "resumed": "idle", "meta": "interrupted", "done": "done", "prompted": "idle", "side": "idle",
        "fresh": "thinking", "garbage": "thinking", "reopened": "tool_running", "undated": "tool_running",
    }
    assert got["running"].current_task == "Bash: build"
    assert got["marker"].pending == 0
    assert got["side"].sidechain_records == 1
    assert got["garbage"].parse_errors == 2
    assert got["undated"].current_task == "Second"


def test_states_of_dialect_b(lines):
    def ev(sec, **payload):
        return {"timestamp": T0 % sec, "type": "event_msg", "payload": payload}

    def item(sec, **payload):
        return {"timestamp": T0 % sec, "type": "response_item", "payload": payload}

    call = item(2, type="function_call", call_id="c", name="shell")
    got = final(parse_records(lines({
        "running": [ev(1, type="task_started"), call],
        "output": [call, item(3, type="function_call_output", call_id="c")],
        "complete": [call, ev(3, type="task_complete")],
        "aborted": [call, ev(3, type="turn_aborted")],
        "marker": [item(3, type="message", role="user", content=[{"text": "a <turn_aborted> b"}])],
        "other": [item(3, type="message", role="assistant", content=[{"text": "<turn_aborted>"}])],
        "again": [ev(1, type="turn_aborted"), ev(2, type="user_message")],
        "nopayload": [{"timestamp": T0 % 3, "type": "event_msg"}],
    }, source="codex")))
    assert {k: v.state for k, v in got.items()} == {
        "running": "tool_running", "output": "idle", "complete": "done", "aborted": "interrupted",
        "marker": "interrupted", "other": "idle", "again": "idle", "nopayload": "idle",
    }
    assert got["nopayload"].last_activity is None
    assert got["running"].current_task == "shell"


def test_usage_is_last_write_per_message(lines):
    def u(i, o, mid="m", **more):
        return said(1, id=mid, usage={"input_tokens": i, "output_tokens": o}, **more)

    r = parse_records(lines({
        "f": [u(1, 1), u(5, 7), u(2, 3, "n"), said(2, usage={"input_tokens": 400000})],
        "types": [said(1, id="x", usage={"input_tokens": "5", "output_tokens": 5.0, "cache_read_input_tokens": -1,
                                          "cache_creation_input_tokens": True}),
                  '{"type":"assistant","message":{"id":"y","usage":{"input_tokens":1,"input_tokens":9}}}'],
    }))
    usage = {x.file: x.usage for x in FA.session_usage(FA.session_facts(r), U.message_usage(r)).collect()}
    assert tuple(usage["f"])[:4] == (7, 10, 0, 0)
    assert usage["f"].context_pct == 100.0
    assert tuple(usage["types"])[:4] == (9, 0, 0, 0)


def test_deltas_restart_and_skip(lines):
    def count(sec, i, c, o):
        ts = {} if sec is None else {"timestamp": T0 % sec}
        return {**ts, "type": "event_msg", "payload": {"type": "token_count", "info": {
            "total_token_usage": {"input_tokens": i, "cached_input_tokens": c, "output_tokens": o}}}}

    r = parse_records(lines({"f": [
        count(1, 100, 40, 10), count(2, 100, 40, 10), count(None, 900, 0, 900), count(3, 150, 30, 12), count(4, 20, 5, 1),
    ]}, source="codex", per_chunk=2))
    got = [tuple(x.tokens) for x in U.usage_deltas(r).orderBy("ts").collect()]
    assert got == [(60, 10, 40, 0), (50, 2, 0, 0), (15, 1, 5, 0)]


def test_rfc3339_is_strict(spark):
    values = ["2026-07-10T09:00:00Z", "2026-07-10T09:00:00.5+02:00", "2026-07-10", "2026", "2026-07-10T09:00:00", "x", None,
              "2026-13-10T09:00:00Z"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in df.select(F.unix_millis(parse_rfc3339(F.col("v")))).collect()]
    assert got == [1783674000000, 1783666800500] + [None] * 6


def test_shuffled_rows_give_the_same_facts(lines):
    files = {"f": [said(i % 60, use(f"c{i % 5}"), id=f"m{i % 7}", usage={"input_tokens": i}) if i % 3 else
                   asked(i % 60, [result(f"c{i % 4}")]) for i in range(200)]}
    one = parse_records(lines(files, per_chunk=30))
    two = one.repartition(7, F.rand(3))
    a, b = (FA.with_pending(FA.session_facts(r), FA.call_states(FA.with_call_starts(r))).collect() for r in (one, two))
    assert a == b


def test_a_line_is_walked_once(spark, lines):
    """Every member was looked up on its own, strings twice: over a hundred walks in the plan of the parser."""
    plan = parse_records(lines({"f": ["{}"]}))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("try_variant_get(v#") == 1


def test_odd_types_of_every_member(lines):
    """Members of other types than a record may have count as missing, each on its own."""
    odd = [5, 5.5, True, None, "", "x", [], ["x", {"type": 5}], {}, {"content": 5, "usage": 5, "type": [], "info": 1, "git": "b"}]
    a = [{"type": kind, "timestamp": T0 % 1, "sessionId": v, "cwd": v, "gitBranch": v, "isSidechain": "true", "isMeta": v,
          "message": {"content": w, "stop_reason": v, "model": v, "id": v, "usage": w}} for kind in ("user", "assistant") for v in odd for w in odd]
    a += [{"type": "assistant", "message": {"content": [None, 1, use(v), {**use("c"), "name": v, "input": v}], "usage": {"input_tokens": v}}} for v in odd]
    a += [{"type": v, "message": v, "payload": v} for v in odd]
    b = [{"type": kind, "payload": v} for kind in ("event_msg", "session_meta") for v in odd]
    b += [{"type": "event_msg", "payload": {"type": "token_count", "info": v, "rate_limits": v}} for v in odd]
    rows = parse_records(lines({"a": a}).unionByName(lines({"b": b}, source="codex"))).where("pos < 0").collect()
    assert len(rows) == len(a) + len(b)
    assert {r.session_id for r in rows} == {None, "x"} == {r.cwd for r in rows} == {r.git_branch for r in rows}
    assert {r.model for r in rows} == {None, "", "x"} and not any(r.sidechain or r.parse_error for r in rows)
    # a usage of any type counts, what is no whole number in it is zero
    assert {r.tokens and r.tokens.input_tokens for r in rows} == {None, 0, 5}
    assert {r.stop.reason for r in rows if r.stop} == {None, "", "x"}


def test_scalars_are_no_sessions(lines):
    rows = parse_records(lines({"f": ["5", "null", '"x"', "[]", "{}", "{oops"]})).collect()
    assert [r.parse_error for r in sorted(rows, key=lambda r: r.line)] == [False] * 5 + [True]
    assert {(r.kind, r.sidechain, r.session_id, r.active_ts) for r in rows} == {("record", False, None, None)}
