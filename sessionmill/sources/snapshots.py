"""Snapshot, usage-report and stats bodies, and the persisted session table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionmill import contracts as C
from sessionmill.functions import variants as V


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """Landed JSON bodies, one file per body: (body, arrival path)."""
    return (
        spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(path)
        .select(F.col("value").alias("body"), F.col("_metadata.file_path").alias("body_id"),
                F.col("_metadata.file_modification_time").alias("landed_at"))
    )


# One pass over the object; every field stays VARIANT so that its stored type can be checked.
_LOOSE = "struct<" + ",".join(
    [f"{f.name}:variant" for f in C.SNAPSHOT.fields if f.name not in ("usage", "jump")]
    + ["usage:struct<" + ",".join(f"{f.name}:variant" for f in C.USAGE.fields) + ">", "jump:struct<type:variant,target:variant>"]
) + ">"


def _loose(v: Column) -> Column:
    return F.try_variant_get(v, "$", _LOOSE)


def _kind(x: Column) -> Column:
    return F.schema_of_variant(x)


def _text(x: Column) -> Column:
    return F.when(_kind(x) == "STRING", F.try_variant_get(x, "$", "string"))


def _absent(x: Column) -> Column:
    return x.isNull() | F.is_variant_null(x)


def _snapshot_valid(s: Column, jump_given: Column) -> Column:
    """All required fields with their types; optional ones may be missing or null."""
    u, jump = s["usage"], s["jump"]
    pct = _kind(u["context_pct"])
    tests = [_kind(s[f]) == "STRING" for f in ("agent_id", "machine", "project", "last_activity")]
    tests += [
        _text(s["source"]).isin(C.SOURCES), _text(s["status"]).isin(C.STATUSES), _kind(s["needs_user"]) == "BOOLEAN",
        *[(_kind(u[f]) == "BIGINT") & (F.try_variant_get(u[f], "$", "bigint") >= 0) for f in C.TOKEN_FIELDS],
        _absent(u["context_pct"]) | (pct == "BIGINT") | (pct == "DOUBLE") | pct.startswith("DECIMAL"),
        *[_absent(s[f]) | (_kind(s[f]) == "STRING") for f in ("git_branch", "current_task", "needs_user_reason")],
        ~jump_given | (_text(jump["type"]).isin(C.JUMP_TYPES) & (_kind(jump["target"]) == "STRING")),
    ]
    ok = tests[0]
    for t in tests[1:]:
        ok = ok & t
    return F.coalesce(ok, F.lit(False))


def _jump_given(v: Column) -> Column:
    return F.coalesce(V.present_nonnull(v, "$.jump"), F.lit(False))


def _snapshot(s: Column) -> Column:
    u = s["usage"]
    usage = F.struct(
        *[F.try_variant_get(u[f], "$", "bigint").alias(f) for f in C.TOKEN_FIELDS],
        F.try_variant_get(u["context_pct"], "$", "float").alias("context_pct"))
    jump = F.when(s["jump"]["target"].isNotNull(), F.struct(
        F.try_variant_get(s["jump"]["type"], "$", "string").alias("type"),
        F.try_variant_get(s["jump"]["target"], "$", "string").alias("target")))
    fields = {f.name: F.try_variant_get(s[f.name], "$", f.dataType.simpleString())
              for f in C.SNAPSHOT.fields if f.name not in ("usage", "jump")}
    fields |= {"usage": usage, "jump": jump}
    return F.struct(*[fields[f.name].alias(f.name) for f in C.SNAPSHOT.fields])


def ingest_snapshots(bodies: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejected bodies).

    A body is one object or an array of them; one bad element rejects the
    whole body. Unknown fields are ignored. The verdict is taken inside the
    body's own row, so no grouping is needed.
    """
    staged = bodies.withColumn("__v", F.try_parse_json(F.col(body)))
    listed = F.coalesce(F.try_variant_get("__v", "$", "array<variant>"), F.when(F.col("__v").isNotNull(), F.array("__v")))
    judged = staged.withColumn(
        "__items", F.transform(listed, lambda v: F.struct(_loose(v).alias("s"), _jump_given(v).alias("jump_given")))
    )
    ok = F.coalesce(F.forall("__items", lambda i: _snapshot_valid(i["s"], i["jump_given"])), F.lit(False))
    rows = F.transform("__items", lambda i, at: _snapshot(i["s"]).withField("position", at))
    carried = [c for c in bodies.columns if c != body]
    # the verdict sits inside the generator: as a filter it would be pushed down and parse the body again
    accepted = judged.select(*carried, F.inline(F.when(ok, rows)))
    rejected = judged.select(F.inline(F.when(~ok, F.array(F.struct(*bodies.columns)))))
    return accepted, rejected


def parse_reports(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Usage-report bodies with the report schema; bad bodies are dropped."""
    parsed = F.from_json(F.col(body), C.USAGE_REPORT)
    return bodies.withColumn("__r", parsed).where(
        F.col("__r.machine").isNotNull() & F.col("__r.reported_at").isNotNull()).select(
        *[c for c in bodies.columns if c != body], "__r.*")


def parse_stats(bodies: DataFrame, body: str = "body") -> DataFrame:
    parsed = F.from_json(F.col(body), C.USAGE_STATS)
    return bodies.withColumn("__r", parsed).where(
        F.col("__r.machine").isNotNull() & F.col("__r.periods").isNotNull()).select(
        *[c for c in bodies.columns if c != body], "__r.*")


def to_stored(current: DataFrame, updated_at: Column) -> DataFrame:
    """Registry rows in the persisted layout: plain columns plus the snapshot as JSON."""
    from sessionmill.operators.registry import session_key

    return current.select(
        session_key().alias("key"), "machine", "source", "agent_id", "project", "status",
        "needs_user", "last_activity",
        F.to_json(F.struct(*[f.name for f in C.SNAPSHOT.fields]), {"ignoreNullFields": "false"}).alias("snapshot"),
        updated_at.alias("updated_at"))


def load_sessions(stored: DataFrame) -> DataFrame:
    """Warm start: snapshots of the persisted table; rows that no longer parse are skipped."""
    v = F.col("__v")
    parsed = stored.select(F.try_parse_json("snapshot").alias("__v")).select(_loose(v).alias("s"), _jump_given(v).alias("jump_given"))
    return parsed.where(_snapshot_valid(F.col("s"), F.col("jump_given"))).select(_snapshot(F.col("s")).alias("s")).select("s.*")
