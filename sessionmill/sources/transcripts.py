"""Transcript and hook-log sources (batch and streaming)."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from sessionmill.contracts import RETENTION, SOURCE_A, SOURCE_B, SUBAGENT_DIR
from sessionmill.functions import variants as V


def existing_roots(spark: SparkSession, roots: Iterable[tuple[str, str]]) -> list[tuple[str, str]]:
    """Drop roots that do not exist; a missing root is not an error."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    kept = []
    for root, source in roots:
        path = jvm.org.apache.hadoop.fs.Path(root)
        if path.getFileSystem(conf).exists(path):
            kept.append((root, source))
    return kept


def _outer_roots(roots: list[tuple[str, str]]) -> list[str]:
    """Roots to scan; one inside another is covered by the outer scan."""
    paths = {r.rstrip("/") for r, _ in roots}
    return sorted(p for p in paths if not any(p != q and p.startswith(q + "/") for q in paths))


def tag_source(files: DataFrame, roots: Iterable[tuple[str, str]], path: str = "path") -> DataFrame:
    """Add ``source`` from the deepest root that contains the file; others are dropped.

    Roots are compared by whole path components: one equi-join for each depth at which roots lie, deepest first wins.
    Works on streams and for any number of roots.
    """
    by_depth: dict[int, dict[str, str]] = {}
    for root, source in roots:
        plain = root.rstrip("/")
        by_depth.setdefault(plain.count("/"), {})[plain] = source
    parts, found = F.split(path, "/"), []
    out = files
    for depth, known in sorted(by_depth.items(), reverse=True):
        at, name = f"__root{depth}", f"__source{depth}"
        table = files.sparkSession.createDataFrame(list(known.items()), f"{at} string, {name} string")
        # a file lies below its folder, so the folder's own path is shorter than the file's
        folder = F.when(F.size(parts) > depth + 1, F.array_join(F.slice(parts, 1, depth + 1), "/"))
        out = out.withColumn("__folder", folder).join(table, F.col("__folder") == F.col(at), "left").drop("__folder", at)
        found.append(F.col(name))
    if not found:
        return files.withColumn("source", F.lit(None).cast("string")).where(F.lit(False))
    tagged = out.withColumn("source", F.coalesce(*found)).where(F.col("source").isNotNull())
    return tagged.select(*[c for c in files.columns if c != "source"], "source")


def is_subagent(path: Column) -> Column:
    """The directory directly above the file is the sub-agent directory."""
    parts = F.split(path, "/")
    return F.coalesce(F.try_element_at(parts, F.lit(-2)) == SUBAGENT_DIR, F.lit(False))


def complete_lines(chunks: DataFrame, value: str = "value") -> DataFrame:
    """Split whole chunks into complete lines: ``line`` number and text.

    What follows the last newline is not complete and is left out, one trailing
    carriage return is stripped, empty lines are skipped.
    """
    pieces = F.split(F.col(value), "\n", -1)
    return _as_lines(chunks.select("*", F.posexplode(F.slice(pieces, F.lit(1), F.size(pieces) - 1)).alias("line", "__text")), value)


def _as_lines(rows: DataFrame, value: str) -> DataFrame:
    return (
        rows.where(F.col("__text") != "")
        .withColumn("line", F.col("line").cast("bigint"))
        .withColumn(value, F.regexp_replace("__text", "\r$", ""))
        .drop("__text")
    )


def carried_lines(chunks: DataFrame, keys: list[str], order: str, value: str = "value") -> DataFrame:
    """Complete lines of chunks that follow each other under ``keys``: a line may go on in the next chunk.

    The text behind a chunk's last newline is put in front of the next chunk, whose line 0 it completes; a chunk
    without any newline goes on as a whole. Only the text behind the last newline of the newest chunk is withheld:
    its writer may still add to it. Lines inside a chunk stay where they are; only the pieces at its edges are shuffled.
    """
    kept = [c for c in chunks.columns if c != value]
    inner, edges = _inner_and_edges(chunks, kept, value)
    in_order = Window.partitionBy(*keys).orderBy(order)
    # tails since the last newline before this chunk: those with the same number of cut chunks behind them
    seen = edges.withColumn("__group", F.sum(F.col("__cut").cast("int")).over(in_order))
    carry = seen.groupBy(*keys, (F.col("__group") + 1).alias("__group")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "__tail"))), lambda x: x["__tail"]), "").alias("__carry"))
    first = seen.where("__cut").join(carry, [*keys, "__group"], "left").select(
        *kept, F.lit(0).alias("line"), F.concat(F.coalesce("__carry", F.lit("")), "__head").alias("__text"))
    return _as_lines(inner.unionByName(first), value)


def _inner_and_edges(chunks: DataFrame, kept: list[str], value: str) -> tuple[DataFrame, DataFrame]:
    """Lines that begin and end in their chunk, and the text before the first and behind the last newline of each chunk."""
    pieces = F.split(F.col(value), "\n", -1)
    inner = chunks.withColumn("__pieces", pieces).where(F.size("__pieces") > 2)
    inner = inner.select(*kept, F.posexplode(F.slice("__pieces", 2, F.size("__pieces") - 2)).alias("line", "__text")).withColumn("line", F.col("line") + 1)
    edges = chunks.select(*kept, pieces.alias("__pieces")).select(
        *kept, (F.size("__pieces") > 1).alias("__cut"), F.element_at("__pieces", 1).alias("__head"), F.element_at("__pieces", -1).alias("__tail"))
    return inner, edges


class _Carry(StatefulProcessor):
    """Holds the text behind the last newline of each key until the line's end arrives."""

    def __init__(self, order: str, kept: list[str], ttl: timedelta):
        self.order, self.kept, self.ttl = order, kept, int(ttl.total_seconds() * 1000)

    def init(self, handle) -> None:
        self.pieces = handle.getListState("pieces", "text string", self.ttl)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        for row in sorted(rows, key=lambda r: r[self.order]):
            if row["__cut"]:
                carried = "".join(p[0] for p in self.pieces.get())
                self.pieces.clear()
                yield Row(**{c: row[c] for c in self.kept}, line=0, __text=carried + row["__head"])
            if row["__tail"]:
                self.pieces.appendValue((row["__tail"],))

    def close(self) -> None:
        pass


# What stateful processors need, and no batches without data: with a time to live they would never end.
CARRY_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def stream_carried_lines(chunks: DataFrame, keys: list[str], order: str, value: str = "value", ttl: timedelta = RETENTION) -> DataFrame:
    """:func:`carried_lines` of a stream: what follows a key's last newline is state between triggers.

    Only the pieces at the edges of chunks pass through the state; each line comes once, after a restart as well. Chunks of a key must
    land in order; one that lands behind a later one of an earlier trigger goes on from there. An unfinished line that
    nobody goes on with leaves the state after ``ttl`` by the wall clock. Sets ``CARRY_CONF``
    on the session.
    """
    for setting, setting_value in CARRY_CONF.items():
        chunks.sparkSession.conf.set(setting, setting_value)
    kept = [c for c in chunks.columns if c != value]
    inner, edges = _inner_and_edges(chunks, kept, value)
    out = T.StructType([*[f for f in chunks.schema.fields if f.name in kept], T.StructField("line", T.IntegerType()), T.StructField("__text", T.StringType())])
    first = edges.groupBy(*keys).transformWithState(_Carry(order, kept, ttl), out, "Append", "ProcessingTime")
    return _as_lines(inner.unionByName(first), value)


NAMES = "*.jsonl"
# Files of one task and session that Spark's writer may count.
PART_FILES = 1 << 12


def part_number(name: Column) -> Column:
    """Place of a file by the name that Spark's writer gave it, ``part-<task>-….c<file>.txt``; null for other names."""
    task, file = (F.regexp_extract(name, r"^part-(\d+)-.*\.c(\d+)\.txt$", i).try_cast("bigint") for i in (1, 2))
    return F.when(file < PART_FILES, task * PART_FILES + file)


def _plain_path(col: Column) -> Column:
    return F.regexp_replace(F.url_decode(F.regexp_replace(col, r"\+", "%2B")), r"^file:(//)?", "")


def _landed(raw: DataFrame, roots: list[tuple[str, str]]) -> DataFrame:
    """Chunks with file, source, seq and text: ``<session>/<seq>.jsonl``, ``<session>/part-…`` (:func:`part_number`), or any other
    file as a session of one chunk."""
    parts = F.split("path", "/")
    tagged = tag_source(raw.withColumn("path", _plain_path(F.col("path"))), roots)
    name = F.element_at(parts, -1)
    seq = F.coalesce(F.regexp_extract(name, r"^(\d+)\.jsonl$", 1).try_cast("bigint"), part_number(name))
    folder = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")
    named = tagged.withColumn("seq", seq).withColumn("file", F.when(F.col("seq").isNotNull(), folder).otherwise(F.col("path")))
    named = named.where(~is_subagent(F.col("file")) & ~is_subagent(F.col("path")))
    return named.select("file", "source", F.coalesce("seq", F.lit(0)).alias("seq"), "value")


def read_chunks(spark: SparkSession, roots: Iterable[tuple[str, str]], names: str = NAMES) -> DataFrame:
    """Landed transcripts: ``<root>/.../<session>/<seq>.jsonl``, immutable chunks, or ``<root>/.../<session>.jsonl``.

    Shippers keep chunks to tens of megabytes, so a chunk is read as one value and the line number inside it
    is exact. Chunks may be cut anywhere: see :func:`carried_lines`. With ``names`` as ``part-*`` chunks are read
    where Spark's writer left them, in the order of its tasks: ``<root>/.../<session>/part-…``.
    """
    roots = existing_roots(spark, roots)
    raw = (
        spark.read.format("text").option("wholetext", True)
        .option("recursiveFileLookup", True).option("pathGlobFilter", names)
        .load(_outer_roots(roots))
        .select("value", F.col("_metadata.file_path").alias("path"))
    ) if roots else spark.createDataFrame([], "value string, path string")
    return carried_lines(_landed(raw, roots), ["file", "source"], "seq").select("file", "source", "seq", "line", "value")


def _lasting(root: str) -> str:
    """A pattern that only the root matches: a stream may start before its root exists."""
    last = root[-1]
    return f"{root[:-1]}[{last}]" if last.isalnum() else root


def stream_chunks(spark: SparkSession, roots: Iterable[tuple[str, str]], max_files: int = 1000, ttl: timedelta = RETENTION) -> DataFrame:
    """:func:`read_chunks` as a stream: each line of landed chunks once, also those cut between chunks (:func:`stream_carried_lines`).

    Roots need not exist yet; their files count once they do.
    """
    roots = list(roots)
    if not roots:
        raise ValueError("no transcript root given")
    raw = None
    for root in _outer_roots(roots):
        part = (
            spark.readStream.format("text").schema("value string").option("wholetext", True)
            .option("recursiveFileLookup", True).option("pathGlobFilter", NAMES)
            .option("maxFilesPerTrigger", max_files)
            .load(_lasting(root))
            .select("value", F.col("_metadata.file_path").alias("path"))
        )
        raw = part if raw is None else raw.unionByName(part)
    return stream_carried_lines(_landed(raw, roots), ["file", "source"], "seq", ttl=ttl).select("file", "source", "seq", "line", "value")


def read_closed_files(spark: SparkSession, roots: Iterable[tuple[str, str]], names: str = NAMES) -> DataFrame:
    """Backfill of finished transcripts of any size, one file per session; ``names`` is the pattern of their names.

    Files are split by Spark; ``seq`` is the start of the split and ``line``
    grows inside it, so order is kept without reading a file in one piece.
    Finished files have no writer, so a last line without newline counts.
    """
    roots = existing_roots(spark, roots)
    raw = (
        spark.read.format("text").option("lineSep", "\n")
        .option("recursiveFileLookup", True).option("pathGlobFilter", names)
        .load(_outer_roots(roots)).where(F.col("value") != "")
        .select(
            F.regexp_replace("value", "\r$", "").alias("value"),
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("seq"),
            F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("line"),
        )
    ) if roots else spark.createDataFrame([], "value string, path string, seq long, line long")
    tagged = tag_source(raw.withColumn("path", _plain_path(F.col("path"))), roots)
    return (
        tagged.where(~is_subagent(F.col("path")))
        .select(F.col("path").alias("file"), "source", "seq", "line", "value")
    )


def sniff_source(lines: DataFrame) -> DataFrame:
    """Dialect of each file from its first line: (file, source).

    A first line with a non-null ``payload`` is the envelope dialect.
    """
    first = lines.groupBy("file").agg(F.min_by("value", F.struct("seq", "line")).alias("first"))
    v = F.try_parse_json(F.col("first"))
    return first.select(
        "file", F.when(V.present_nonnull(v, "$.payload"), F.lit(SOURCE_B)).otherwise(F.lit(SOURCE_A)).alias("source")
    )


HOOK_COLUMNS = "value string, received_at timestamp, ord bigint"


def hook_events(hooks: DataFrame, since: Column | None = None) -> DataFrame:
    """Hook log lines (value, received_at, ord) to (session_id, kind, message, …).

    A message that mentions a permission is a prompt; otherwise a tool-use hook
    is a resolution; everything else is dropped. ``since`` skips the backlog.
    """
    from sessionmill.contracts import PERMISSION_WORD, RESOLVING_HOOK

    members = V.members(F.try_parse_json(F.col("value")), "session_id: binary, message: binary, hook_event_name: binary")
    message = F.coalesce(F.col("m.message").cast("string"), F.lit(""))
    events = hooks if since is None else hooks.where(F.col("received_at") >= since)
    return (
        # the row below comes out of a generator, so the filter on it does not parse the line again
        events.select("received_at", "ord", F.explode(F.array(members)).alias("m")).select(
            F.col("m.session_id").cast("string").alias("session_id"),
            F.when(F.lower(message).contains(PERMISSION_WORD), F.lit("prompt"))
            .when(F.col("m.hook_event_name").cast("string") == RESOLVING_HOOK, F.lit("resolution")).alias("kind"),
            message.alias("message"), "received_at", "ord",
        )
        .where(F.col("session_id").isNotNull() & F.col("kind").isNotNull())
    )
