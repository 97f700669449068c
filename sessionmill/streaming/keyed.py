"""Tables by key for micro-batches: a step writes the rows that changed, not the table.

Rows lie in a fixed number of buckets by hash of their key. A step adds one folder with a part for each
bucket it touches; a bucket whose added rows have grown to a share of the whole, or that has many parts, is written anew
in the same step, folded to one row per key. A manifest names the parts of each bucket, so readers see whole steps
only, a reader of some buckets opens their parts alone, and a replayed step starts from the manifest before it.
The manifest also keeps the earliest instant at which a row of the bucket falls due (turns stale, expires), so that a
clock tick opens only the buckets in which something happens.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionmill.plans.tables import remove
from sessionmill.streaming.sinks import newest_version, read_note, write_note

BUCKETS = 16
MOST_PARTS = 8
FEW_ROWS = 1_000


@dataclass
class Bucket:
    """Parts by batch id, oldest first; rows of the last rewrite, rows added since; earliest due instant in microseconds."""

    parts: list[int] = field(default_factory=list)
    rows: int = 0
    added: int = 0
    due: int | None = None


def newest_rows(keys: list[str]) -> Callable[[DataFrame], DataFrame]:
    """Fold: the row of the newest step per key; ``gone`` ones leave."""
    def fold(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in (*keys, "batch_id", "bucket")]
        last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("w"))
        return last.where(~F.coalesce(F.col("w.gone"), F.lit(False))).select(*keys, *[F.col(f"w.{c}").alias(c) for c in rest])
    return fold


class KeyedTable:
    """Rows of ``schema`` by ``keys`` under ``path``.

    ``fold`` turns all rows of some keys (with ``batch_id``) into the current ones; by default the newest row counts and a column
    ``gone`` marks removals. ``buckets`` is chosen once for a table: a step's tasks, and the rows it looks through, follow from it. ``bucket_by`` (all keys by default) decides the bucket, ``due`` is an instant in microseconds or null.
    """

    def __init__(
        self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], bucket_by: list[str] | None = None,
        due: Column | None = None, fold: Callable[[DataFrame], DataFrame] | None = None, buckets: int = BUCKETS,
    ):
        gone = [] if fold else [T.StructField("gone", T.BooleanType())]
        self.spark, self.path, self.buckets = spark, path, buckets
        self.columns = schema.fieldNames()
        self.stored = T.StructType([*schema.fields, *gone])
        self.fold = fold or newest_rows(keys)
        self.bucket_by, self.due = bucket_by or keys, due
        self._known: dict[int, str] = {}  # manifests do not change once written

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.bucket_by), F.lit(self.buckets)).cast("int")

    def buckets_of(self, rows: DataFrame) -> set[int]:
        """Buckets of the keys in ``rows``: at most as many as the table has."""
        return {r[0] for r in rows.select(self.bucket()).distinct().collect()}

    def version(self, before: int = 1 << 62) -> int | None:
        return newest_version(self.spark, f"{self.path}/manifest", before)

    def manifest(self, before: int = 1 << 62) -> dict[int, Bucket]:
        version = self.version(before)
        if version is None:
            return {}
        if version not in self._known:
            self._known[version] = read_note(self.spark, f"{self.path}/manifest", version)
        return {int(b): Bucket(**x) for b, x in json.loads(self._known[version]).items()}

    def due_by(self, now: int, before: int = 1 << 62) -> set[int]:
        """Buckets in which something may fall due by ``now`` (microseconds)."""
        return {b for b, x in self.manifest(before).items() if x.due is not None and x.due <= now}

    def raw(self, before: int = 1 << 62, buckets: Iterable[int] | None = None) -> DataFrame:
        """Rows of all parts with ``batch_id`` and ``bucket``, not folded."""
        state = self.manifest(before)
        paths = [f"{self.path}/rows/batch_id={i}/bucket={b}" for b in (state if buckets is None else buckets) for i in state.get(b, Bucket()).parts]
        full = T.StructType([*self.stored.fields, T.StructField("batch_id", T.LongType()), T.StructField("bucket", T.IntegerType())])
        if not paths:
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).option("basePath", f"{self.path}/rows").parquet(*paths)

    def read(self, before: int = 1 << 62, buckets: Iterable[int] | None = None) -> DataFrame:
        """Current rows as of the newest step below ``before``."""
        return self.fold(self.raw(before, buckets)).select(*self.columns)

    def full_buckets(self, before: int) -> set[int]:
        """Buckets that the step ``before`` should write anew."""
        return {b for b, x in self.manifest(before).items() if x.added > max(FEW_ROWS, x.rows // 2) or len(x.parts) >= MOST_PARTS}

    def write(
        self, changed: DataFrame, batch_id: int, rewrite: Iterable[int] | None = None,
        alive: Callable[[DataFrame], DataFrame] | None = None, due: dict[int, int | None] | None = None,
    ) -> None:
        """Add the rows of step ``batch_id``; a repeated step replaces itself.

        ``rewrite``: buckets to write anew (by default the full ones), where only what ``alive`` lets through stays. ``due``: exact due instants
        of buckets whose rows the caller has looked at.
        """
        state, folder = self.manifest(batch_id), f"{self.path}/rows/batch_id={batch_id}"
        anew = sorted(self.full_buckets(batch_id) if rewrite is None else rewrite)
        columns = self.stored.fieldNames()
        changed = changed.select(*columns).withColumn("bucket", self.bucket())
        in_anew = F.col("bucket").isin(anew) if anew else F.lit(False)
        rows = changed
        if anew:
            both = self.raw(batch_id, anew).unionByName(changed.where(in_anew).withColumn("batch_id", F.lit(batch_id).cast("long")))
            whole = self.fold(both)
            if alive is not None:
                whole = alive(whole)
            whole = whole.withColumn("gone", F.lit(False)) if "gone" in columns else whole
            rows = changed.where(~in_anew).unionByName(whole.select(*columns).withColumn("bucket", self.bucket()))
        rows.repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(folder)

        full = T.StructType([*self.stored.fields, T.StructField("bucket", T.IntegerType())])
        written = self.spark.read.schema(full).parquet(folder).groupBy("bucket").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.lit(None).cast("long") if self.due is None else self.due).alias("due"))
        fresh = {r["bucket"]: (r["n"], r["due"]) for r in written.collect()}
        for b in anew:
            n, at = fresh.pop(b, (0, None))
            state[b] = Bucket([batch_id] if n else [], n, 0, at)
        for b, (n, at) in fresh.items():
            old = state.setdefault(b, Bucket())
            old.parts.append(batch_id)
            old.added += n
            old.due = min((x for x in (old.due, at) if x is not None), default=None)
        for b, at in (due or {}).items():
            if b in state and b not in anew:
                state[b].due = at
        self._known[batch_id] = json.dumps({b: asdict(x) for b, x in sorted(state.items()) if x.parts})
        write_note(self.spark, f"{self.path}/manifest", batch_id, self._known[batch_id])
        self._drop_unused(batch_id)

    def _drop_unused(self, batch_id: int) -> None:
        """Parts that only manifests older than the last two name; no replay can ask for them."""
        kept = [v for v in (self.version(batch_id + 1), self.version(batch_id)) if v is not None]
        older = self.version(min(kept))
        if older is None:
            return
        named = {(b, i) for v in kept for b, x in self.manifest(v + 1).items() for i in x.parts}
        for b, x in self.manifest(older + 1).items():
            for i in x.parts:
                if (b, i) not in named:
                    remove(self.spark, f"{self.path}/rows/batch_id={i}/bucket={b}")
        remove(self.spark, f"{self.path}/manifest/batch_id={older}")
