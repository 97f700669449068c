"""DataFrame helpers of this folder: stored tables, streamed groups, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionmill.plans.tables import materialize as store

__all__ = ["components", "documents", "empty_text", "fresh_name", "keep_rows", "map_rows", "md5_of", "small_batches", "store", "streamed_groups"]


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def empty_text(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def small_batches(spark: SparkSession) -> None:
    """Rows reach Python in Arrow batches of bounded size: long texts would make the usual 10,000 rows large."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name the frame does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def map_rows(df: DataFrame, rows: Callable[[Iterator[dict]], Iterator[tuple]], schema: str, flush: int = 4 << 20) -> DataFrame:
    """Rows of a partition in, tuples out, by Arrow batches cut small enough for long texts.

    ``rows`` gets an iterator over the partition's rows as dicts and may keep state between them.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    small_batches(df.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def singles(batches):
        for batch in batches:
            step = max(1, min(batch.num_rows, batch.num_rows * flush // max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                yield from batch.slice(at, step).to_pylist()

    def run(batches):
        held, size = [], 0
        for row in rows(singles(batches)):
            held.append(row)
            size += 64 + sum(len(x) * (8 if isinstance(x, list) else 1) for x in row if hasattr(x, "__len__"))
            if size >= flush or len(held) >= 8192:
                yield _batch(held, arrow)
                held, size = [], 0
        if held:
            yield _batch(held, arrow)

    return df.mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def streamed_groups(rows: Iterator[dict], *keys: str) -> Iterator[list[dict]]:
    """Groups of neighbouring rows with equal keys, one group in memory at a time."""
    group, last = [], None
    for row in rows:
        key = tuple(row[k] for k in keys)
        if group and key != last:
            yield group
            group = []
        last = key
        group.append(row)
    if group:
        yield group


def md5_of(text: Column) -> Column:
    return F.md5(F.encode(text, "UTF-8"))


def keep_rows(docs: DataFrame, kept: DataFrame, digest: Callable[[Column], Column] = md5_of) -> DataFrame:
    """The rows of ``docs`` whose (doc_id, digest of the text) is in ``kept`` (doc_id, digest).

    Of repeated rows, equal in both, one stays. All columns stay as they are; null ids match null ids.
    """
    mark, n = fresh_name(docs, "digest_"), fresh_name(docs, "copy_")
    kept = kept.select(F.col("doc_id").alias("kept_id"), F.col("digest").alias("kept_digest")).distinct()
    marked = docs.withColumn(mark, digest(empty_text()))
    found = marked.join(kept, marked["doc_id"].eqNullSafe(F.col("kept_id")) & (F.col(mark) == F.col("kept_digest")), "left_semi")
    same = Window.partitionBy("doc_id", mark).orderBy(F.lit(0))
    return found.withColumn(n, F.row_number().over(same)).where(F.col(n) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an edge table (a, b): (node, root) for every node with an edge.

    Each round, every node joins the neighbour of least random rank (itself included) and the edges are
    rewritten between these representatives, so the graph shrinks by a constant factor and no list of
    neighbours or members is ever gathered: a hub only costs partial minima. All intermediate tables
    are written to the shared folder.
    """
    edges = store(edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    levels: list[DataFrame] = []
    while edges.limit(1).count():
        rank = lambda c, r=len(levels): F.struct(F.xxhash64(F.lit(r), F.col(c)), F.col(c).alias("id"))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy(F.col("a").alias("node")).agg(F.min(rank("b")).alias("near"))
        levels.append(store(near.select("node", F.least(rank("node"), "near")["id"].alias("root")), "roots"))
        at = lambda c: levels[-1].select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
        moved = edges.join(at("a"), "a").join(at("b"), "b").where("ra <> rb")
        edges = store(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    if not levels:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    climb = lambda top, low: low.join(top.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return reduce(lambda top, low: store(climb(top, low), "roots"), reversed(levels[:-1]), levels[-1])
