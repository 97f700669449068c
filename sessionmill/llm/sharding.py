"""Sharding by sampled splitters, for shards of near-equal bytes, in DataFrame operations only.

1. Every row gets a size (bytes of its text plus 1) and a key (hash of its text, so equal texts are neighbours).
2. A sample of keys, drawn with probability in proportion to size, gives quantile boundaries; rows are
   partitioned into these key ranges.
3. Keys are measured. One too heavy for its range (a text with many copies, or a huge one) is cut out of it; its
   rows are subdivided into cells by a hash of the row.
4. Heavy cells go to the shards first, each key whole into the emptiest shard if it fits there; the key ranges then fill
   what is left of each shard in key order, each light key whole.
5. Places in a shard are counted per cell and added up, so no task ever sees a whole shard.

What reaches the driver is bounded by parameters: ``RANGES`` or so boundaries, and fewer than about 4 *
``FINE`` * shards heavy cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionmill.llm.frames import empty_text, store

SHARDS = 16
FINE = 256  # a heavy key or cell weighs more than 1 / FINE of a shard, in bytes or rows
RANGE_ROWS = 1 << 20
RANGES = 1024
SAMPLES_PER_RANGE = 20


def _unit(*cols: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def _range_of(key: Column, cuts: list[int]) -> Column:
    """Number of boundaries at or below the key, by a search in two steps."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    heads = F.array(*[F.lit(c) for c in cuts[::step]])
    groups = F.array(*[F.array(*[F.lit(c) for c in cuts[k:k + step]]) for k in range(0, len(cuts), step)])
    below = F.size(F.filter(heads, lambda c: c <= key))
    inside = F.size(F.filter(F.element_at(groups, F.greatest(below, F.lit(1))), lambda c: c <= key))
    return F.when(below == 0, 0).otherwise((below - 1) * step + inside)


def splitters(sized: DataFrame, ranges: int, total: int) -> list[int]:
    """Quantile boundaries of a size-weighted sample of the keys."""
    rate = F.col("size") * F.lit(float(ranges * SAMPLES_PER_RANGE)) / F.lit(float(total))
    sample = sized.where(_unit(F.col("pos"), F.col("key")) < rate)
    probs = [k / ranges for k in range(1, ranges)]
    cuts = sample.agg(F.percentile_approx("key", F.lit(probs), F.lit(100 * ranges)).alias("q")).first()["q"]
    return sorted(set(cuts or []))


def _fill(cells: list[tuple[int, int, int]], shards: int, total: int) -> tuple[dict[tuple[int, int], int], list[float]]:
    """Shards of the heavy cells (key, cell, bytes), and the bytes each shard has left for the ranges.

    Largest key first, whole into the shard with most room; a key that fits nowhere is split between its cells.
    """
    room = [total / shards] * shards
    keys: dict[int, list[tuple[int, int]]] = {}
    for key, cell, size in cells:
        keys.setdefault(key, []).append((cell, size))
    place = {}
    for key, own in sorted(keys.items(), key=lambda x: (-sum(s for _, s in x[1]), x[0])):
        best = max(range(shards), key=room.__getitem__)
        if sum(s for _, s in own) <= room[best]:
            place |= {(key, cell): best for cell, _ in own}
            room[best] -= sum(s for _, s in own)
            continue
        for cell, size in sorted(own):
            if room[best] < size / 2:
                best = max(range(shards), key=room.__getitem__)
            place[key, cell] = best
            room[best] -= size
    return place, [max(0.0, r) for r in room]


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs`` (doc_id, text).

    Law ``bytes``: shards differ in bytes by no more than about 1 / FINE of a shard, unless single rows are larger
    than that. Equal texts share a shard unless all their copies do not fit in one. Null text: size 1, the checksum
    of nothing, equal to the empty text. ``slot`` counts each shard's rows from 0; grown_shard is null under this
    law. No rows give no rows; other columns are not looked at.
    """
    spark = docs.sparkSession
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), empty_text().alias("text")).select(
        "doc_id", (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"), F.xxhash64("text").alias("key"))
    sized = store(sized.withColumn("pos", F.monotonically_increasing_id()), "sized")
    whole = sized.agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).first()
    n, total = whole["n"], whole["bytes"] or 1
    ranges = max(RANGES, n // RANGE_ROWS)

    cell_bytes, cell_rows = max(1, total // (shards * FINE)), max(1, n // (shards * FINE))
    by_key = sized.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    by_key = by_key.where((F.col("bytes") > cell_bytes) | (F.col("rows") > F.greatest(F.lit(cell_rows), F.lit(8))))
    heavy = by_key.select("key", F.ceil(F.greatest(F.col("bytes") / cell_bytes, F.col("rows") / cell_rows)).cast("int").alias("cells"))
    heavy = store(heavy, "heavy")
    ranged = sized.withColumn("range", _range_of(F.col("key"), splitters(sized, ranges, total)))
    # fewer than 2 * FINE * shards heavy keys, one row per range or cell: all that is broadcast here
    celled = ranged.join(F.broadcast(heavy), "key", "left")
    celled = celled.withColumn("cell", F.when(F.col("cells").isNull(), -1).otherwise(F.pmod(F.xxhash64("pos"), F.col("cells")).cast("int")))
    celled = store(celled.withColumn("hot", F.when(F.col("cells").isNull(), 0).otherwise(F.col("key"))).drop("cells"), "celled")

    measured = celled.where("cell >= 0").groupBy("hot", "cell").agg(F.sum("size").alias("bytes")).collect()
    place, room = _fill([tuple(r) for r in measured], shards, total)
    heavy_at = spark.createDataFrame([(k, c, s) for (k, c), s in place.items()], "hot long, cell int, at int")

    # light keys follow each other over all ranges; the middle of a key's bytes says in which shard's room it lies
    light = celled.where("cell < 0").groupBy("range").agg(F.sum("size").alias("bytes"))
    ahead = light.select("range", (F.sum("bytes").over(Window.orderBy("range")) - F.col("bytes")).alias("ahead"))
    cell = Window.partitionBy("range", "hot", "cell")
    upto = F.sum("size").over(cell.orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    own = F.sum("size").over(Window.partitionBy("range", "hot", "cell", "key"))
    scale = (total - sum(r["bytes"] for r in measured)) / max(1.0, sum(room))
    bounds, middle, to_light = 0.0, F.col("ahead") + F.col("upto") - F.col("own") / 2, F.lit(0)
    for r in room[:-1]:
        bounds += r * scale
        to_light += (middle >= bounds).cast("int")
    placed = celled.join(F.broadcast(ahead), "range", "left").join(F.broadcast(heavy_at), ["hot", "cell"], "left")
    placed = placed.withColumn("upto", upto).withColumn("own", own).withColumn("shard", F.coalesce("at", to_light))
    ranked = F.row_number().over(Window.partitionBy("shard", "range", "hot", "cell").orderBy("key", "pos"))
    where = ["shard", "range", "hot", "cell"]
    placed = store(placed.select("doc_id", "size", "text_crc32", *where, ranked.alias("rank")), "placed")
    counts = placed.groupBy(*where).agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("shard").orderBy("range", "hot", "cell")) - F.col("rows")
    return placed.join(F.broadcast(counts.select(*where, before.alias("before"))), where).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("rank") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
