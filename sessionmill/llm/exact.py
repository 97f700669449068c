"""Exact deduplication by an extendible-hash index on files all executors share.

The key of a text is its 64-bit hash. A directory maps the key's leading bits to buckets; a bucket
with too many different keys splits on its next bit, and when its depth reaches that of the
directory the directory doubles. The directory is grown from key counts per prefix, before any text
moves, and holds one entry per bucket or a few. Then:

1. every map task combines the equal texts it meets, so a text repeated in a third of all rows leaves
   one row per task;
2. owner tasks receive whole buckets, read them in key order, chain the different texts that share a key
   and compare their bytes;
3. their entries (key, chain position, digest, survivor, copies) are the index, written as Parquet to the
   shared folder, ordered by bucket.

A lost executor repeats its own buckets only.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionmill.llm.frames import empty_text, keep_rows, map_rows, store

BUCKET_KEYS = 1_000
DIRECTORY_BUCKETS = 1 << 16
FIRST_BITS, MORE_BITS = 12, 4
COMBINE_BYTES = 16 << 20
OWNER_BYTES = 32 << 20  # text of an owner task, on average
WHOLE = (1 << 64) - 1


def _prefix(key, bits: int):
    """The leading bits of a 64-bit key; zero bits: the one prefix 0."""
    return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")


def grow_directory(keys: DataFrame, bucket_keys: int | None = None) -> list[tuple[int, int]]:
    """The buckets as (prefix, depth), in key order, for a table of distinct keys (column ``key``).

    ``bucket_keys``: keys a bucket holds at most; by default 1,000, and more where the directory would pass
    about 65,536 buckets, so that it stays small at any size. Counts by prefix come from one aggregate for
    each few bits of depth; the later ones look at overfull prefixes only. Different keys always part in
    the end, so no bucket stays overfull.
    """
    if bucket_keys is None:
        bucket_keys = max(BUCKET_KEYS, keys.count() // DIRECTORY_BUCKETS)
    done: list[tuple[int, int]] = []
    open_, depth = [0], 0
    while open_:
        deeper = min(64, depth + (MORE_BITS if depth else FIRST_BITS))
        part = keys if not depth else keys.where(_prefix(F.col("key"), depth).isin(open_))
        level = {p & WHOLE: n for p, n in part.groupBy(_prefix(F.col("key"), deeper).alias("p")).count().collect()}
        inside = {deeper: level}
        for at in range(deeper - 1, depth - 1, -1):
            level = {}
            for p, n in inside[at + 1].items():
                level[p >> 1] = level.get(p >> 1, 0) + n
            inside[at] = level
        overfull, stack = [], [(p, depth) for p in open_]
        while stack:
            prefix, at = stack.pop()
            if inside[at].get(prefix, 0) <= bucket_keys or at == 64:
                done.append((prefix, at))
            elif at == deeper:
                overfull.append(prefix)
            else:
                stack += [(2 * prefix, at + 1), (2 * prefix + 1, at + 1)]
        open_, depth = overfull, deeper
    return sorted(done, key=lambda x: x[0] << (64 - x[1]))


def _combine(cuts: list[int]):
    """Equal texts of a task become one row for their owner; the table of texts is written out whenever it is full."""
    def run(rows):
        held: dict[str, list] = {}
        size = 0

        def out():
            for text, (key, doc_id, n) in held.items():
                yield bisect_right(cuts, key & WHOLE), key, text, doc_id, n

        for row in rows:
            entry = held.get(row["text"])
            if entry is None:
                held[row["text"]] = [row["key"], row["doc_id"], 1]
                size += len(row["text"]) + 200
            else:
                entry[2] += 1
                if entry[1] is None or row["doc_id"] is not None and row["doc_id"] > entry[1]:
                    entry[1] = row["doc_id"]
            if size > COMBINE_BYTES:
                yield from out()
                held, size = {}, 0
        yield from out()
    return run


def _owner(starts: list[int]):
    """Entries of the owner task's buckets: keys in order, a chain of different texts for each."""
    def run(rows):
        key, chain = None, []  # of [text, survivor, copies]

        def entries():
            bucket = bisect_right(starts, key & WHOLE) - 1
            for place, (text, doc_id, n) in enumerate(chain):
                yield bucket, key, place, hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), len(text), doc_id, n

        for row in rows:
            if row["key"] != key:
                if chain:
                    yield from entries()
                key, chain = row["key"], []
            for link in chain:
                if link[0] == row["text"]:  # the bytes decide, not the key
                    link[2] += row["n"]
                    if link[1] is None or row["doc_id"] is not None and row["doc_id"] > link[1]:
                        link[1] = row["doc_id"]
                    break
            else:
                chain.append([row["text"], row["doc_id"], row["n"]])
        if chain:
            yield from entries()
    return run


def owner_count(size: int, buckets: int) -> int:
    """Owner tasks for ``size`` bytes of text: they grow with the text, whatever the session's settings, up to one a bucket."""
    return max(1, min(buckets, -(-size // OWNER_BYTES)))


ENTRY = "bucket int, key long, place int, sha string, chars long, keep_id long, group_size long"


def build_index(docs: DataFrame, bucket_keys: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, index): rows is (doc_id, key, sha) of each row, index one entry per different text."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), empty_text().alias("text")).withColumn("key", F.xxhash64("text"))
    sha = F.sha2(F.encode("text", "UTF-8"), 256).alias("sha")
    rows = store(text.select("doc_id", "key", sha, F.octet_length("text").cast("long").alias("size")), "keys")
    directory = grow_directory(rows.select("key").distinct(), bucket_keys)
    starts = [prefix << (64 - depth) for prefix, depth in directory]
    owners = owner_count(rows.agg(F.sum("size")).first()[0] or 0, len(starts))
    cuts = [starts[len(starts) * k // owners] for k in range(1, owners)]
    dealt = map_rows(text, _combine(cuts), "owner int, key long, text string, doc_id long, n long")
    dealt = dealt.repartitionById(owners, "owner").sortWithinPartitions("key").drop("owner")
    return rows.drop("size"), store(map_rows(dealt, _owner(starts), ENTRY), "index")


def exact_groups(docs: DataFrame, bucket_keys: int | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs`` (doc_id, text).

    Texts are equal when identical; null counts as empty. The row with the largest doc_id stays; null ids
    are smaller than any other. Of several rows that share both text and largest doc_id each is marked kept
    (``drop_copies`` lets one stay). No rows give no rows; other columns are not looked at.
    """
    rows, index = build_index(docs, bucket_keys)
    entry = index.select("key", "sha", "keep_id", "group_size")
    return rows.join(entry, ["key", "sha"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, bucket_keys: int | None = None) -> DataFrame:
    """The rows of ``docs``, one for each different text (largest doc_id), with all their columns."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), empty_text().alias("text"))
    _, index = build_index(text, bucket_keys)
    kept = index.select(F.col("keep_id").alias("doc_id"), F.col("sha").alias("digest"))
    return keep_rows(docs, kept, lambda t: F.sha2(F.encode(t, "UTF-8"), 256))
