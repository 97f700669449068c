"""Line deduplication: frequent lines are found by probing a sharded minimal perfect hash.

A line's key is a 128-bit hash. A shard holds the distinct keys that fall to it by some bits of the
hash: a minimal perfect hash (levels of bit arrays; a key sits at the first level where it is alone at
its position, its rank among all set bits is its place), an array of 32-bit fingerprints and an array
of document counts, both by place. Keys themselves are not stored. Shards have bounded size and are
Parquet rows in the shared folder; their number grows with the keys.

1. Documents get a number and are cut into blocks of neighbours. Each block's distinct keys, with the
   number of its documents that have them, are written once; a line in a third of all documents is one row a block.
2. The rows are summed by key and compiled to shards.
3. The blocks' keys stream past the shard they fall to, behind its arrays, and the frequent ones go back
   to their block as answers; documents are not joined with lines, and a shard's memory is that of its arrays.
4. Each block's documents stream behind its answers and lose their frequent lines.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionmill.llm.frames import empty_text, fresh_name, map_rows, small_batches, store
from sessionmill.llm.text import mix

BLOCK_BITS = 10
SHARD_KEYS = 1 << 14
LEAST_SHARDS = 32
HELD_KEYS = 1 << 18
SPREAD = 2  # positions of a level for each key that is left
MOST = np.iinfo(np.uint16).max


def line_keys(text: str) -> list[bytes]:
    """One key for each line: ASCII white space stripped at both ends, A-Z lower-cased."""
    return [line.strip(b" \t\n\x0b\x0c\r") for line in text.encode("utf-8", "surrogatepass").lower().split(b"\n")]


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode("utf-8", "surrogatepass")) >= min_chars)


def _at(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    """Position of each key among ``size`` at a level; levels are independent of each other."""
    x = mix(a ^ mix(b + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)))
    return ((x >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)


def _prints(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (mix(b ^ mix(a ^ np.uint64(0xD1342543DE82EF95))) >> np.uint64(32)).astype("<u4")


def compile_shard(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[list[int], bytes, bytes, bytes]:
    """(level sizes, bits, fingerprints, counts) of distinct keys (a, b), unsigned, with counts n."""
    sizes, levels, left = [], [], np.arange(len(a))
    while len(left):
        size = SPREAD * len(left) + 1
        at = _at(a[left], b[left], len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        levels.append(alone)
        left = left[~alone[at]]
    bits = np.concatenate(levels) if levels else np.zeros(0, bool)
    shard = Shard(sizes, np.packbits(bits).tobytes(), b"", b"")
    place = shard.places(a, b)
    prints, counts = np.zeros(len(a), "<u4"), np.zeros(len(a), "<u2")
    prints[place], counts[place] = _prints(a, b), np.minimum(n, MOST)
    return sizes, shard.packed, prints.tobytes(), counts.tobytes()


class Shard:
    """Arrays of one shard, as compiled by :func:`compile_shard`."""

    def __init__(self, sizes: list[int], bits: bytes, prints: bytes, counts: bytes):
        self.sizes, self.packed = sizes, bits
        self.bits = np.unpackbits(np.frombuffer(bits, np.uint8), count=sum(sizes)).astype(bool)
        self.rank = np.cumsum(self.bits) - 1
        self.prints, self.counts = np.frombuffer(prints, "<u4"), np.frombuffer(counts, "<u2")

    def places(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Place of each key; -1 or the place of another key for one that is not in the shard."""
        out, left, base = np.full(len(a), -1), np.arange(len(a)), 0
        for level, size in enumerate(self.sizes):
            at = base + _at(a[left], b[left], level, size)
            here = self.bits[at]
            out[left[here]] = self.rank[at[here]]
            left, base = left[~here], base + size
        return out

    def documents(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of documents that have each key; 0 where the fingerprint says it is not in the shard."""
        place = self.places(a, b)
        known = place >= 0
        known[known] = self.prints[place[known]] == _prints(a[known], b[known])
        return np.where(known, self.counts[np.where(known, place, 0)] if len(self.counts) else 0, 0)


KEY = "block long, a long, b long, n long"


def _block_keys(min_chars: int):
    """Distinct keys of each block and the number of its documents that have them."""
    def run(batches):
        block, held = None, {}

        def out():
            if held:
                pair = np.frombuffer(b"".join(held), "<i8").reshape(-1, 2)
                n = np.fromiter(held.values(), np.int64, len(held))
                yield pa.record_batch([np.full(len(held), block), pair[:, 0].copy(), pair[:, 1].copy(), n], ["block", "a", "b", "n"])

        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text")):
                if row >> BLOCK_BITS != block or len(held) > HELD_KEYS:
                    yield from out()
                    block, held = row >> BLOCK_BITS, {}
                for key in set(line_keys(text.as_py())):
                    if _long_enough(key, min_chars):
                        digest = xxhash.xxh3_128_digest(key)
                        held[digest] = held.get(digest, 0) + 1
        yield from out()
    return run


def _compiled(rows: Iterator[dict]) -> Iterator[tuple]:
    shard, held = None, []

    def out():
        a, b, n = (np.array(x, np.int64) for x in zip(*held))
        return (shard, *compile_shard(a.view(np.uint64), b.view(np.uint64), n))

    for row in rows:
        if held and row["shard"] != shard:
            yield out()
            held = []
        shard = row["shard"]
        held.append((row["a"], row["b"], row["n"]))
    if held:
        yield out()


def _probed(min_docs: int):
    """Frequent keys of the blocks; rows come by shard, its arrays (no block) ahead of the keys."""
    def run(batches):
        shard, arrays = None, None
        for batch in batches:
            numbers = batch.column("shard").to_numpy(zero_copy_only=False)
            compiled = batch.column("block").is_null().to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((np.diff(numbers) != 0) | compiled[1:] | compiled[:-1]) + 1), len(numbers)]
            for start, end in zip(cuts, cuts[1:]):
                if start == end:
                    continue
                part = batch.slice(start, end - start)
                if compiled[start]:
                    shard = numbers[start]
                    arrays = Shard(*(part.column(c)[0].as_py() for c in ("sizes", "bits", "prints", "counts")))
                    continue
                assert shard == numbers[start], "keys without their shard"
                a, b = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in "ab")
                found = arrays.documents(a.view(np.uint64), b.view(np.uint64)) >= min_docs
                if found.any():
                    blocks = part.column("block").to_numpy(zero_copy_only=False).astype(np.int64)
                    yield pa.record_batch([blocks[found], a[found], b[found]], ["block", "a", "b"])
    return run


def _cleaned(min_chars: int):
    """Documents without the frequent lines of their block; rows come by block, answers (no row) ahead of documents."""
    def run(batches):
        block, frequent = None, set()
        for batch in batches:
            texts, lines, dropped, kept = [], [], [], []
            columns = [batch.column(c).to_pylist() for c in ("block", "row", "a", "b")]
            for i, (at, row, a, b) in enumerate(zip(*columns)):
                if at != block:
                    block, frequent = at, set()
                if row is None:
                    frequent.add(struct.pack("<qq", a, b))
                    continue
                text = batch.column("text")[i].as_py()
                keys, whole = line_keys(text), text.split("\n")
                stays = whole if not frequent else [
                    line for line, key in zip(whole, keys)
                    if not (_long_enough(key, min_chars) and xxhash.xxh3_128_digest(key) in frequent)]
                kept.append(i)
                texts.append("\n".join(stays))
                lines.append(len(whole))
                dropped.append(len(whole) - len(stays))
            if kept:
                yield pa.record_batch(
                    [pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), batch.column("rest").take(pa.array(kept))],
                    ["text", "n_lines", "n_dropped", "rest"])
    return run


SHARD = "shard long, sizes array<long>, bits binary, prints binary, counts binary"


def line_index(keys: DataFrame) -> DataFrame:
    """Shards (``SHARD``) over the distinct keys of a table of block keys (``KEY``), and their counts over all blocks."""
    shards = max(LEAST_SHARDS, -(-keys.count() // SHARD_KEYS))  # rows of keys: at least the distinct ones
    summed = keys.groupBy("a", "b").agg(F.sum("n").alias("n")).withColumn("shard", _shard(shards))
    index = map_rows(summed.repartition("shard").sortWithinPartitions("shard"), _compiled, SHARD)
    return store(index.withColumn("of", F.lit(shards).cast("long")), "line_index")


def _shard(shards: int | F.Column):
    return F.pmod(F.shiftrightunsigned(F.col("a"), 1), F.lit(shards).cast("long"))


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """All rows and columns of ``docs`` (doc_id, text, …), the text without frequent lines, plus ``n_lines`` (before) and ``n_dropped``.

    Lines are what lies between newlines; their keys are stripped of ASCII white space and A-Z lower-cased. A key of at
    least ``min_chars`` code points that ``min_docs`` rows have loses all its lines in every row. Each row is a document, also
    where ids repeat or are null; a null text is one empty line and comes back empty. A text of any length is processed
    whole, one at a time. No rows give no rows. Where docs has a column n_lines or n_dropped, the new one's name gets an underscore.
    ``min_docs`` is at most 65,535, where the counts saturate. Two lines count as one if their 128-bit hashes agree.
    """
    if not 1 <= min_docs <= MOST:
        raise ValueError(f"min_docs must lie between 1 and {MOST}")
    spark = docs.sparkSession
    small_batches(spark)
    others = [c for c in docs.columns if c.lower() != "text"]
    rest = F.struct(F.lit(0).alias("any"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)])
    numbered = store(docs.select(F.monotonically_increasing_id().alias("row"), empty_text().alias("text"), rest.alias("rest")), "numbered")
    keys = store(numbered.select("row", "text").mapInArrow(_block_keys(min_chars), KEY), "line_keys")
    index = line_index(keys)
    shards = index.agg(F.max("of")).first()[0] or 1

    probes = keys.select("block", "a", "b", _shard(shards).alias("shard"))
    ahead = index.select(*[c.split()[0] for c in SHARD.split(", ")])
    routed = ahead.unionByName(probes, allowMissingColumns=True).repartition("shard").sortWithinPartitions("shard", F.col("block").isNotNull())
    answers = routed.mapInArrow(_probed(min_docs), "block long, a long, b long")

    block = F.shiftright("row", BLOCK_BITS).alias("block")
    behind = numbered.select(block, "row", "text", "rest")
    dealt = answers.unionByName(behind, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", F.col("row").isNotNull())
    kept = dealt.mapInArrow(_cleaned(min_chars), f"text string, n_lines long, n_dropped long, rest {numbered.schema['rest'].dataType.simpleString()}")
    back = {c: F.col(f"rest.c{i}") for i, c in enumerate(others)}
    return kept.select(
        *[back.get(c, F.col("text")).alias(c) for c in docs.columns],
        F.col("n_lines").alias(fresh_name(docs, "n_lines")), F.col("n_dropped").alias(fresh_name(docs, "n_dropped")))
