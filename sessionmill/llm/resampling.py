"""Importance resampling towards a target: documents that look like it are drawn more often.

Words come from the pre-tokenisation of ``tokenizers``: an untrained ``Split`` by a pattern over the
text with A-Z lower-cased, as words with their offsets. Each window of one to ``max_words`` words is a
feature and falls to a bucket by its CRC. The log ratio of the buckets' shares in target and
documents, summed over a document's features, is its log importance weight; with Gumbel noise added,
the highest scores are a draw without replacement.

1. Each text is split once; its features' buckets are written as an array of small integers.
2. Bucket counts are summed inside each task, then over tasks: one row per bucket and task is shuffled, and
   the gains, one number per bucket, go to the tasks.
3. Documents are ranked by range partitions of (score, doc_id, row): a place is its partition's start plus
   its place there, so no task sees more than its range.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

from sessionmill.llm.frames import empty_text, map_rows, store

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
MIN_WORDS = 20
SHARE = (10, 100)
SEED = 2024
PIECE = 1 << 18
KNOWN_WORDS = 1 << 18


def _pieces(text: str) -> Iterator[str]:
    """Pieces of a long text, cut where no word is; a stretch without such a place stays whole."""
    between, at = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"), 0
    while len(text) - at > PIECE:
        cut = between.search(text, at + PIECE)
        if cut is None:
            break
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:]


class Features:
    """Buckets of a text's features, by one splitter for a task."""

    def __init__(self, max_words: int, buckets: int):
        self.split = pre_tokenizers.Split(Regex(WORD), "removed", invert=True)
        self.max_words, self.buckets = max_words, buckets
        self.known: dict[str, int] = {}

    def bucket(self, feature: str) -> int:
        found = self.known.get(feature)
        if found is None:
            if len(self.known) >= KNOWN_WORDS:
                self.known.clear()
            found = self.known[feature] = zlib.crc32(feature.encode("utf-8", "surrogatepass")) % self.buckets
        return found

    def of(self, text: str) -> tuple[int, np.ndarray]:
        """(number of words, bucket of each feature) of a whole text."""
        lowered = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
        n_words, parts, before = 0, [], []  # the last words of the piece before
        for piece in _pieces(lowered):
            spans = [span for _, span in self.split.pre_tokenize_str(piece)]
            words = before + [piece[start:end] for start, end in spans]
            n_words += len(spans)
            for n in range(1, self.max_words + 1):
                # windows that end in this piece, from their first word to their last
                first = max(0, len(before) - n + 1)
                parts.append(np.fromiter((self.bucket(" ".join(words[i:i + n]) if n > 1 else words[i]) for i in range(first, len(words) - n + 1)), np.uint32))
            before = words[len(words) - self.max_words + 1:] if self.max_words > 1 else []
        return n_words, np.concatenate(parts)


def _split(max_words: int, buckets: int):
    small = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(rows):
        features = Features(max_words, buckets)
        for row in rows:
            n_words, found = features.of(row["text"])
            yield row["row"], row["doc_id"], row["rest"], n_words, len(found), found.astype(small).tobytes()
    return run, small


def bucket_counts(split: DataFrame, buckets: int, small: str) -> np.ndarray:
    """Features in each bucket over all rows: bounded by the number of buckets."""
    def run(rows):
        total = np.zeros(buckets, np.int64)
        for row in rows:
            total += np.bincount(np.frombuffer(row["buckets"], small), minlength=buckets)
        yield from ((int(i), int(total[i])) for i in np.flatnonzero(total))

    out = np.zeros(buckets, np.int64)
    for r in map_rows(split.select("buckets"), run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(ours: np.ndarray, target: np.ndarray) -> list[int]:
    """Thousandths of the log ratio of each bucket's smoothed shares, rounded down."""
    k = len(ours)
    s_all, t_all = int(ours.sum()), int(target.sum())
    return [math.floor(1000 * math.log((int(t) + 1.0) * (s_all + float(k)) / ((int(s) + 1.0) * (t_all + float(k))))) for s, t in zip(ours, target)]


def noise(seed: int, doc_id: int | None) -> int:
    """Thousandths of a Gumbel draw that seed and id decide; a null id hashes as the empty string."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def importance(
    docs: DataFrame,
    target: DataFrame,
    max_words: int = 1,
    buckets: int = BUCKETS,
    min_words: int = MIN_WORDS,
    share: tuple[int, int] = SHARE,
    seed: int = SEED,
    carry: list[str] | None = None,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for every row of ``docs`` (doc_id, text), and the columns ``carry`` of docs as a struct ``carried``.

    ``rank`` counts the drawn rows from 1: of N rows with at least ``min_words`` words, floor(share * N) with the highest
    score; ties go to the smaller doc_id (null last), then to the row that was read first. Others have none. Null texts, in docs or ``target``
    (text), have no features; empty tables count as no features, and no rows give no rows. A text of any length is split whole.
    Each row is a document, also where ids repeat; rows with equal ids get equal noise.
    """
    carried = F.struct(F.lit(0).alias("any"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry or [])])
    plain = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), empty_text().alias("text"), carried.alias("rest"))
    kind = plain.schema["rest"].dataType.simpleString()
    run, small = _split(max_words, buckets)
    schema = f"row long, doc_id long, rest {kind}, n_words long, n_features long, buckets binary"
    split = store(map_rows(plain, run, schema), "features")
    wanted = target.select(F.lit(0).cast("long").alias("row"), F.lit(0).cast("long").alias("doc_id"), empty_text().alias("text"), F.struct(F.lit(0).alias("any")).alias("rest"))
    # the target is read twice by no one: its counts are all that is kept
    t = bucket_counts(map_rows(wanted, run, schema.replace(kind, "struct<any:int>")), buckets, small)
    gain = np.array(gains(bucket_counts(split, buckets, small), t), np.int64)

    def weigh(rows):
        for row in rows:
            weight = int(gain[np.frombuffer(row["buckets"], small)].sum())
            yield row["row"], row["doc_id"], row["rest"], row["n_words"], row["n_features"], weight, weight + noise(seed, row["doc_id"])

    scored = store(map_rows(split, weigh, f"row long, doc_id long, rest {kind}, n_words long, n_features long, weight long, score long"), "scored")
    can = F.col("n_words") >= min_words
    draw = scored.where(can).count() * share[0] // share[1]
    out = ["doc_id", "n_features", "weight", "score", "rank", F.col("rest").alias("carried")]
    ranked = _ranked(scored.where(can)).withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    rest = scored.where(~can).withColumn("rank", F.lit(None).cast("long"))
    both = ranked.select(*out).unionByName(rest.select(*out))
    return both if carry is not None else both.drop("carried")


def _ranked(scored: DataFrame) -> DataFrame:
    """Rows with their ``rank`` by falling score, from 1 without gaps."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row").asc()]
    placed = store(scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "placed")
    part, inside = F.shiftright("place", 33).alias("part"), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part).agg(F.count("*").alias("n"))  # one row for each range partition
    start = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))
    return placed.withColumn("part", part).join(F.broadcast(start), "part").withColumn("rank", F.col("start") + inside + 1)


def drawn(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns, by :func:`importance`; of no particular order."""
    found = importance(docs, target, carry=docs.columns, **how).where(F.col("rank").isNotNull())
    return found.select(*[F.col(f"carried.c{i}").alias(c) for i, c in enumerate(docs.columns)])
