"""Hard-negative mining by exact inner products on STR-packed R-trees.

Rows are cut into strips along the coordinate of largest variance (a range partition, ties spread by
row number); each strip's task packs its rows by sort-tile-recursion over the next coordinates into
leaves and boxes, and writes the tree as one Parquet row. A box bounds a query's inner product from
both sides, coordinate by coordinate.

Queries (a bounded share of the rows, by the caller's choice) travel in blocks of packed vectors to every
strip. A block walks a tree best first: the queue holds boxes by the largest bound any of its queries
still allows. A query leaves a box out if the bound is strictly below its k-th score, or equal with only
larger ids, or if all scores lie outside its window, or if its labels cannot match. Each strip reports at most k rows of
a query; these meet in a window by query. The first search finds the positives, the second one, with a score window for
each (anchor, positive score), the negatives.

Strips grow with the square root of the rows between fixed bounds, so a task's memory stays bounded.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionmill.llm.frames import map_rows, store, streamed_groups

POSITIVES, NEGATIVES = 5, 3
WINDOW = (50, 95)  # per cent of the positive's score
SCALE = 256
LEAF, FANOUT = 128, 16
BLOCK = 512
STRIP_ROWS = (2_048, 131_072)
NO_ID = (1 << 63) - 1
LONG = (-(1 << 63), (1 << 63) - 1)
EXACT_4, EXACT_8 = 1 << 24, 1 << 53  # integers up to here are exact as floats of 4 and 8 bytes


def packed(vectors: np.ndarray) -> bytes:
    """Whole numbers as floats, four bytes each where that is exact."""
    small = not vectors.size or np.abs(vectors).max() <= EXACT_4
    return (b"4" if small else b"8") + vectors.astype("<f4" if small else "<f8").tobytes()


def unpacked(data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, f"<f{data[:1].decode()}", offset=1).reshape(-1, dim)


_whole = np.frompyfunc(int, 1, 1)


def exact_type(a: np.ndarray, b: np.ndarray):
    """How to turn both into numbers in which sums of their products are exact: floats, or Python integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most <= EXACT_4:
        return lambda x: x.astype("f4")
    return (lambda x: x.astype("f8")) if most <= EXACT_8 else (lambda x: _whole(x).astype(object))


def str_order(vectors: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Order of the rows in which each run of ``leaf`` of them is a tile: slabs of equal size along one coordinate, sorted
    by the next one inside (the two of largest variance)."""
    n = len(vectors)
    if n <= leaf or not vectors.shape[1]:
        return np.arange(n)
    by = np.argsort(-vectors.var(axis=0), kind="stable")[:2]
    slab = leaf * math.ceil(math.ceil(n / leaf) ** (1 / len(by)))
    order = np.argsort(vectors[:, by[0]], kind="stable")
    for at in range(0, n, slab):
        part = order[at:at + slab]
        order[at:at + slab] = part[np.argsort(vectors[part, by[-1]], kind="stable")]
    return order


class Tree:
    """A packed R-tree over rows in tile order. Level 0 are the leaves, the last level is the root."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray):
        self.vectors, self.ids, self.rows, self.labels = vectors, ids, rows, labels
        self.levels = []  # of (lows, highs, smallest ids, label if there is one only, whether there is one only)
        n, step = len(ids), LEAF
        lows = highs = vectors
        least, label, one = ids, labels, np.ones(n, bool)
        while True:
            at = np.arange(0, len(least), step)
            low_label, high_label = np.minimum.reduceat(label, at), np.maximum.reduceat(label, at)
            one = np.logical_and.reduceat(one, at) & (low_label == high_label)
            lows, highs = np.minimum.reduceat(lows, at, axis=0), np.maximum.reduceat(highs, at, axis=0)
            least, label, step = np.minimum.reduceat(least, at), low_label, FANOUT
            self.levels.append((lows, highs, least, label, one))
            if len(at) == 1:
                break


def search(tree: Tree, queries: np.ndarray, rows: np.ndarray, labels: np.ndarray, lows: np.ndarray, highs: np.ndarray, same: bool, k: int):
    """(query, score, tree row) of the k first rows of each query: highest score, then smallest id, then row.

    Only rows with the query's label (``same``) or another one count, whose score lies in [low, high], and not the query's own row.
    The ends of the range of a long stand for no limit.
    """
    exact = exact_type(tree.vectors, queries)
    vectors, queries = exact(tree.vectors), exact(queries)
    ends = [(lows, LONG[0], -np.inf), (highs, LONG[1], np.inf)]
    lows, highs = (np.where(x == none, far, x.astype(object if vectors.dtype == object else float)) for x, none, far in ends)
    plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
    bounds = []
    for low, high, *_ in tree.levels:
        low, high = exact(low), exact(high)
        bounds.append((plus @ low.T + minus @ high.T, plus @ high.T + minus @ low.T))
    q = len(queries)
    kth, kth_id = np.full(q, -np.inf, object if vectors.dtype == object else float), np.full(q, NO_ID)
    best = (np.zeros(0, np.int64), np.zeros(0, vectors.dtype), np.zeros(0, np.int64))  # query, score, place

    def allowed(level: int, node: int, among: np.ndarray) -> np.ndarray:
        _, _, least, label, one = tree.levels[level]
        low, high = bounds[level][0][among, node], bounds[level][1][among, node]
        # ties with the k-th are open to smaller ids, and to rows of the same id
        open_ = (high >= lows[among]) & (low <= highs[among]) & ((high > kth[among]) | (high == kth[among]) & (least[node] <= kth_id[among]))
        if same:
            fits = labels[among] == label[node] if one[node] else True
        else:
            fits = labels[among] != label[node] if one[node] else True
        return among[(open_ & fits).astype(bool)]

    queue: list[tuple] = []

    def push(level: int, node: int, among: np.ndarray) -> None:
        among = allowed(level, node, among)
        if len(among):
            heapq.heappush(queue, (-bounds[level][1][among, node].max(), int(tree.levels[level][2][node]), level, node, len(queue), among))

    push(len(tree.levels) - 1, 0, np.arange(q))
    while queue:
        *_, level, node, _, among = heapq.heappop(queue)
        among = allowed(level, node, among)
        if not len(among):
            continue
        if level:
            for child in range(node * FANOUT, min((node + 1) * FANOUT, len(tree.levels[level - 1][2]))):
                push(level - 1, child, among)
            continue
        own = slice(node * LEAF, min((node + 1) * LEAF, len(tree.ids)))
        scores = queries[among] @ vectors[own].T
        if vectors.dtype == object:
            scores = np.clip(scores, *LONG)
        ids = tree.ids[own]
        matches = (labels[among][:, None] == tree.labels[own][None, :]) == same
        at = kth[among][:, None]
        keep = matches & (scores >= lows[among][:, None]) & (scores <= highs[among][:, None]) & (rows[among][:, None] != tree.rows[own][None, :])
        keep &= (scores > at) | (scores == at) & (ids[None, :] <= kth_id[among][:, None])
        who, place = np.nonzero(keep.astype(bool))
        if not len(who):
            continue
        touched = among[np.unique(who)]
        again = np.isin(best[0], touched)
        query = np.concatenate([best[0][again], among[who]])
        score = np.concatenate([best[1][again], scores[who, place]])
        place = np.concatenate([best[2][again], place + own.start])
        order = np.lexsort((tree.rows[place], tree.ids[place], -score, query)) if score.dtype != object else np.array(
            sorted(range(len(query)), key=lambda i: (query[i], -score[i], tree.ids[place[i]], tree.rows[place[i]])))
        query, score, place = query[order], score[order], place[order]
        starts = np.flatnonzero(np.r_[True, np.diff(query) != 0])
        nth = np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)]))
        last = nth == k - 1
        kth[query[last]], kth_id[query[last]] = score[last], tree.ids[place[last]]
        first = nth < k
        best = tuple(np.concatenate([b[~again], x[first]]) for b, x in zip(best, (query, score, place)))
    return best


def clean(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, label, q): rows with a label and a finite vector, components scaled, each row with a number.

    Stored, so that the numbers stay.
    """
    v = F.col("embedding")
    scaled = F.transform(v, lambda x: x.cast("double") * SCALE)
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    kept = vectors.where(F.col("label").isNotNull() & v.isNotNull()).where(finite)
    return store(kept.select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), scaled.alias("q")), "vectors")


TREE = "strip int, count long, vectors binary, ids binary, rows binary, labels binary"
QUERY = "query long, row long, label long, low long, high long, q array<double>"


def _id() -> Column:
    return F.coalesce("vec_id", F.lit(NO_ID))


def _whole_vectors(rows: list, dim: int) -> np.ndarray:
    """Scaled vectors rounded down, zeros behind shorter ones; what left the range of doubles by scaling is its end."""
    out = np.zeros((len(rows), dim))
    for i, q in enumerate(rows):
        out[i, :len(q)] = q
    most = np.finfo(float).max
    return np.clip(np.floor(out), -most, most)


def build_trees(vectors: DataFrame, dim: int) -> DataFrame:
    """One row (``TREE``) for each strip that has rows; ``strip`` is the number of its partition."""
    n = vectors.count()
    strip_rows = min(STRIP_ROWS[1], max(STRIP_ROWS[0], 16 * math.isqrt(n)))
    spread = vectors.select(F.posexplode("q").alias("pos", "x")).groupBy("pos").agg(F.var_pop("x").alias("v"))
    widest = spread.orderBy(F.desc("v"), "pos").select("pos").first()
    along = F.coalesce(F.get("q", F.lit(widest[0] if widest else 0)), F.lit(0.0))
    cut = vectors.withColumn("id", _id()).withColumn("along", along).repartitionByRange(-(-n // strip_rows) or 1, "along", F.xxhash64("row"))

    def pack(rows: Iterator[dict]) -> Iterator[tuple]:
        from pyspark import TaskContext

        own = list(rows)
        if not own:
            return
        matrix = _whole_vectors([r["q"] for r in own], dim)
        order = str_order(matrix)
        ids, numbers, labels = (np.array([r[c] for r in own], "<i8")[order].tobytes() for c in ("id", "row", "label"))
        yield TaskContext.get().partitionId(), len(own), packed(matrix[order]), ids, numbers, labels

    return store(map_rows(cut.select("id", "row", "label", "q"), pack, TREE), "trees")


def top_rows(queries: DataFrame, trees: DataFrame, dim: int, same: bool, k: int) -> DataFrame:
    """(query, score, id, nth) of the k first rows of each query (``QUERY``, one row each) over all strips."""
    strips = trees.agg(F.max("strip")).first()[0]  # there are trees: the queries are rows of them

    def block(rows: Iterator[dict]) -> Iterator[tuple]:
        held: list[dict] = []

        def out():
            whole = {c: np.array([r[c] for r in held], t).tobytes() for c, t in (("query", "<i8"), ("row", "<i8"), ("label", "<i8"), ("low", "<i8"), ("high", "<i8"))}
            return (whole["query"], whole["low"], whole["high"], packed(_whole_vectors([r["q"] for r in held], dim)), whole["row"], whole["label"])

        for row in rows:
            held.append(row)
            if len(held) == BLOCK:
                yield out()
                held = []
        if held:
            yield out()

    # queries of one anchor next to each other, blocks of like size
    blocks = map_rows(queries.repartition("row").sortWithinPartitions("row"), block, "queries binary, lows binary, highs binary, vectors binary, rows binary, labels binary")
    blocks = store(blocks, "queries")
    asked = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(strips))).alias("strip"), "*")
    dealt = trees.unionByName(asked, allowMissingColumns=True).repartition("strip").sortWithinPartitions("strip", F.col("count").isNull())

    def walk(rows: Iterator[dict]) -> Iterator[tuple]:
        tree, at = None, None
        for row in rows:
            as_long = lambda c: np.frombuffer(row[c], "<i8")  # noqa: B023, E731
            if row["count"] is not None:
                at, tree = row["strip"], Tree(unpacked(row["vectors"], dim) if dim else np.zeros((row["count"], 0)), as_long("ids"), as_long("rows"), as_long("labels"))
                continue
            if row["strip"] != at:
                continue  # a number without rows
            names = as_long("queries")
            vectors = unpacked(row["vectors"], dim) if dim else np.zeros((len(names), 0))
            found = search(tree, vectors, as_long("rows"), as_long("labels"), as_long("lows"), as_long("highs"), same, k)
            for q, score, place in zip(*found):
                yield int(names[q]), int(score), int(tree.ids[place]), int(tree.rows[place])

    found = map_rows(dealt, walk, "query long, score long, id long, found_row long")
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id", "found_row"))
    return found.withColumn("nth", nth).where(F.col("nth") <= k).select("query", "score", "id", "nth")


def hard_negatives(
    vectors: DataFrame,
    anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    window: tuple[int, int] = WINDOW,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of ``vectors`` (vec_id,
    embedding, label) for which ``anchor``, a condition on vec_id and label, holds.

    Rows with a null label or vector, or a component that is null or not finite, take no part. Components become
    floor(256 * x); a score is the integer inner product, ties go to the smaller vec_id (null last), then to the row read first. A
    positive is one of the first rows with the anchor's label, a negative one of the first of other labels with
    window[0] * positive <= 100 * negative <= window[1] * positive. Shorter vectors count as padded with zeros. A score beyond 64 bits
    counts as the nearest long. Rows are told apart by position: one that repeats its anchor, id included, is another row.
    A null vec_id is no anchor unless the condition says so. Pairs without a negative, and empty tables, give no rows.
    """
    spark = vectors.sparkSession
    rows = clean(vectors)
    dim = rows.agg(F.max(F.size("q"))).first()[0]
    if dim is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    trees = build_trees(rows, dim)
    anchors = store(rows.where(anchor), "anchors")
    ask = anchors.select(F.col("row").alias("query"), "row", "label", F.lit(LONG[0]).alias("low"), F.lit(LONG[1]).alias("high"), "q")
    found = top_rows(ask, trees, dim, True, positives)
    pairs = store(found.select(F.col("query").alias("row"), F.col("score").alias("positive_score"), F.col("id").alias("positive"), "nth"), "positives")

    # one search for each different score of an anchor's positives
    by_score = Window.partitionBy("row").orderBy("positive_score")
    pairs = pairs.withColumn("query", F.col("row") * positives + F.dense_rank().over(by_score) - 1)
    per_cent = lambda c: F.col("positive_score") * F.lit(c).cast("decimal(5,0)") / 100
    low, high = F.ceil(per_cent(window[0])).cast("long"), F.floor(per_cent(window[1])).cast("long")
    windows = pairs.groupBy("query", "row").agg(F.first("positive_score").alias("positive_score")).withColumn("low", low).withColumn("high", high)
    windows = windows.where("low <= high").join(anchors, "row").select("query", "row", "label", "low", "high", "q")
    near = top_rows(windows, trees, dim, False, negatives).select("query", F.col("score").alias("negative_score"), F.col("id").alias("negative"), F.col("nth").alias("rank"))
    real = lambda c, name: F.when(F.col(c) != NO_ID, F.col(c)).alias(name)
    return pairs.join(near, "query").join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row").select(
        "anchor_id", real("positive", "positive_id"), F.col("rank").cast("int").alias("rank"), real("negative", "negative_id"), "positive_score", "negative_score")
