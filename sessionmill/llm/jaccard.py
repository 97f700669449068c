"""N-gram Jaccard join: MinHash banding finds candidates, full n-gram sets decide.

Words are lower-cased runs of letters and digits; a text's set holds the hashes of its runs of five words (a shorter
text is one run, a text without words has none and links to nothing). Two different texts are linked when
the Jaccard similarity of their sets reaches the threshold.

Plan, in tables written to the shared folder:

1. one scan hashes every document: text digest, set size, one key for each band;
2. equal texts become one representative;
3. band keys met by one representative only go; of several buckets with the same members one stays;
4. candidates get their full sets, buckets are cut into blocks of bounded size, and each pair of blocks of a bucket is
   compared by matrix products in one task. A pair that meets in several buckets counts in the first;
5. a block pair reports one row per text: its links and one tree edge. Pairs are never written out, so
   a group of many near copies costs rows in proportion to its members;
6. connected components of the tree edges give the classes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionmill.llm import text as T
from sessionmill.llm.frames import components, empty_text, keep_rows, map_rows, md5_of, store, streamed_groups

WORDS, SIMILARITY, RECALL = 5, 0.8, 0.9995
BLOCK_TEXTS, BLOCK_NGRAMS = 256, 1 << 18
SIGN = 1 << 15  # n-grams hashed at once


def choose_bands(similarity: float = SIMILARITY, recall: float = RECALL, most: int = 128) -> tuple[int, int]:
    """(bands, rows): the most selective banding within ``most`` hashes that finds a pair just at the
    threshold with probability ``recall``; 1 - (1 - s**rows)**bands grows with s, so closer pairs fare better."""
    for rows in range(16, 0, -1):
        bands = int(np.ceil(np.log(1 - recall) / np.log1p(-similarity ** rows)))
        if bands * rows <= most:
            return bands, rows
    return most, 1


def ngram_set(text: str, n: int = WORDS) -> np.ndarray:
    return np.unique(T.ngrams(T.words(text.lower())[0], n))


def _seeds(count: int) -> np.ndarray:
    return T.mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def band_keys(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """(texts, bands) keys from the minima of bands * rows hash functions over each non-empty set."""
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1]
    keys = np.zeros((len(sets), bands), np.uint64)
    for k, seed in enumerate(_seeds(bands * rows)):
        h = flat * seed
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        low = np.minimum.reduceat(h, starts)
        band = k // rows
        keys[:, band] = T.mix(keys[:, band] * np.uint64(0x2545F4914F6CDD1D) + low + np.uint64(band + 1))
    return keys


def _signer(n: int, bands: int, rows: int):
    def run(stream):
        held, size = [], 0

        def out():
            sets = [s for _, _, s in held if len(s)]
            keys = iter(T.as_long(band_keys(sets, bands, rows)).tolist() if sets else [])
            for doc_id, digest, s in held:
                yield doc_id, digest, len(s), next(keys) if len(s) else []

        for row in stream:
            s = T.ngrams(T.words(row["text"].lower())[0], n)
            held.append((row["doc_id"], row["digest"], s))
            size += len(s)
            if size >= SIGN or len(held) >= 2048:
                yield from out()
                held, size = [], 0
        yield from out()
    return run


def _setter(n: int):
    def run(stream):
        for row in stream:
            yield row["tid"], row["keys"], T.as_long(ngram_set(row["text"], n)).tobytes()
    return run


def _common(left: list[np.ndarray], right: list[np.ndarray], step: int = 8192) -> np.ndarray:
    """Sizes of all intersections between two lists of sets of distinct numbers, by products of 0/1 matrices."""
    sizes = [len(s) for s in left], [len(s) for s in right]
    out = np.zeros((len(left), len(right)), np.float32)
    a, b = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(a, b)  # only these can count
    pa, pb = np.searchsorted(shared, a), np.searchsorted(shared, b)
    pa[pa == len(shared)], pb[pb == len(shared)] = 0, 0
    ra, rb = np.repeat(np.arange(len(left)), sizes[0]), np.repeat(np.arange(len(right)), sizes[1])
    if not len(shared):
        return out
    ina, inb = shared[pa] == a, shared[pb] == b
    ra, pa, rb, pb = ra[ina], pa[ina], rb[inb], pb[inb]
    for at in range(0, len(shared), step):
        width = min(step, len(shared) - at)
        x, y = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        here = (pa >= at) & (pa < at + width)
        x[ra[here], pa[here] - at] = 1
        here = (pb >= at) & (pb < at + width)
        y[rb[here], pb[here] - at] = 1
        out += x @ y.T
    return out


def _linker(similarity: float):
    """Links inside each (bucket, block pair): per text the number of its links and a tree edge to its group."""
    def run(stream):
        for group in streamed_groups(stream, "bucket", "i", "j"):
            bucket, diagonal = group[0]["bucket"], group[0]["i"] == group[0]["j"]
            left = group if diagonal else [r for r in group if r["s"] == group[0]["i"]]
            right = group if diagonal else [r for r in group if r["s"] == group[0]["j"]]
            if not left or not right or diagonal and len(left) < 2:
                continue
            sets = [[np.frombuffer(r["ngrams"], np.int64) for r in side] for side in (left, right)]
            na, nb = (np.array([len(s) for s in side], np.float32) for side in sets)
            both = _common(*sets)
            linked = both >= (similarity - 1e-9) * (na[:, None] + nb[None] - both)
            earlier = [[np.array([k for k in r["keys"] if k < bucket], np.int64) for r in side] for side in (left, right)]
            linked &= _common(*earlier) == 0
            if diagonal:
                np.fill_diagonal(linked, False)
            yield from _report([r["tid"] for r in left], [r["tid"] for r in right], linked, diagonal)
    return run


def _report(left: list[int], right: list[int], linked: np.ndarray, diagonal: bool):
    ids = sorted({*left, *right})
    place = {t: k for k, t in enumerate(ids)}
    pl, pr = np.array([place[t] for t in left]), np.array([place[t] for t in right])
    links = np.zeros(len(ids), np.int64)
    links[pl] += linked.sum(axis=1)
    if not diagonal:
        links[pr] += linked.sum(axis=0)
    a, b = np.nonzero(linked)
    a, b = pl[a], pr[b]
    root = np.arange(len(ids))
    while True:  # smallest label spreads along the links, with pointer jumps
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        np.minimum.at(low, root, low)
        low = low[low]
        if (low == root).all():
            break
        root = low
    for k in np.flatnonzero(links):
        yield ids[k], int(links[k]), ids[root[k]]


def distinct_buckets(met: DataFrame) -> DataFrame:
    """(bucket, blocks) of ``met`` (tid, n, bucket): buckets of several members, one of those with the same members, which
    would only repeat the comparison. There are never more blocks than members, however long the texts."""
    m1, m2 = (F.bit_xor(F.xxhash64(F.lit(k), "tid")) for k in (1, 2))  # cannot overflow; a text is in a bucket once
    full = met.groupBy("bucket").agg(F.count("*").alias("members"), F.sum("n").alias("size"), m1.alias("m1"), m2.alias("m2")).where("members > 1")
    once = full.groupBy("members", "size", "m1", "m2").agg(F.min("bucket").alias("bucket"))
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK_TEXTS), F.ceil(F.col("size") / BLOCK_NGRAMS))
    return once.select("bucket", F.least("members", blocks).cast("int").alias("blocks"))


def near_duplicates(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, digest, root, class_id, n_links, n_copies.

    root: a number of the near-duplicate class (texts connected by links; equal texts belong together), any but
    one per class. class_id: the class's smallest doc_id.
    n_links: different texts linked to this row's text. n_copies: rows with exactly this text.
    Null counts as empty text; equal empty texts form a class of their own, without links. A class whose ids are
    all null has a null class_id. No rows give no rows; other columns are not looked at.
    """
    spark = docs.sparkSession
    bands, rows = choose_bands(similarity, recall)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), empty_text().alias("text")).withColumn("digest", md5_of(F.col("text")))
    signed = store(map_rows(plain, _signer(words, bands, rows), "doc_id long, digest string, n long, keys array<long>"), "signed")
    texts = signed.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_copies"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    texts = store(texts.withColumn("tid", F.monotonically_increasing_id()), "texts")

    met = texts.select("tid", "n", F.posexplode("keys").alias("band", "bucket"))
    once = store(distinct_buckets(met), "buckets")
    places = store(met.join(once, "bucket").select("tid", "bucket", "blocks"), "places")

    keys = places.groupBy("tid").agg(F.sort_array(F.collect_list("bucket")).alias("keys"))  # at most one per band
    owner = texts.select("tid", "digest", "first_id").join(keys, "tid")
    same = Window.partitionBy("tid").orderBy(F.lit(0))
    chosen = plain.join(owner.withColumnRenamed("digest", "d"), (F.col("digest") == F.col("d")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
    chosen = chosen.withColumn("row", F.row_number().over(same)).where("row = 1").select("tid", "keys", "text")
    sets = store(map_rows(chosen, _setter(words), "tid long, keys array<long>, ngrams binary"), "sets")

    block = F.pmod(F.xxhash64("tid", "bucket"), F.col("blocks")).cast("int")
    dealt = places.withColumn("s", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("tid", "bucket", "s", F.least("s", "other").alias("i"), F.greatest("s", "other").alias("j"))
    met_sets = dealt.join(sets, "tid").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "tid")
    found = store(map_rows(met_sets, _linker(similarity), "tid long, links long, root long"), "links")

    links = found.groupBy("tid").agg(F.sum("links").alias("n_links"))
    group = components(found.select(F.col("tid").alias("a"), F.col("root").alias("b")))
    classed = texts.join(group.withColumnRenamed("node", "tid"), "tid", "left").join(links, "tid", "left")
    classed = classed.select("digest", "first_id", "n_copies", F.coalesce("root", "tid").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    ids = classed.groupBy("root").agg(F.min("first_id").alias("class_id"))
    classed = store(classed.join(ids, "root").select("digest", "root", "class_id", "n_links", "n_copies"), "classes")
    return signed.select("doc_id", "digest").join(classed, "digest")


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, one for each near-duplicate class (its smallest doc_id), with all their columns."""
    found = near_duplicates(docs, **options).where(F.col("doc_id").eqNullSafe(F.col("class_id")))
    # an id may name several texts of a class: the smallest digest stays
    kept = found.groupBy("root").agg(F.first("doc_id").alias("doc_id"), F.min("digest").alias("digest"))
    return keep_rows(docs, kept)
