"""Substring deduplication with repeated-phrase automata.

A word of a document is removed when a window of ``WINDOW`` words covers it whose word sequence also starts in a document of a
smaller id. Comparing all windows would move every word many times; instead:

1. Seeds. Of the phrases of ``PHRASE`` words in a window the one with the least hash is its seed. Equal windows have equal
   seeds, so a window can only recur if its seed does. One scan notes each text's seeds, about two for each 35 words.
2. Phrases. Seeds met in two different texts are confirmed; the text with the smallest id owns the phrase and spells it.
   Phrases are dealt to shards by their owner, so the copies of a text need few shards.
3. Automata. Each shard compiles its phrases into an Aho-Corasick automaton over word numbers and streams all
   documents that have one of them; popular shards are compiled in several tasks that share the documents.
4. Windows whose seed the automaton located are compared by 96-bit hashes over the corpus (smallest id per window,
   by partial minima), and each document loses what its recurring windows cover.

Equal texts are one text of the smallest id; the copies lose everything if they fill a window.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionmill.llm import text as T
from sessionmill.llm.frames import empty_text, map_rows, md5_of, store

WINDOW, PHRASE = 50, 17
SHARD_PHRASES = 4_000
TASK_TEXTS = 1_000


def split(text: str) -> list[bytes]:
    """Runs of anything but ASCII white space, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split()


def window_seeds(word_hashes: np.ndarray, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each phrase, seed of each window); empty for texts shorter than a window."""
    if len(word_hashes) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    phrases = T.ngrams(word_hashes, phrase)
    low, done, span = phrases, 1, window - phrase + 1
    while done < span:  # minima over doubling spans
        step = min(done, span - done)
        low = np.minimum(low[:-step], low[step:])
        done += step
    return phrases, low


def _scan(window: int, phrase: int):
    def run(stream):
        for row in stream:
            parts = split(row["text"])
            seeds = []
            if len(parts) >= window:
                seeds = T.as_long(np.unique(window_seeds(T.words(row["text"], False)[0], window, phrase)[1])).tolist()
            yield row["doc_id"], row["digest"], len(parts), hashlib.sha256(b" ".join(parts)).hexdigest(), seeds
    return run


def _numbers(word_hashes: np.ndarray) -> np.ndarray:
    """Words as 31-bit letters of the automata."""
    return (word_hashes >> np.uint64(33)).astype(np.int64)


def _spell(window: int, phrase: int):
    """The owned phrases of a text as letters."""
    def run(stream):
        for row in stream:
            h = T.words(row["text"], False)[0]
            hashes = T.as_long(window_seeds(h, window, phrase)[0])
            _, at = np.unique(hashes, return_index=True)
            letters = _numbers(h)
            for seed, k in zip(hashes[at], at):
                if seed in row["_seeds"]:
                    yield row["shard"], letters[k:k + phrase].tolist()

    def with_sets(stream):
        def rows():
            for row in stream:
                yield {**row, "_seeds": set(row["seeds"])}
        return run(rows())
    return with_sets


def _locate(window: int, phrase: int):
    """Phrases first, then texts, shard by shard: the candidate windows of each text, by two hashes."""
    def run(stream):
        import ahocorasick

        part, automaton, ready = None, None, False
        for row in stream:
            if (row["shard"], row["salt"]) != part:
                part, ready = (row["shard"], row["salt"]), False
                automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
            if row["text"] is None:
                automaton.add_word(tuple(row["phrase"]), 1)
                continue
            if not ready:
                automaton.make_automaton()
                ready = True
            h = T.words(row["text"], False)[0]
            ends = np.array([end for end, _ in automaton.iter(tuple(_numbers(h).tolist()))], np.int64)
            if not len(ends):
                continue
            phrases, seeds = window_seeds(h, window, phrase)
            at = np.flatnonzero(np.isin(seeds, phrases[ends - phrase + 1]))
            if len(at):
                first, second = T.ngrams(h, window)[at], T.ngrams(T.mix(h ^ np.uint64(0x5851F42D4C957F2D)), window)[at]
                yield row["tid"], row["first_id"], at.tolist(), T.as_long(first).tolist(), (second >> np.uint64(33)).astype(np.int64).tolist()
    return run


def _cut(window: int):
    def run(stream):
        for row in stream:
            parts = split(row["text"])
            edge = np.zeros(len(parts) + 1, np.int64)
            starts = np.unique(np.array(row["starts"], np.int64))
            edge[starts] += 1
            edge[starts + window] -= 1
            kept = np.cumsum(edge)[:-1] == 0
            text = b" ".join(compress(parts, kept.tolist()))
            yield row["digest"], len(parts) - int(kept.sum()), hashlib.sha256(text).hexdigest(), text.decode("utf-8", "surrogatepass")
    return run


def _per_text(rows: DataFrame, texts: DataFrame, cuts: DataFrame, how: str) -> DataFrame:
    """The rows with what is known of their text; stored before, so that a text with many copies can be split in the join."""
    known = store(texts.join(cuts, "digest", "left"), "known")
    return rows.drop("seeds").join(known, "digest", how)


def recurring(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, shard_phrases: int = SHARD_PHRASES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, texts, cuts): every row of ``docs`` with its words counted and hashed; the different texts; and for each
    text with recurring windows (digest, n_removed, sha, kept text)."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), empty_text().alias("text")).withColumn("digest", md5_of(F.col("text")))
    rows = store(map_rows(plain, _scan(window, phrase), "doc_id long, digest string, n_words long, sha string, seeds array<long>"), "scanned")
    texts = rows.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.first("seeds").alias("seeds"))
    texts = store(texts.withColumn("tid", F.monotonically_increasing_id()), "texts")

    seeds = texts.select("tid", "first_id", F.explode("seeds").alias("seed"))
    met = seeds.groupBy("seed").agg(F.count("*").alias("n"), F.min(F.struct("first_id", "tid")).alias("owner")).where("n > 1")
    met = store(met.select("seed", F.col("owner.tid").alias("owner")), "phrases")
    shards = max(1, -(-met.count() // shard_phrases))
    shard = F.pmod(F.xxhash64("owner"), F.lit(shards)).cast("int").alias("shard")
    routes = store(seeds.join(met.select("seed", shard), "seed").groupBy("tid", "shard").agg(F.count("*").alias("n")), "routes")
    owned = met.groupBy(F.col("owner").alias("tid"), shard).agg(F.collect_list("seed").alias("seeds"))  # a text's own seeds

    wanted = texts.select("tid", F.col("digest").alias("d"), "first_id").join(routes.select("tid").distinct(), "tid")
    chosen = plain.join(wanted, (F.col("digest") == F.col("d")) & (F.col("doc_id") == F.col("first_id")))
    once = F.row_number().over(Window.partitionBy("tid").orderBy(F.lit(0)))
    chosen = store(chosen.withColumn("k", once).where("k = 1").select("tid", "first_id", "digest", "text"), "chosen")

    spelled = map_rows(chosen.select("tid", "text").join(owned, "tid"), _spell(window, phrase), "shard int, phrase array<long>")
    salts = routes.groupBy("shard").agg(F.ceil(F.count("*") / TASK_TEXTS).cast("int").alias("salts"))
    dealt = routes.select("tid", "shard").join(salts, "shard").join(chosen.select("tid", "first_id", "text"), "tid")
    dealt = dealt.select("shard", F.pmod(F.xxhash64("tid"), F.col("salts")).cast("int").alias("salt"), "tid", "first_id", "text", F.lit(None).cast("array<long>").alias("phrase"))
    letters = spelled.join(salts, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    letters = letters.select("shard", "salt", F.lit(None).cast("long").alias("tid"), F.lit(None).cast("long").alias("first_id"), F.lit(None).cast("string").alias("text"), "phrase")
    both = letters.unionByName(dealt).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.asc_nulls_first("tid"))
    located = map_rows(both, _locate(window, phrase), "tid long, first_id long, starts array<int>, h1 array<long>, h2 array<int>")
    windows = located.select("tid", "first_id", F.inline(F.arrays_zip("starts", "h1", "h2")))
    windows = store(windows, "windows")

    # stored, so that the join below has its own exchange, whose hot windows adaptive execution can split
    first = windows.groupBy("h1", "h2").agg(F.min("first_id").alias("lo"), F.max("first_id").alias("hi")).where("lo < hi").drop("hi")
    first = store(first, "first")
    again = windows.join(first, ["h1", "h2"]).where(F.col("first_id") > F.col("lo"))
    starts = again.groupBy("tid").agg(F.collect_list("starts").alias("starts"))  # at most one per word of the text
    cuts = store(map_rows(chosen.join(starts, "tid").select("digest", "text", "starts"), _cut(window), "digest string, n_removed long, kept_sha string, kept_text string"), "cuts")
    return rows, texts.select("digest", "first_id"), cuts


def removed_words(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, shard_phrases: int = SHARD_PHRASES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row of ``docs`` (doc_id, text).

    Null text counts as empty: no words. Rows with a null id neither remove nor lose words. Rows that repeat an id
    do not remove each other's words. No rows give no rows; other columns are not looked at.
    """
    rows, texts, cuts = recurring(docs, window, phrase, shard_phrases)
    found = _per_text(rows, texts, cuts.drop("kept_text"), "left")
    copy = (F.col("doc_id") > F.col("first_id")) & (F.col("n_words") >= window)
    own = F.col("doc_id").isNotNull() & F.col("n_removed").isNotNull()
    return found.select(
        "doc_id", "n_words", F.when(copy, F.col("n_words")).when(own, F.col("n_removed")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).when(own, F.col("kept_sha")).otherwise(F.col("sha")).alias("kept_sha256"))


def kept_texts(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, text) for the rows that lose words: what is left of them, words joined by one space."""
    rows, texts, cuts = recurring(docs, **options)
    window = options.get("window", WINDOW)
    found = _per_text(rows, texts, cuts, "inner")
    copy = (F.col("doc_id") > F.col("first_id")) & (F.col("n_words") >= window)
    return found.where(copy | F.col("n_removed").isNotNull()).select("doc_id", F.when(copy, F.lit("")).otherwise(F.col("kept_text")).alias("text"))
