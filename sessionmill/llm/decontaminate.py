"""Benchmark decontamination: every training passage is a query against a BM25 index of the test items.

Index: postings (term, item, impact) of the items, where an impact is the term's BM25 share of the item's score against
itself, so that one threshold fits all items. Document frequencies and lengths come from all items. The index
goes to the tasks in shards of at most ``SHARD_POSTINGS`` postings; more items mean more shards, each a pass over
the documents, with the same statistics and so the same scores.

Query: a document is cut into segments as long as the longest item; a passage is two neighbouring segments, so any
stretch of an item's length lies whole in some passage. Top scores are found as block-max WAND finds
them, for many passages at once in numpy: the most frequent terms, whose maxima together stay under half the
threshold, are not opened; the postings of the others are added up per (passage, item); for these candidates the
unopened terms add their maxima in the item's block; only what can still reach the threshold is scored in full.
The skipping is safe: exactly the items at or above the threshold are retrieved.

Check: an item counts as leaked when both its question (all sentences but the last) and its answer (the
last sentence; of a single sentence the last third; an item of fewer than ten words is a question alone) are covered, each to ``COVER`` of its words, by runs of five words
(or the whole part, if shorter) that the passage and its neighbourhood contain. In an item of ten words or more a part is
also covered by words that stand where the item's best place in the passage has them (``aligned``), to ``COVER`` or all
but one of at least two words: an edit in a short part breaks all its runs of five. A changed answer of one word is no
answer, and an item of fewer than ten words must keep its runs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionmill.llm import text as T
from sessionmill.llm.frames import empty_text, fresh_name, map_rows, md5_of, store

K1, B = 1.2, 0.75
THRESHOLD, COVER, RUN = 0.5, 0.7, 5
SLACK = 2  # words that an aligned word may be off its place
SHARD_POSTINGS = 500_000
BLOCK = 16
BATCH_WORDS = 1 << 15
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def question_and_answer(item: str) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the two parts of an item."""
    parts = [h for h in (T.words(p.lower())[0] for p in _SENTENCE.split(item)) if len(h)]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    if sum(map(len, parts)) < 2 * RUN:
        return np.concatenate(parts), parts[0][:0]
    if len(parts) > 1:
        return np.concatenate(parts[:-1]), parts[-1]
    cut = len(parts[0]) - max(1, len(parts[0]) // 3)
    return parts[0][:cut], parts[0][cut:]


def coverage(part: np.ndarray, passage: np.ndarray) -> float:
    """Share of the part's words that lie in a run of RUN words found in the passage; an empty part is covered."""
    if not len(part):
        return 1.0
    n = min(RUN, len(part))
    if len(passage) < n:
        return 0.0
    found = np.isin(_runs(part, n), _runs(passage, n))
    covered = np.zeros(len(part) + 1, int)
    np.add.at(covered, np.flatnonzero(found), 1)
    np.add.at(covered, np.flatnonzero(found) + n, -1)
    return float((np.cumsum(covered)[:-1] > 0).mean())


def aligned(item: np.ndarray, passage: np.ndarray) -> np.ndarray:
    """For each word of the item whether the passage has it where the item fits best, or up to SLACK words beside."""
    votes = np.zeros(len(item) + len(passage), int)  # by the place of the item's first word
    step = max(1, (1 << 22) // len(passage))
    for at in range(0, len(item), step):
        word, place = np.nonzero(item[at:at + step, None] == passage)
        votes += np.bincount(place - word - at + len(item), minlength=len(votes))
    found = np.zeros(len(item), bool)
    start = int(votes.argmax()) - len(item)
    for place in (np.arange(len(item)) + start + k for k in range(-SLACK, SLACK + 1)):
        inside = (place >= 0) & (place < len(passage))
        found[inside] |= passage[place[inside]] == item[inside]
    return found


def covered(question: np.ndarray, answer: np.ndarray, passage: np.ndarray) -> tuple[float, float] | None:
    """Shares of the two parts that the passage covers, by runs or aligned words; None where a part is not covered."""
    parts = [question, answer]
    shares = [coverage(p, passage) for p in parts]
    if min(shares) < COVER and len(question) + len(answer) >= 2 * RUN:
        found = np.split(aligned(np.concatenate(parts), passage), [len(question)])
        for k, (part, f) in enumerate(zip(parts, found)):
            if shares[k] < COVER and (f.mean() >= COVER or len(part) > 1 and f.sum() >= len(part) - 1):
                shares[k] = max(shares[k], float(f.mean()))
                parts[k] = part[:0]
    return tuple(shares) if all(s >= COVER or not len(p) for s, p in zip(shares, parts)) else None


def _runs(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words, whatever the length of the text."""
    return T.ngrams(h, n) if len(h) > n else T.ngrams(h[:n], n)


def _postings(stream):
    for row in stream:
        term, tf = np.unique(T.words(row["text"].lower())[0], return_counts=True)
        for t, n in zip(T.as_long(term).tolist(), tf.tolist()):
            yield row["item_id"], t, n, int(tf.sum())


class Index:
    """One shard of the index, as arrays."""

    def __init__(self, rows: list, texts: dict[int, str], longest: int, threshold: float):
        self.threshold, self.segment = threshold, max(1, longest)
        self.items = sorted({r["item_id"] for r in rows})
        place = {k: i for i, k in enumerate(self.items)}
        item = np.array([place[r["item_id"]] for r in rows])
        term = np.array([r["term"] for r in rows], np.int64).view(np.uint64)
        impact = np.array([r["impact"] for r in rows])
        order = np.lexsort((item, term))
        self.item, self.impact = item[order], impact[order]
        self.terms, self.start = np.unique(term[order], return_index=True)
        self.count = np.diff([*self.start, len(self.item)])
        # the terms left unopened: most frequent first, as long as their maxima stay under half the threshold
        top = np.maximum.reduceat(self.impact, self.start)
        frequent = np.lexsort((self.terms, -self.count))
        unopened = frequent[np.cumsum(top[frequent]) < threshold / 2]
        self.opened = np.ones(len(self.terms), bool)
        self.opened[unopened] = False
        self.row = np.full(len(self.terms), -1)
        self.row[unopened] = np.arange(len(unopened))
        self.block_max = np.zeros((len(unopened), -(-len(self.items) // BLOCK)))
        for r, t in enumerate(unopened):
            at = slice(self.start[t], self.start[t] + self.count[t])
            np.maximum.at(self.block_max[r], self.item[at] // BLOCK, self.impact[at])
        by_item = np.lexsort((term, item))
        cut = np.searchsorted(item[by_item], np.arange(len(self.items) + 1))
        self.own = [(term[by_item[a:b]], impact[by_item[a:b]]) for a, b in zip(cut, cut[1:])]
        self.parts = [question_and_answer(texts[k]) for k in self.items]

    def lookup(self, words: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.terms, words)
        at[at == len(self.terms)] = 0
        return np.where(self.terms[at] == words, at, -1)

    def candidates(self, term: np.ndarray, segment: np.ndarray, follows: np.ndarray) -> Iterator[tuple[int, int]]:
        """(passage, item) that can reach the threshold. term, segment: of each known word; follows[s]: segment
        s + 1 belongs to the same document, so passage s is both."""
        before = segment > 0
        before[before] = follows[segment[before] - 1]
        pair = np.unique(np.concatenate([segment, segment[before] - 1]) * len(self.terms) + np.concatenate([term, term[before]]))
        passage, term = pair // len(self.terms), pair % len(self.terms)  # each term once in a passage
        use = self.opened[term]
        t, s = term[use], passage[use]
        n = self.count[t]
        posting = np.repeat(self.start[t] - np.cumsum(n) + n, n) + np.arange(n.sum())
        key, part = _sums(np.repeat(s, n) * len(self.items) + self.item[posting], self.impact[posting], len(follows) * len(self.items))
        near = part >= self.threshold / 2  # the unopened terms cannot make up for more
        key, part = key[near], part[near]
        s, i = key // len(self.items), key % len(self.items)
        rest = np.zeros((len(follows), self.block_max.shape[1]))
        wanted = np.zeros(len(follows), bool)
        wanted[s] = True
        more = ~use & wanted[passage]
        np.add.at(rest, passage[more], self.block_max[self.row[term[more]]])
        can = part + rest[s, i // BLOCK] >= self.threshold - 1e-9
        yield from zip(s[can].tolist(), i[can].tolist())


def _sums(key: np.ndarray, value: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Different keys (below ``size``) and the sum of their values."""
    if size <= 1 << 23:
        total = np.bincount(key, value, size)
        key = np.flatnonzero(total)
        return key, total[key]
    key, back = np.unique(key, return_inverse=True)
    return key, np.bincount(back, value, len(key))


def _searcher(index: Index, names: dict[int, int | None]):
    def run(stream):
        held, total = [], 0
        for row in stream:
            h = T.words(row["text"].lower())[0]
            if len(h):
                held.append((row["doc_id"], row["digest"], h))
                total += len(h)
            if total >= BATCH_WORDS:
                yield from search(held)
                held, total = [], 0
        if held:
            yield from search(held)

    def search(held):
        size = index.segment
        segments = [-(-len(h) // size) for _, _, h in held]
        first = np.cumsum([0, *segments])
        words = np.concatenate([h for _, _, h in held])
        segment = np.concatenate([f + np.arange(len(h)) // size for f, (_, _, h) in zip(first, held)])
        follows = np.ones(first[-1], bool)
        follows[first[1:] - 1] = False
        term = index.lookup(words)
        known = term >= 0
        best = {}
        for s, i in index.candidates(term[known], segment[known], follows):
            doc = int(np.searchsorted(first, s, "right")) - 1
            h, at = held[doc][2], (s - first[doc]) * size
            passage = h[at:at + 2 * size]
            own_terms, own_impact = index.own[i]
            score = float(own_impact[np.isin(own_terms, passage)].sum())
            if score < index.threshold - 1e-9:
                continue
            around = h[max(0, at - size):at + 3 * size]
            if score > best.get((doc, i), (0,))[0] and (shares := covered(*index.parts[i], around)):
                best[doc, i] = (score, *shares, int(at), int(min(len(h), at + 2 * size)))
        for (doc, i), found in best.items():
            yield (*held[doc][:2], names[index.items[i]], *found)
    return run


FOUND = "doc_id long, digest string, item_id long, score double, question_cover double, answer_cover double, first_word long, end_word long"


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """One row per leaked item of each row of ``docs`` (doc_id, text): FOUND, with the best passage's place in words.

    ``items``: (item_id, text). Items without words or null never match. Each distinct (item_id, text) is an item of its own,
    so an id that names several texts, or null, may have several rows for a document. Items of one to four words
    match wherever these words follow each other, in clean documents too. Documents that are null or without
    words match nothing. No documents or no items give no rows.
    """
    spark = docs.sparkSession
    named = items.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("name"), "text").distinct()
    known = store(named.withColumn("item_id", F.monotonically_increasing_id()), "items")  # from here a key of each text
    postings = store(map_rows(known, _postings, "item_id long, term long, tf long, length long"), "postings")
    lengths = postings.select("item_id", "length").distinct()
    stats = lengths.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), F.max("length").alias("longest")).first()
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), empty_text().alias("text")).withColumn("digest", md5_of(F.col("text")))
    out = spark.createDataFrame([], FOUND)
    if not stats["n"]:
        return out
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log1p((F.lit(stats["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(stats["mean"])))
    weighed = postings.join(df, "term").withColumn("w", weight)
    total = weighed.groupBy("item_id").agg(F.sum("w").alias("self"))
    scored = store(weighed.join(total, "item_id").select("item_id", "term", (F.col("w") / F.col("self")).alias("impact")), "impacts")
    shards = -(-scored.count() // shard_postings)
    for k in range(shards):
        mine = F.pmod(F.xxhash64("item_id"), F.lit(shards)) == k
        rows = scored.where(mine).collect()
        if rows:
            mine = known.where(mine).select("item_id", "text", "name").collect()
            index = Index(rows, {r["item_id"]: r["text"] for r in mine}, stats["longest"], threshold)
            out = out.unionByName(map_rows(plain, _searcher(index, {r["item_id"]: r["name"] for r in mine}), FOUND))
    return out


def drop_leaked(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that leak no item, with all their columns."""
    bad = store(leaks(docs, items, **options).select("doc_id", "digest").distinct(), "leaks")
    mark = fresh_name(docs, "digest_")
    marked = docs.withColumn(mark, md5_of(empty_text()))
    bad = bad.select(F.col("doc_id").alias("bad_id"), F.col("digest").alias("bad_digest"))
    clean = marked.join(bad, marked["doc_id"].eqNullSafe(F.col("bad_id")) & (F.col(mark) == F.col("bad_digest")), "left_anti")
    return clean.select(*[F.col(f"`{c}`") for c in docs.columns])
