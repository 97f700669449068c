"""Retrieval against full BM25 scoring, and leaks planted in documents."""

import math
import random
import re

from sessionmill.llm import decontaminate as D
from sessionmill.llm import text as T
from tests.llm.conftest import prose

ITEMS = "item_id long, text string"


def items_of(rng, n, words=300):
    return [(k, ". ".join(prose(rng, rng.randrange(4, 16), words).capitalize() for _ in range(rng.randrange(1, 4))) + ".") for k in range(n)]


def test_planted_leaks_are_found_and_clean_documents_left(spark, make, odd_rows):
    rng = random.Random(1)
    items = items_of(rng, 30)
    rows, want = [], set()
    for i in range(100, 180):
        words = prose(rng, rng.randrange(0, 300)).split()
        if i % 3 == 0:
            k, text = rng.choice(items)
            at = rng.randrange(len(words) + 1)
            words[at:at] = (text.upper() if i % 2 else text).split()
            want.add((i, k))
        rows.append((i, " ".join(words)))
    table = spark.createDataFrame([*items, (90, None), (91, ""), (None, "x y z w v u")], ITEMS)
    for shard in (40, 10**6):
        got = D.leaks(make([*rows, *odd_rows]), table, shard_postings=shard).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want
    kept = D.drop_leaked(make([*rows, *odd_rows]), table)
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(i) for i, _ in [*rows, *odd_rows] if i not in dict(want))
    assert kept.columns == make(rows[:1]).columns


def test_half_an_item_is_no_leak(spark, make):
    item = "the quick brown fox jumps over the lazy dog near the river bank today. it was number seven hundred."
    items = spark.createDataFrame([(1, item)], ITEMS)
    question, answer = item.split(". ")
    rows = [(1, f"so {item} and"), (2, f"so {question} and more"), (3, f"only {answer} here"), (4, item.replace("fox", "cat"))]
    assert sorted(r.doc_id for r in D.leaks(make(rows), items).collect()) == [1, 4]


def test_any_word_of_an_item_may_be_changed(spark, make):
    """Every single-word substitution, of items with short answers, short questions and of one sentence."""
    rng = random.Random(3)
    sizes = {1: (46, 5), 2: (9, 3), 3: (12, 9), 4: (5, 5), 5: (11,), 6: (16, 2)}
    items = [(k, ". ".join(prose(rng, n) for n in parts) + ".") for k, parts in sizes.items()]
    rows, want = [], set()
    for k, text in items:
        words = text.split()
        for at in range(len(words)):
            changed = [*words[:at], "other." if words[at].endswith(".") else "other", *words[at + 1:]]
            want.add((1000 * k + at, k))
            rows.append((1000 * k + at, f"{prose(rng, 40)} {' '.join(changed)} {prose(rng, 40)}"))
        rows.append((100 + k, f"{prose(rng, 40)} {text.split('. ')[0]} {prose(rng, 40)}"))
    got = D.leaks(make(rows), spark.createDataFrame(items, ITEMS)).collect()
    one_sentence = {(100 + k, k) for k, n in sizes.items() if len(n) == 1}
    assert {(r.doc_id, r.item_id) for r in got} == want | one_sentence


def test_aligned_words():
    item = T.words("a b c d e f g h i j")[0]
    assert D.aligned(item, T.words("x y a b c Q d e f g h i j z")[0]).all()  # a word put in
    assert D.aligned(item, T.words("c d e f g h Q j")[0]).tolist() == [False, False, *[True] * 6, False, True]
    assert not D.aligned(item, T.words("x y")[0]).any()


def test_a_short_item_must_occur_as_it_is(spark, make):
    items = spark.createDataFrame([(1, "Of it. The end."), (2, "Is.")], ITEMS)
    rows = [(1, "the sum of it the end came"), (2, "end of the line it was"), (3, "the end of it"), (4, "so it is")]
    assert sorted((r.doc_id, r.item_id) for r in D.leaks(make(rows), items).collect()) == [(1, 1), (4, 2)]


def test_ids_that_name_several_texts_or_none(spark, make):
    rng = random.Random(4)
    texts = [prose(rng, 20) for _ in range(4)]
    items = spark.createDataFrame([*zip((1, 1, None, None), texts), (1, texts[0])], ITEMS)
    docs = make([*enumerate(texts), (4, " ".join(texts[:2])), (5, prose(rng, 50))])
    for shard in (20, 10**6):
        got = sorted((r.doc_id, r.item_id or 0) for r in D.leaks(docs, items, shard_postings=shard).collect())
        assert got == [(0, 1), (1, 1), (2, 0), (3, 0), (4, 1), (4, 1)]
    assert [r.doc_id for r in D.drop_leaked(docs, items).collect()] == [5]


def test_very_short_items_drop_clean_documents(spark, make):
    items = spark.createDataFrame([(1, "Of the."), (2, "Is.")], ITEMS)
    rows = [(1, "the end of the line"), (2, "so it is"), (3, "the end of a line")]
    assert [r.doc_id for r in D.drop_leaked(make(rows), items).collect()] == [3]


def test_no_rows(spark, make):
    items = spark.createDataFrame([(1, "some item text here")], ITEMS)
    assert D.leaks(make([]), items).count() == 0
    assert D.leaks(make([(1, "some item text here")]), items.limit(0)).count() == 0
    assert D.drop_leaked(make([(1, "some item text here")]), items.limit(0)).count() == 1


def test_skipping_never_loses_an_item_above_the_threshold():
    """Candidates against BM25 by the book, over all passages and items."""
    rng = random.Random(6)
    items = items_of(rng, 60, words=40)  # few words, much overlap
    split = lambda t: re.findall(r"[^\W_]+", t.lower())
    tokens = {k: split(t) for k, t in items}
    mean = sum(map(len, tokens.values())) / len(items)
    df = {w: sum(w in set(t) for t in tokens.values()) for t in tokens.values() for w in t}

    def weight(k, w):
        tf, length = tokens[k].count(w), len(tokens[k])
        return math.log1p((len(items) - df[w] + 0.5) / (df[w] + 0.5)) * tf * (D.K1 + 1) / (tf + D.K1 * (1 - D.B + D.B * length / mean))

    number = {w: int(T.as_long(T.words(w)[0])[0]) for w in df}
    self_ = {k: sum(weight(k, w) for w in set(t)) for k, t in tokens.items()}
    rows = [{"item_id": k, "term": number[w], "impact": weight(k, w) / self_[k]} for k, t in tokens.items() for w in set(t)]
    longest = max(map(len, tokens.values()))
    for threshold in (0.3, 0.5, 0.7):
        index = D.Index(rows, dict(items), longest, threshold)
        text = prose(rng, 900, 60)
        words = split(text)
        h = T.words(text)[0]
        segment = [k // longest for k in range(len(h))]
        term = index.lookup(h)
        import numpy as np

        follows = np.array([True] * segment[-1] + [False])
        found = set(index.candidates(term[term >= 0], np.array(segment)[term >= 0], follows))
        for s in range(segment[-1] + 1):
            passage = set(words[s * longest:(s + 2) * longest])
            for k in tokens:
                score = sum(weight(k, w) for w in set(tokens[k]) & passage) / self_[k]
                if score >= threshold:
                    assert (s, index.items.index(k)) in found, (threshold, s, k, score)


def test_coverage():
    part, passage = T.words("a b c d e f g h")[0], T.words("x a b c d e y")[0]
    assert D.coverage(part, passage) == 5 / 8
    assert D.coverage(T.words("q")[0], passage) == 0 and D.coverage(T.words("y")[0], passage) == 1 and D.coverage(part[:0], passage) == 1
