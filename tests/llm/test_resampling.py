"""Importance resampling against a plain computation by the formula."""

import hashlib
import math
import random
import re
import zlib

import pytest

from sessionmill.llm import resampling
from tests.llm.conftest import prose


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain(rows, target, max_words=1, buckets=10_000, min_words=20, share=(10, 100), seed=2024):
    def found(text):
        w = words_of(text)
        return len(w), [zlib.crc32(" ".join(w[i:i + n]).encode()) % buckets for n in range(1, max_words + 1) for i in range(len(w) - n + 1)]

    ours, theirs = [found(t) for _, t in rows], [found(t) for t in target]
    s, t = [0] * buckets, [0] * buckets
    for counts, all_ in ((s, ours), (t, theirs)):
        for _, f in all_:
            for b in f:
                counts[b] += 1
    gain = [math.floor(1000 * math.log((y + 1) * (sum(s) + buckets) / ((x + 1) * (sum(t) + buckets)))) for x, y in zip(s, t)]
    out = []
    for (i, _), (n, f) in zip(rows, ours):
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        out.append((i, n, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((x for x in out if x[1] >= min_words), key=lambda x: (-x[4], math.inf if x[0] is None else x[0]))
    draw = order[:len(order) * share[0] // share[1]]
    return out, draw


@pytest.mark.parametrize("how", [{}, {"max_words": 3, "buckets": 50, "min_words": 2, "share": (50, 100), "seed": 7}, {"buckets": 100_000, "share": (100, 100)}])
def test_weights_and_draw(make, odd_rows, how, monkeypatch):
    monkeypatch.setattr(resampling, "PIECE", 1000)
    monkeypatch.setattr(resampling, "KNOWN_WORDS", 100)
    rng = random.Random(3)
    rows = odd_rows + [(100 + i, prose(rng, rng.randrange(1, 60)).upper() + " Straße—ÉCOLE x_1") for i in range(80)]
    target = [prose(rng, 40) for _ in range(5)] + [None, "", "ÉCOLE\x00straße"]
    want = plain(rows, target, **how)
    spark = make([]).sparkSession
    wanted = spark.createDataFrame([(t, 1) for t in target], "text string, rest int")
    got = resampling.importance(make(rows), wanted, **how).collect()
    assert sorted(str((r.doc_id, r.n_features, r.weight, r.score)) for r in got) == sorted(str((i, n, w, s)) for i, _, n, w, s in want[0])
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(want[1]) + 1))
    assert [(r.doc_id, r.score) for r in ranked] == [(x[0], x[4]) for x in want[1]]


def test_drawn_rows_keep_their_columns(make, odd_rows):
    docs = make(odd_rows * 3)
    out = resampling.drawn(docs, make(odd_rows[:3]), share=(50, 100))
    assert out.columns == docs.columns
    long_enough = sum(len(words_of(t)) >= 20 for _, t in odd_rows) * 3
    rows = out.collect()
    assert len(rows) == long_enough // 2 and {r.row for r in rows} == {None} and {r.key for r in rows} == {"k"}


def test_empty_tables(make, odd_rows):
    assert resampling.importance(make([]), make(odd_rows)).collect() == []
    got = resampling.importance(make([(1, "a b c"), (None, None)]), make([])).collect()
    assert sorted((r.doc_id or 0, r.n_features, r["rank"]) for r in got) == [(0, 0, None), (1, 3, None)]


def test_ranks_of_a_table_of_one_repeated_row(make):
    got = resampling.importance(make([(5, "w " * 30)] * 400), make([(1, "w")])).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 41)) and len(got) == 400
