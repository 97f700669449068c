"""Hard negatives against all inner products."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionmill.llm import hardneg

SCHEMA = "vec_id long, embedding array<double>, label int, row string, q string, strip int, Query string, id int"


def plain(rows, is_anchor, window=(50, 95)):
    """Rows of the result; ties at equal ids may fall either way, so ids repeat only with equal vectors here."""
    kept = []
    for i, v, y, *_ in rows:
        if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(256 * x) for x in v], y))
    big = 1 << 63
    out = []
    for a, (i, v, y) in enumerate(kept):
        if i is None or not is_anchor(i):
            continue
        score = sorted((-min(max(sum(p * q for p, q in zip(v, w)), -big), big - 1), big if j is None else j, b) for b, (j, w, _) in enumerate(kept) if b != a)
        same = [s for s in score if kept[s[2]][2] == y][:5]
        for s, j, _ in same:
            fits = [(n, m) for n, m, b in score if kept[b][2] != y and window[0] * -s <= 100 * -n <= window[1] * -s][:3]
            out += [(i, None if j == big else j, rank + 1, None if m == big else m, -s, -n) for rank, (n, m) in enumerate(fits)]
    return sorted(map(str, out))


def mined(spark, rows, **how):
    df = spark.createDataFrame([(i, v, y, "r", "q", 3, "x", 9) for i, v, y in rows], SCHEMA).repartition(3)
    got = hardneg.hard_negatives(df, F.col("vec_id") % 5 == 0, **how)
    return sorted(str((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score)) for r in got.collect())


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(hardneg, "LEAF", 4)
    monkeypatch.setattr(hardneg, "FANOUT", 3)
    monkeypatch.setattr(hardneg, "BLOCK", 7)
    monkeypatch.setattr(hardneg, "STRIP_ROWS", (40, 60))


@pytest.mark.parametrize("scale", [0.05, 1e6, 3e7])
def test_against_all_products(spark, small, scale):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0.3, 1) * scale for _ in range(6)], rng.randrange(4)) for i in range(220)]
    rows += [(300 + i, rows[7][1], i % 2) for i in range(60)]  # one vector many times
    rows += [(400, None, 1), (405, rows[0][1], None), (410, [1.0, None], 1), (415, [math.nan] * 6, 1), (420, [math.inf] * 6, 0),
             (425, [scale] * 3, 2), (430, [], 2), (None, rows[3][1], 1), (435, [0.0] * 6, 3), (440, [-scale] * 6, 1)]
    assert mined(spark, rows) == plain(rows, lambda i: i % 5 == 0)


def test_few_rows_and_none(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(5, None, 1), (10, [math.nan], 2)]) == []
    assert mined(spark, [(5, [1.0, 1.0], 1)]) == []
    rows = [(5, [1.0, 1.0], 1), (6, [1.0, 0.9], 1), (7, [0.5, 0.9], 2), (8, [-1.0, 0.0], 2)]
    assert mined(spark, rows) == plain(rows, lambda i: i % 5 == 0) != []


def test_repeated_rows_are_rows_of_their_own(spark):
    rows = [(5, [1.0, 1.0], 1)] * 3 + [(9, [0.8, 0.9], 2)] * 2
    assert mined(spark, rows) == plain(rows, lambda i: i % 5 == 0)


def test_negative_positives_have_no_window(spark):
    rows = [(5, [1.0], 1), (6, [-1.0], 1), (7, [-0.7], 2)]
    assert mined(spark, rows) == [] == plain(rows, lambda i: i % 5 == 0)


def test_scores_beyond_a_long_saturate(spark):
    rows = [(5, [1e30], 1), (6, [1e30], 1), (7, [6e29], 2)]
    got = mined(spark, rows, window=(0, 100))
    assert got == [str((5, 6, 1, 7, (1 << 63) - 1, (1 << 63) - 1))]


def test_search_leaves_boxes_out(monkeypatch):
    """On rows in clusters most leaves are never scored, and the result is that of all rows."""
    rng = np.random.default_rng(0)
    centres = rng.normal(0, 300, (64, 8))
    vectors = np.floor(np.concatenate([c + rng.normal(0, 3, (128, 8)) for c in centres]))
    order = hardneg.str_order(vectors)
    vectors = vectors[order]
    labels = order % 3
    tree = hardneg.Tree(vectors, order.astype("<i8"), order.astype("<i8"), labels.astype("<i8"))
    queries, k = np.floor(centres[:5]), 4
    seen = []
    plain_nonzero = np.nonzero
    monkeypatch.setattr(hardneg.np, "nonzero", lambda x: (seen.append(x) if x.ndim == 2 else None) or plain_nonzero(x))
    none = np.full(5, hardneg.LONG[0]), np.full(5, hardneg.LONG[1])
    who, score, place = hardneg.search(tree, queries, np.full(5, -1), np.zeros(5, np.int64), *none, True, k)
    assert len(seen) < len(tree.levels[0][2]) / 2
    for q in range(5):
        want = sorted((-(queries[q] @ v), i) for v, i, y in zip(vectors, tree.ids, labels) if y == 0)[:k]
        assert [(-float(s), int(tree.ids[p])) for s, p in zip(score[who == q], place[who == q])] == [(float(s), int(i)) for s, i in want]
