"""Exact dedup, n-gram join and substring dedup against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from sessionmill.llm import exact, jaccard, substring
from sessionmill.llm.frames import components
from tests.llm.conftest import prose


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def low(i):
    return -1 if i is None else i


def test_exact_groups(make, odd_rows):
    got = exact.exact_groups(make(odd_rows), bucket_keys=2).collect()
    best, size = {}, {}
    for i, t in odd_rows:
        t = t or ""
        size[t] = size.get(t, 0) + 1
        best[t] = i if low(i) >= low(best.get(t)) else best[t]
    want = sorted(((low(i), low(best[t or ""]), size[t or ""], i == best[t or ""], sha(t or "")) for i, t in odd_rows))
    assert sorted((low(r.doc_id), low(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in got) == want


def test_drop_copies_leaves_one_row_of_each_text(make, odd_rows):
    docs = make(odd_rows)
    kept = exact.drop_copies(docs)
    assert kept.columns == docs.columns
    rows = [(r.doc_id, r.text or "") for r in kept.collect()]
    assert len(rows) == len({t for _, t in odd_rows if t}) + 1
    assert {t: i for i, t in rows if t} == {t: max((j for j, u in odd_rows if u == t and j is not None)) for _, t in odd_rows if t}


def test_directory_splits_until_no_bucket_is_overfull(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("key")).union(spark.range(300).select((F.col("id") - 7).alias("key")))
    found = exact.grow_directory(keys, 40)
    starts = [p << (64 - d) for p, d in found]
    assert starts == sorted(starts) and starts[0] == 0
    assert all(a + (1 << (64 - d)) == b for a, b, (_, d) in zip(starts, starts[1:], found)) and starts[-1] + (1 << (64 - found[-1][1])) == 1 << 64
    import bisect

    count = {}
    for r in keys.collect():
        b = bisect.bisect_right(starts, r.key & exact.WHOLE) - 1
        count[b] = count.get(b, 0) + 1
    assert max(count.values()) <= 40


def test_owner_chains_texts_that_share_a_key():
    rows = [{"key": 5, "text": t, "doc_id": i, "n": n} for t, i, n in [("a", 1, 1), ("b", 9, 2), ("a", 4, 3), ("b", None, 1), ("c", None, 1)]]
    out = list(exact._owner([0])(iter(rows)))
    assert [(p, c, i, n) for _, _, p, _, c, i, n in out] == [(0, 1, 4, 4), (1, 1, 9, 3), (2, 1, None, 1)]


def brute_classes(rows):
    texts = {}
    for i, t in rows:
        texts.setdefault(t or "", []).append(i)

    def grams(t):
        w = re.findall(r"[^\W_]+", t.lower())
        return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = {t: grams(t) for t in texts}
    names = list(texts)
    parent = {t: t for t in names}

    def find(t):
        while parent[t] != t:
            t = parent[t]
        return t

    links = dict.fromkeys(names, 0)
    for x, a in enumerate(names):
        for b in names[x + 1:]:
            union = len(sets[a] | sets[b])
            if union and len(sets[a] & sets[b]) / union >= 0.8:
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    first = {}
    for t, ids in texts.items():
        known = [i for i in ids if i is not None]
        if known:
            first[find(t)] = min([*known, first.get(find(t), min(known))])
    return sorted((low(i), low(first.get(find(t or ""))), links[t or ""], len(texts[t or ""])) for i, t in rows)


def near_rows():
    rng, rows = random.Random(3), []
    for g in range(12):
        base = prose(rng, 200).split()
        for _ in range(rng.randrange(1, 12)):
            w = list(base)
            for _ in range(rng.randrange(0, 5)):
                w[rng.randrange(len(w))] = f"new{rng.random()}"
            rows.append((len(rows), " ".join(w)))
    return rows


@pytest.mark.parametrize("block", [3, 512])
def test_near_duplicates(make, odd_rows, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK_TEXTS", block)
    rows = near_rows() if block == 3 else odd_rows
    got = jaccard.near_duplicates(make(rows), recall=0.99999).collect()
    assert sorted((low(r.doc_id), low(r.class_id), r.n_links, r.n_copies) for r in got) == brute_classes(rows)


def test_bands_reach_their_recall():
    bands, rows = jaccard.choose_bands()
    assert 1 - (1 - 0.8 ** rows) ** bands >= jaccard.RECALL and bands * rows <= 128


def test_drop_near_duplicates_leaves_one_of_each_class(make):
    rows = near_rows()
    docs = make([*rows, rows[0]])
    kept = jaccard.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c, _, _ in brute_classes(rows)})


def brute_removed(rows, window):
    split = re.compile("[^\x20\x09-\x0d]+").findall
    words = [(i, split(t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - window + 1):
            key = tuple(w[k:k + window])
            if i is not None:
                first[key] = min(i, first.get(key, i))
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k:k + window])] < i:
                gone.update(range(k, k + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((low(i), len(w), len(gone), sha(" ".join(kept))))
    return sorted(out)


def shared_rows():
    rng, rows = random.Random(9), []
    passages = [prose(rng, n) for n in (50, 51, 75, 49, 120)]
    for i in range(60):
        parts = [prose(rng, rng.randrange(0, 70))]
        for _ in range(rng.randrange(0, 3)):
            parts += [rng.choice(passages), prose(rng, rng.randrange(0, 40))]
        rows.append((rng.randrange(40), "\n ".join(parts)))
    return [*rows, (50, "la " * 130), (51, "la " * 60), (52, "du la " * 70)]


@pytest.mark.parametrize("kind", ["odd", "shared"])
def test_removed_words(make, odd_rows, monkeypatch, kind):
    monkeypatch.setattr(substring, "TASK_TEXTS", 5)
    rows = odd_rows if kind == "odd" else shared_rows()
    got = substring.removed_words(make(rows), shard_phrases=7).collect()
    assert sorted((low(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_removed(rows, 50)


def test_kept_texts(make):
    base = " ".join(f"w{k}" for k in range(60))
    got = {r.doc_id: r.text for r in substring.kept_texts(make([(1, base), (2, f"a {base} b"), (3, base), (4, "short")])).collect()}
    assert got == {2: "a b", 3: ""}


def test_empty_tables(make):
    docs = make([])
    assert exact.exact_groups(docs).count() == exact.drop_copies(docs).count() == 0
    assert jaccard.near_duplicates(docs).count() == jaccard.drop_near_duplicates(docs).count() == 0
    assert substring.removed_words(docs).count() == 0


def test_components(spark):
    rng, edges = random.Random(2), []
    edges += [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 150)] + [(200, 200), (301, 300), (300, 301)]
    edges += [(400 + rng.randrange(30), 400 + rng.randrange(30)) for _ in range(25)]
    rows = components(spark.createDataFrame(edges, "a long, b long")).collect()
    root = {r.node: r.root for r in rows}
    assert len(rows) == len(root)
    want = {}
    for a, b in edges:
        if a != b:
            x, y = want.setdefault(a, {a}), want.setdefault(b, {b})
            if x is not y:
                x |= y
                for k in y:
                    want[k] = x
    assert set(root) == set(want)
    groups = {}
    for node, r in root.items():
        groups.setdefault(r, set()).add(node)
    assert all(groups[root[n]] == members for n, members in want.items())


def test_buckets_of_very_many_ngrams(spark):
    """80,000 texts of 1,000 n-grams, together over 2**25: two buckets with the same members, two with another one missing each."""
    met = spark.range(80_000).selectExpr("id * 8589934592 + 5 AS tid", "1000L AS n", "explode(array(7L, -7L, 8L, 9L)) AS bucket")
    met = met.where("NOT (bucket = 8 AND tid = 5) AND NOT (bucket = 9 AND tid = 8589934597)").unionByName(spark.sql("SELECT 1L tid, 3L n, 11L bucket"))
    assert sorted(map(tuple, jaccard.distinct_buckets(met).collect())) == [(-7, 313), (8, 313), (9, 313)]


def test_owners_follow_the_text(make, odd_rows, monkeypatch):
    assert [exact.owner_count(n, 10) for n in (0, 1, exact.OWNER_BYTES, exact.OWNER_BYTES + 1, 1 << 50)] == [1, 1, 1, 2, 10]
    monkeypatch.setattr(exact, "OWNER_BYTES", 40)
    rows = [*odd_rows, *((1000 + i, f"text {i % 60} " * 3) for i in range(300))]
    got = exact.exact_groups(make(rows), bucket_keys=2).collect()
    size, largest = {}, {}
    for i, t in rows:
        size[t or ""] = size.get(t or "", 0) + 1
        largest[t or ""] = max(largest.get(t or "", -1), -1 if i is None else i)
    want = [(i, None if largest[t or ""] < 0 else largest[t or ""], size[t or ""]) for i, t in rows]
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=str) == sorted(want, key=str)


def test_blocks_never_exceed_members(spark, make, monkeypatch):
    met = spark.sql("SELECT t tid, 100000000L n, 1L bucket FROM range(2) AS r(t)")
    assert [tuple(r) for r in jaccard.distinct_buckets(met).collect()] == [(1, 2)]
    monkeypatch.setattr(jaccard, "BLOCK_NGRAMS", 100)
    rng = random.Random(4)
    words = [f"w{rng.randrange(10 ** 6)}" for _ in range(30_000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:15_000], "other", *words[15_000:]])), (3, " ".join(reversed(words)))]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.near_duplicates(make(rows)).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 0)}
