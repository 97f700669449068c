"""Line dedup against a plain count of lines, its hash arrays against a dictionary."""

import random
import re

import numpy as np
import pytest

from sessionmill.llm import linededup
from tests.llm.conftest import prose


def key_of(line):
    return re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate({c: c + 32 for c in range(65, 91)})


def plain(rows, min_docs, min_chars):
    lines = [(t or "").split("\n") for _, t in rows]
    count = {}
    for own in lines:
        for k in {key_of(x) for x in own}:
            count[k] = count.get(k, 0) + 1
    often = {k for k, n in count.items() if n >= min_docs and len(k) >= min_chars}
    kept = [[x for x in own if key_of(x) not in often] for own in lines]
    return [(i, len(own), len(own) - len(k), "\n".join(k)) for (i, _), own, k in zip(rows, lines, kept)]


def same_rows(got, want):
    return sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.text) for r in got) == sorted((str(i), *x) for i, *x in want)


@pytest.fixture
def tiny(monkeypatch):
    """Blocks of two rows, shards of a few keys."""
    for name, value in (("BLOCK_BITS", 1), ("SHARD_KEYS", 8), ("HELD_KEYS", 5)):
        monkeypatch.setattr(linededup, name, value)


@pytest.mark.parametrize("min_docs,min_chars", [(1, 1), (3, 1), (3, 6), (10, 1)])
def test_frequent_lines_go(make, odd_rows, tiny, min_docs, min_chars):
    rng = random.Random(min_docs)
    common = ["Menu", "© 2020 all rights reserved", "Überschrift", " not ASCII space ", "x", "", "   \t", "a\rb"]
    rows = list(odd_rows)
    for i in range(60):
        own = [rng.choice([" ", ""]) + rng.choice([c, c.upper()]) + rng.choice(["\r", " \x0b", ""]) for c in rng.sample(common, 3)]
        rows.append((100 + i // 2, "\n".join(rng.sample(own + [prose(rng, 4), prose(rng, 3)] * rng.choice([1, 2]), 5)) + rng.choice(["\n", ""])))
    docs = make(rows)
    out = linededup.drop_frequent_lines(docs, min_docs, min_chars)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"]
    got, want = out.collect(), plain(rows, min_docs, min_chars)
    assert same_rows(got, want)
    assert {r.key for r in got} == {"k"} and {r.language_ for r in got} == {"z"}  # clashing columns come back as they were


def test_a_line_of_every_document_and_a_very_long_text(make):
    rows = [(i, f"own {i}\nsame line\n") for i in range(3000)] + [(9000, "\n".join(f"line {k} of many" for k in range(50_000)) + "\nSAME LINE")]
    got = {r.doc_id: r for r in linededup.drop_frequent_lines(make(rows)).collect()}
    assert got[7].text == "own 7\n" and got[7].n_dropped == 1
    assert got[9000].n_lines == 50_001 and got[9000].n_dropped == 1 and got[9000].text.endswith("line 49999 of many")


def test_no_rows_and_taken_names(spark, make):
    assert linededup.drop_frequent_lines(make([])).collect() == []
    out = linededup.drop_frequent_lines(spark.createDataFrame([(1, "a\nb", 7)], "doc_id long, TEXT string, N_Lines int"), min_docs=1)
    assert out.columns == ["doc_id", "TEXT", "N_Lines", "n_lines_", "n_dropped"]
    assert [tuple(r) for r in out.collect()] == [(1, "", 7, 2, 2)]
    with pytest.raises(ValueError):
        linededup.drop_frequent_lines(make([]), min_docs=1 << 16)


@pytest.mark.parametrize("size", [0, 1, 2, 5000])
def test_hash_arrays_hold_every_key_at_its_own_place(size):
    rng = np.random.default_rng(size)
    a, b = rng.integers(0, 1 << 63, size, np.uint64), rng.integers(0, 1 << 63, size, np.uint64)
    a[: size // 10] = a[:1] if size else a[:0]  # keys that agree in one half
    n = rng.integers(1, 100_000, size)
    shard = linededup.Shard(*linededup.compile_shard(a, b, n))
    assert sorted(shard.places(a, b)) == list(range(size))  # minimal: places without gaps
    assert (shard.documents(a, b) == np.minimum(n, 65_535)).all()
    other = shard.documents(*rng.integers(0, 1 << 63, (2, 20_000), np.uint64))
    assert (other > 0).sum() <= 1  # fingerprints turn foreign keys away
    assert len(shard.packed) <= size * 6 / 8 + 16
