import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sessionmill.llm import text as T

ALPHABET = st.text(st.sampled_from("aB1é漢😀 \t\n.-_\x1c\xa0"), max_size=60)


@settings(max_examples=200, deadline=None)
@given(ALPHABET)
def test_words_are_runs(value):
    _, a, b = T.words(value)
    assert [value[x:y] for x, y in zip(a, b)] == re.findall(r"[^\W_]+", value)
    _, a, b = T.words(value, alphanumeric=False)
    assert [value[x:y] for x, y in zip(a, b)] == re.findall("[^\x20\x09-\x0d]+", value)


def test_equal_words_have_equal_hashes_and_others_not():
    rng = random.Random(1)
    value = " ".join("".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(5000))
    h, a, b = T.words(value)
    seen = {}
    for x, i, j in zip(h.tolist(), a, b):
        assert seen.setdefault(value[i:j], x) == x
    assert len(set(seen.values())) == len(seen)


def test_long_texts_in_chunks_agree_with_short_ones():
    value = "alpha beta gamma " * 60_000
    h, a, b = T.words(value)
    assert len(h) == 180_000 and len(np.unique(h)) == 3 and (h[:3] == h[-3:]).all()
    assert [value[x:y] for x, y in zip(a[-3:], b[-3:])] == ["alpha", "beta", "gamma"]
    whole = "z" * 700_000
    assert len(T.words(whole)[0]) == 1


def test_ngrams():
    h = T.words("a b c d e f a b c d e")[0]
    grams = T.ngrams(h, 5)
    assert len(grams) == 7 and grams[0] == grams[6] and len(np.unique(grams)) == 6
    assert len(T.ngrams(h[:3], 5)) == 1 and len(T.ngrams(h[:0], 5)) == 0
    assert T.ngrams(h[:3], 5)[0] != T.ngrams(h[:2], 5)[0]
