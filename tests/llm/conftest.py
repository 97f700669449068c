import random

import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "key string, digest string, row string, seeds string, digest_ string, copy_ string, language_ string")  # clashing names


def prose(rng, n, words=300):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(3)) + str(rng.randrange(words)) for _ in range(n))


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang) rows, with extra columns whose names clash."""
    def build(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, None, "k", "d", None, "s", "x", "y", "z") for r in rows]
        return spark.createDataFrame(full, SCHEMA)
    return build


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, repeated rows, equal texts, ids that repeat."""
    rng = random.Random(5)
    base = prose(rng, 120)
    words = base.split()
    near = " ".join([*words[:60], "other", *words[61:]])
    long_ = prose(rng, 90_000, 10**6)
    return [
        (1, base), (2, base), (2, base), (3, near), (4, None), (5, ""), (None, base), (None, None), (6, long_), (7, long_),
        (8, prose(rng, 80)), (8, prose(rng, 70)), (9, "one two"), (10, "one two"), (11, " \t\n "), (12, "…—!"), (13, "x" * 700_000),
    ]
