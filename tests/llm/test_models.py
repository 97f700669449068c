"""Language ID and toxicity: held-out accuracy on small labelled tables, defined results for odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionmill.llm import langid, toxicity
from tests.llm.conftest import prose

SYLLABLES = {"aa": ["ka", "lo", "mi", "ré"], "bb": ["sch", "ung", "der", "ö"], "cc": ["tion", "ing", "th", "ou"]}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def speech(make):
    rng = random.Random(4)
    return make([(i, sentence(rng, lang, rng.randrange(3, 120)), lang) for i in range(240) for lang in [rng.choice(list(SYLLABLES))]])


def test_language_of_held_out_rows(speech):
    net = langid.train(speech, F.col("doc_id") % 4 != 2)
    found = langid.identify(speech.where("doc_id % 4 = 2"), net).select("lang", "language.*").toDF("lang", "found", "score").collect()
    assert np.mean([r.lang == r.found for r in found]) > 0.95 and all(0 <= r.score <= 1 for r in found)


def test_predictions_see_text_alone_and_odd_rows_have_defined_results(make, speech, odd_rows):
    net = langid.train(speech, F.lit(True))
    rows = langid.identify(make(odd_rows), net, "found").collect()
    assert len(rows) == len(odd_rows)
    for r in rows:
        letters = any(map(str.isalpha, r.text or ""))
        assert (r.found.lang == langid.UNKNOWN) == (not letters) and (r.found.score > 0) == letters
    kept = langid.reject_unknown(make(odd_rows), net)
    assert kept.columns == make(odd_rows).columns and kept.count() == sum(any(map(str.isalpha, t or "")) for _, t in odd_rows)


def test_nothing_to_learn_from(make, odd_rows):
    net = langid.train(make(odd_rows), F.lit(True))
    assert {r.language.lang for r in langid.identify(make(odd_rows), net).collect()} == {langid.UNKNOWN}
    assert langid.identify(make([]), net).count() == 0


def test_windows_cover_the_whole_text():
    data = bytes(range(1, 256)) * 3
    w, size = langid.windows_of(data)
    assert w.tobytes()[:len(data)] == data and size.sum() == len(data) and (size[:-1] == langid.WINDOW).all()


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(0)
    net = langid.ByteConvNet(["a", "b", "c"])
    x, y = rng.integers(0, 256, (5, 16)).astype(np.uint8), np.array([0, 1, 2, 0, 1])
    loss = lambda: -net.log_probs(x)[np.arange(5), y].mean()
    grads = net._gradients(x, y)
    for name, at in [("out", (3, 1)), ("out_bias", (2,)), ("bias", (4,)), ("filters", (0, 1)), ("embed", (int(x[0, 3]), 2))]:
        value, step = getattr(net, name), 1e-2
        before = value[at]
        value[at] = before + step
        up = loss()
        value[at] = before - step
        down = loss()
        value[at] = before
        assert abs((up - down) / (2 * step) - grads[name][at]) < 2e-3, name


@pytest.fixture(scope="module")
def insults(make, spark):
    rng, rows, labels = random.Random(8), [], []
    for i in range(300):
        words = prose(rng, rng.randrange(10, 150)).split()
        toxic = i % 5 == 3
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                words[rng.randrange(len(words))] = rng.choice(["blackguard", "scoundrel", "dunderhead"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return make(rows), spark.createDataFrame([*labels, (None, 1, 1), (7, None, None), (7, 1, 9)], "doc_id long, quality int, toxic int")


def test_toxicity_of_held_out_rows(insults):
    docs, labels = insults
    model = toxicity.train(docs, labels, F.col("doc_id") % 3 != 0)
    got = docs.where("doc_id % 3 = 0").select("doc_id", toxicity.scorer(model)("text").alias("s")).collect()
    assert np.mean([(r.s >= 0.5) == (r.doc_id % 5 == 3) for r in got]) > 0.95


def test_toxicity_of_odd_rows(insults, make, odd_rows):
    docs, labels = insults
    model = toxicity.train(docs, labels, F.lit(True))
    rows = make(odd_rows).select("text", toxicity.scorer(model)("text").alias("s")).collect()
    assert len(rows) == len(odd_rows) and all(0 <= r.s <= 1 for r in rows)
    assert len({r.s for r in rows if not r.text}) == 1
    one_class = toxicity.train(docs, labels.where("toxic = 0"), F.lit(True))
    assert max(r[0] for r in docs.limit(5).select(toxicity.scorer(one_class)("text")).collect()) < 0.5
    nothing = toxicity.train(make([]), labels, F.lit(True))
    assert make([(1, "x")]).select(toxicity.scorer(nothing)("text").alias("s")).first().s == 0.5


def test_features_do_not_depend_on_chunks(monkeypatch):
    text = prose(random.Random(1), 400)
    seen = np.zeros(1 << toxicity.BITS, np.uint8)
    whole = toxicity.features(text, seen)
    monkeypatch.setattr(toxicity, "CHUNK", 37)
    assert (toxicity.features(text, seen) == whole).all() and not seen.any()


def test_toxicity_learns_from_windows_of_long_texts(spark, make, insults, monkeypatch):
    docs, labels = insults
    taken = []
    fit = toxicity.ScaledLinear.fit
    monkeypatch.setattr(toxicity.ScaledLinear, "fit", lambda self, texts, y, **o: taken.extend(texts) or fit(self, texts, y, **o))
    long = make([(9000 + k, w * 100_000) for k, w in enumerate(["plain words follow here and on and on, with more of them to come ", "you blackguard, you scoundrel of all dunderheads, be gone "])])
    marks = spark.createDataFrame([(9000, 1, 0), (9001, 1, 1)], labels.schema)
    model = toxicity.train(docs.union(long), labels.union(marks), F.lit(True))
    assert max(map(len, taken)) == toxicity.SAMPLE_CHARS and sum(len(t) == toxicity.SAMPLE_CHARS for t in taken) == 2
    got = {r.doc_id: r.s for r in long.select("doc_id", toxicity.scorer(model)("text").alias("s")).collect()}
    assert got[9000] < 0.5 <= got[9001]
