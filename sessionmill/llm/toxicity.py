"""Toxicity by a character n-gram linear classifier scaled with naive Bayes log-count ratios.

A text's features are the character n-grams (``ORDERS``) of its lower-cased, space-normalised form, hashed to 2**``BITS``
places and taken once each. Training scales every feature by the log ratio of its smoothed shares among toxic and
other texts, and fits a logistic regression on the scaled features; the product of the two is one weight
per place, so scoring a text of any length is one lookup per n-gram.

The classifier is fitted on a bounded sample of the labelled rows (``SAMPLE_DOCS`` of each class, drawn by a hash of
the id; of a text longer than ``SAMPLE_CHARS`` one window of that length, placed by another hash); its weights, 2**BITS numbers, go to the tasks with the function.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionmill.llm import text as T
from sessionmill.llm.frames import small_batches

ORDERS = (4, 5, 6)
BITS = 18
SAMPLE_DOCS = 1500
SAMPLE_CHARS = 1 << 16
EPOCHS = 12
SMOOTH = 1.0
CHUNK = 1 << 18


def features(text: str, seen: np.ndarray) -> np.ndarray:
    """The places of a text's n-grams, each once. ``seen``: 2**BITS zeros, left as zeros."""
    text = " " + " ".join(text.lower().split()) + " "
    for at in range(0, len(text), CHUNK):  # chunks overlap, so no n-gram is lost
        cp = T.code_points(text[at:at + CHUNK + max(ORDERS) - 1]).astype(np.uint64)
        for n in ORDERS:
            if len(cp) < n:
                continue
            h = np.full(len(cp) - n + 1, n, np.uint64)
            for k in range(n):
                h = (h ^ cp[k:len(cp) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            seen[h >> np.uint64(64 - BITS)] = 1
    places = np.flatnonzero(seen)
    seen[places] = 0
    return places.astype(np.int32)


class ScaledLinear:
    """Weights by place and a bias; without two classes to learn from every score is the share of toxic rows."""

    def __init__(self):
        self.weight, self.bias = np.zeros(1 << BITS, np.float32), 0.0

    def fit(self, texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.1, decay: float = 1e-4, seed: int = 7) -> ScaledLinear:
        toxic = labels.sum()
        if not 0 < toxic < len(labels):
            self.bias = 0.0 if not len(labels) else 20.0 if toxic else -20.0
            return self
        seen = np.zeros(1 << BITS, np.uint8)
        rows = [features(t, seen) for t in texts]
        counts = np.zeros((2, 1 << BITS))
        for places, y in zip(rows, labels):
            counts[y, places] += 1
        share = (counts + SMOOTH) / (np.bincount(labels, minlength=2)[:, None] + 2 * SMOOTH)
        ratio = (np.log(share[1]) - np.log(share[0])).astype(np.float32)
        # adaptive steps, one text at a time, classes weighted alike
        rng, w = np.random.default_rng(seed), np.zeros(1 << BITS, np.float32)
        sums, b, b_sum = np.full(1 << BITS, 1e-3, np.float32), 0.0, 1e-3
        balance = np.array([len(labels) / 2 / (len(labels) - toxic), len(labels) / 2 / toxic])
        mean_w, mean_b, steps = np.zeros_like(w), 0.0, 0
        for epoch in range(epochs):
            for i in rng.permutation(len(rows)):
                places, y = rows[i], labels[i]
                r = ratio[places]
                norm = 1 / np.sqrt(max(1.0, float(r @ r)))
                p = 1 / (1 + np.exp(-np.clip(norm * (w[places] @ r) + b, -30, 30)))
                g = float(balance[y] * (p - y))
                gw = g * norm * r + decay * w[places]
                sums[places] += gw * gw
                w[places] -= rate * gw / np.sqrt(sums[places])
                b_sum += g * g
                b -= rate * g / np.sqrt(b_sum)
            if epoch >= epochs // 2:
                mean_w, mean_b, steps = mean_w + w, mean_b + b, steps + 1
        self.ratio, self.weight, self.bias = ratio, (mean_w / steps * ratio).astype(np.float32), mean_b / steps
        return self

    def score(self, places: np.ndarray) -> float:
        z = self.bias
        if len(places) and hasattr(self, "ratio"):
            r = self.ratio[places]
            z += float(self.weight[places].sum(dtype=np.float64)) / np.sqrt(max(1.0, float(r @ r)))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = SAMPLE_DOCS) -> ScaledLinear:
    """Fit on about ``per_class`` rows of each label among the labelled rows for which ``learn`` (of doc_id) holds.

    ``labels``: (doc_id, toxic 0/1); other or null labels are left out; of several labels of a document the largest counts.
    Texts beyond ``SAMPLE_CHARS`` characters are cut to a window in the tasks, so the driver gets rows of bounded size.
    """
    known = labels.where(learn & F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    counts = dict(known.groupBy("toxic").count().collect())
    rate = F.lit(0.0)
    for label, n in counts.items():
        rate = F.when(F.col("toxic") == label, min(1.0, per_class / n)).otherwise(rate)
    draw = (F.shiftrightunsigned(F.xxhash64(F.lit("toxicity"), "doc_id"), 11) / F.lit(float(1 << 53))) < rate
    drawn = known.where(draw)
    start = 1 + F.pmod(F.xxhash64(F.lit("window"), "doc_id"), F.greatest(F.lit(1), F.char_length("text") - SAMPLE_CHARS + 1)).cast("int")
    window = F.substring("text", start, F.lit(SAMPLE_CHARS)).alias("text")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), window).where("text IS NOT NULL").join(F.broadcast(drawn), "doc_id")  # about 2 * per_class rows
    # repeated ids could pass the bound: it is held here
    got = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id")).limit(4 * per_class).collect()
    return ScaledLinear().fit([r["text"] for r in got], np.array([r["toxic"] for r in got], int))


def score(docs: DataFrame, model: ScaledLinear, name: str = "score") -> DataFrame:
    """``docs`` with one more column: the probability that the whole text is toxic."""
    small_batches(docs.sparkSession)
    return docs.withColumn(name, scorer(model)("text"))


def scorer(model: ScaledLinear):
    """A column function text -> probability of being toxic. Null counts as empty; an empty text gets the bias alone."""
    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        seen = np.zeros(1 << BITS, np.uint8)
        for series in texts:
            yield pd.Series([model.score(features(t or "", seen)) for t in series], dtype="float64")

    return score
