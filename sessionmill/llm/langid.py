"""Language identification by a byte convolutional network, trained and applied in numpy.

A text is lower-cased and cut into windows of ``WINDOW`` bytes (the last one padded), all of it. Bytes are embedded, filters of
several widths slide over the window, each filter keeps its maximum, and a softmax layer gives the
window's languages. A text's scores are the mean log-probabilities of its windows, weighted by their
bytes, as probabilities again.

The network is fitted on a bounded sample of labelled rows (``SAMPLE_DOCS`` for each language, drawn by a hash
of the id, ``SAMPLE_WINDOWS`` windows of each, anywhere in the text). Its weights, some 30 KB whatever the data,
go to the tasks with the function.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from sessionmill.llm.frames import fresh_name, small_batches

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBED = 6
SAMPLE_DOCS = 800
SAMPLE_WINDOWS = 4
EPOCHS = 4
UNKNOWN = "und"
PAD = 0
ROWS = 256  # windows computed at once


class ByteConvNet:
    """embedding -> filters of several widths (one matrix, zero where a filter is narrower) -> max -> softmax."""

    def __init__(self, classes: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        span = max(WIDTHS)
        self.classes, self.span = classes, span
        self.embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.mask = np.zeros((span * EMBED, FILTERS * len(WIDTHS)), np.float32)
        for k, width in enumerate(WIDTHS):
            self.mask[:width * EMBED, k * FILTERS:(k + 1) * FILTERS] = 1
        self.filters = rng.normal(0, 0.4, self.mask.shape).astype(np.float32) * self.mask
        self.bias = np.zeros(self.mask.shape[1], np.float32)
        self.out = rng.normal(0, 0.2, (self.mask.shape[1], len(classes))).astype(np.float32)
        self.out_bias = np.zeros(len(classes), np.float32)

    def _columns(self, x: np.ndarray) -> np.ndarray:
        """(windows, positions, span * EMBED): what each filter position sees."""
        e = self.embed[x].reshape(len(x), -1)
        return np.lib.stride_tricks.sliding_window_view(e, self.span * EMBED, axis=1)[:, ::EMBED]

    def _pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Filter responses (windows, positions, filters) and their maxima."""
        seen = np.ascontiguousarray(self._columns(x))
        n, positions, width = seen.shape
        response = (seen.reshape(-1, width) @ self.filters).reshape(n, positions, -1)
        return seen, response

    def log_probs(self, x: np.ndarray) -> np.ndarray:
        parts = []
        for at in range(0, len(x), ROWS):
            _, response = self._pooled(x[at:at + ROWS])
            top = np.maximum(response.max(axis=1) + self.bias, 0)
            logits = top @ self.out + self.out_bias
            logits -= logits.max(axis=1, keepdims=True)
            parts.append(logits - np.log(np.exp(logits).sum(axis=1, keepdims=True)))
        return np.concatenate(parts) if parts else np.zeros((0, len(self.classes)), np.float32)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, batch: int = 64, seed: int = 7) -> ByteConvNet:
        """Adam on the cross-entropy of the windows."""
        rng, names = np.random.default_rng(seed), ("embed", "filters", "bias", "out", "out_bias")
        first = {k: np.zeros_like(getattr(self, k)) for k in names}
        second = {k: np.zeros_like(getattr(self, k)) for k in names}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(order), batch):
                step += 1
                for name, g in self._gradients(x[order[at:at + batch]], y[order[at:at + batch]]).items():
                    first[name] = 0.9 * first[name] + 0.1 * g
                    second[name] = 0.999 * second[name] + 0.001 * g * g
                    move = first[name] / (1 - 0.9 ** step) / (np.sqrt(second[name] / (1 - 0.999 ** step)) + 1e-8)
                    setattr(self, name, (getattr(self, name) - rate / (1 + epoch) * move).astype(np.float32))
                self.filters *= self.mask
        return self

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        seen, response = self._pooled(x)
        n, _, filters = response.shape
        where = response.argmax(axis=1)
        best = np.take_along_axis(response, where[:, None, :], axis=1)[:, 0] + self.bias
        top = np.maximum(best, 0)
        logits = top @ self.out + self.out_bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(n), y] -= 1
        p /= n
        back = (p @ self.out.T) * (best > 0)
        row = np.arange(n)[:, None]
        inputs = seen[row, where]  # (windows, filters, span * EMBED): only the winning positions learn
        g_filters = np.einsum("nfw,nf->wf", inputs, back) * self.mask
        g_inputs = (back[:, :, None] * self.filters.T[None]).reshape(n, filters, self.span, EMBED)
        g_embed = np.zeros_like(self.embed)
        at = x[row[:, :, None], where[:, :, None] + np.arange(self.span)]
        np.add.at(g_embed, at.ravel(), g_inputs.reshape(-1, EMBED))
        return {"embed": g_embed, "filters": g_filters, "bias": back.sum(0), "out": top.T @ p, "out_bias": p.sum(0)}


def windows_of(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a text, the last one padded, and the bytes that each holds."""
    n = max(1, -(-len(text) // WINDOW))
    x = np.full(n * WINDOW, PAD, np.uint8)
    x[:len(text)] = np.frombuffer(text, np.uint8)
    size = np.full(n, WINDOW)
    size[-1] = len(text) - (n - 1) * WINDOW
    return x.reshape(n, WINDOW), size


def learned_sample(docs: DataFrame, learn: Column, per_class: int = SAMPLE_DOCS) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Training windows: about ``per_class`` documents of each language among the rows for which ``learn`` holds.

    Documents are drawn by a hash of their id with a rate per language (per_class / its rows), so the sample is bounded
    and the same on every run; a window starts anywhere in the text, by another hash.
    """
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("text") != "")).select("doc_id", "lang", "text")
    counts = dict(rows.groupBy("lang").count().collect())
    classes = sorted(counts)
    if not classes:
        return np.zeros((0, WINDOW), np.uint8), np.zeros(0, int), []
    rate = F.create_map(*[F.lit(v) for c in classes for v in (c, min(1.0, per_class / counts[c]))])[F.col("lang")]
    draw = (F.shiftrightunsigned(F.xxhash64(F.lit("langid"), "doc_id"), 11) / F.lit(float(1 << 53))) < rate
    data = F.encode(F.lower("text"), "UTF-8")
    starts = [1 + F.pmod(F.xxhash64(F.lit(k), "doc_id"), F.greatest(F.lit(1), F.octet_length(F.lower("text")) - WINDOW + 1)) for k in range(SAMPLE_WINDOWS)]
    cut = rows.where(draw).select("doc_id", "lang", F.explode(F.array(*[F.substring(data, s, F.lit(WINDOW)) for s in starts])).alias("w"))
    # ties in the ids (repeated rows) could pass the bound: it is held here
    got = cut.dropDuplicates(["lang", "w"]).orderBy(F.xxhash64("doc_id", "w"), "lang", "w").limit(2 * per_class * SAMPLE_WINDOWS * len(classes)).select("lang", "w").collect()
    x = np.concatenate([windows_of(bytes(r.w))[0][:1] for r in got])
    return x, np.array([classes.index(r.lang) for r in got]), classes


def train(docs: DataFrame, learn: Column, per_class: int = SAMPLE_DOCS) -> ByteConvNet:
    x, y, classes = learned_sample(docs, learn, per_class)
    net = ByteConvNet(classes)
    return net.fit(x, y) if len(classes) > 1 else net


RESULT = StructType([StructField("lang", StringType()), StructField("score", DoubleType())])


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def predictor(net: ByteConvNet):
    """A column function text -> (lang, score): the most probable language of the whole text and its probability.

    Null texts and texts without a letter are ``und`` with score 0. So is everything when no language was learned.
    """
    @F.pandas_udf(RESULT)
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in texts:
            langs, scores = [UNKNOWN] * len(series), np.zeros(len(series))
            held, size = [], 0

            def flush():
                if not held:
                    return
                logp = net.log_probs(np.concatenate([w for _, w, _ in held]))
                at = 0
                for i, w, weight in held:
                    mean = np.average(logp[at:at + len(w)].astype(np.float64), axis=0, weights=weight)
                    at += len(w)
                    p = np.exp(mean - mean.max())
                    p /= p.sum()
                    langs[i], scores[i] = net.classes[int(p.argmax())], float(p.max())
                held.clear()

            for i, text in enumerate(series):
                if text is None or not net.classes or not _has_letter(text):
                    continue
                w, weight = windows_of(text.lower().encode("utf-8", "surrogatepass"))
                held.append((i, w, weight))
                size += len(w)
                if size >= 16 * ROWS:
                    flush()
                    size = 0
            flush()
            yield pd.DataFrame({"lang": langs, "score": scores})

    return predict


def identify(docs: DataFrame, net: ByteConvNet, name: str = "language") -> DataFrame:
    """``docs`` with one more column, a struct (lang, score)."""
    small_batches(docs.sparkSession)
    return docs.withColumn(name, predictor(net)(F.col("text")))


def reject_unknown(docs: DataFrame, net: ByteConvNet, min_score: float = 0.0) -> DataFrame:
    """The rows of ``docs`` in a recognised language, with their columns.

    Rejected: null texts, texts without a letter, and texts for which no language reaches ``min_score`` (by
    default any probability will do: a short or odd text in some language is not junk).
    """
    name = fresh_name(docs, "language_")
    found = identify(docs, net, name)
    return found.where((F.col(name)["lang"] != UNKNOWN) & (F.col(name)["score"] >= min_score)).select(*[F.col(f"`{c}`") for c in docs.columns])
