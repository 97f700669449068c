"""Word hashing shared by the text operators: plain numpy helpers that run inside Spark tasks.

A text becomes code points, code points become words, and each word becomes a 64-bit number, all
without a Python object per word. The hash of a word is a difference of prefix sums of a polynomial
modulo 2**64, mixed once more; the polynomial's base is odd and has an inverse.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

CHUNK = 1 << 19
SPACES = (0x20, *range(0x09, 0x0E))
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_SPACE = re.compile("[\x20\x09-\x0d]")


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit numbers (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(1)
def _values() -> np.ndarray:
    return mix(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(_BASE))


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    up = np.full(CHUNK + 1, _BASE, np.uint64)
    down = np.full(CHUNK + 1, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


@lru_cache(2)
def _word_table(alphanumeric: bool) -> np.ndarray:
    """True for code points that belong to words: letters and digits, or all but ASCII white space."""
    if alphanumeric:
        return np.array([chr(c).isalnum() for c in range(0x110000)])
    table = np.ones(0x110000, bool)
    table[list(SPACES)] = False
    return table


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _chunks(text: str):
    """Pieces of a very long text, cut at white space; without any, the text stays whole."""
    at = 0
    while len(text) - at > CHUNK:
        cut = _SPACE.search(text, at + CHUNK // 2)
        if cut is None:
            break
        yield at, text[at:cut.start()]
        at = cut.start()
    yield at, text[at:]


def words(text: str, alphanumeric: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word; positions count code points.

    ``alphanumeric``: runs of letters and digits; else whatever lies between ASCII white space, unchanged.
    """
    table, value, parts = _word_table(alphanumeric), _values(), []
    for at, piece in _chunks(text):
        cp = code_points(piece)
        inside = np.zeros(len(cp) + 2, np.int8)
        inside[1:-1] = table[cp]
        step = np.diff(inside)
        start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        up, down = _powers()
        if len(cp) > CHUNK:  # one stretch without white space
            up = np.full(len(cp) + 1, _BASE, np.uint64)
            down = np.full(len(cp) + 1, pow(_BASE, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        total = np.zeros(len(cp) + 1, np.uint64)
        np.cumsum(value[cp] * up[:len(cp)], out=total[1:])
        parts.append((mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)), start + at, end + at))
    if len(parts) == 1:
        return parts[0]
    return tuple(np.concatenate(x) for x in zip(*parts))


@lru_cache(8)
def _factors(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def ngrams(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words, in order; a shorter text is one run, an empty one none."""
    size = len(word_hashes)
    if not size:
        return np.zeros(0, np.uint64)
    if size < n:
        return mix(np.array([(word_hashes * _factors(n)[:size]).sum(dtype=np.uint64) + np.uint64(size)], np.uint64))
    out = np.zeros(size - n + 1, np.uint64)
    for k, factor in enumerate(_factors(n)):
        out += word_hashes[k:size - n + 1 + k] * factor
    return mix(out)


def as_long(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)
