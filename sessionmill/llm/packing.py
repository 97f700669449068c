"""Best-fit packing of documents into training sequences of bounded length.

Tokens: a document's ids, then the separator id. A document longer than a sequence is cut: the remainder comes
first, then full pieces, each a sequence of its own. All other pieces are packed by bounded-space online
best fit: pieces arrive one by one and go to the open bin with the least free space that takes them. The free
spaces in use are the bits of one integer, so that bin is its lowest set bit at or above the
piece's length; when more than ``OPEN_BINS`` bins are open, the fullest closes.

Pieces are dealt to packing tasks by a hash and reach each in order of falling length, so long ones open bins
and short ones fill them; the fullest bin, the first to close, is the one that waits in vain. The number of
tasks follows from the number of tokens: each fills about ``TASK_SEQUENCES`` sequences, so the bins
left open at a task's end are a small share at any size.
"""

from __future__ import annotations

import re
import struct
import zlib
from functools import lru_cache
from itertools import repeat

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionmill.llm.frames import empty_text, map_rows, store

LENGTH = 2048
OPEN_BINS = 4096
TASK_SEQUENCES = 4096
SEPARATOR = 0
CACHE_WORDS = 500_000
PIECES = "doc_id long, row long, piece int, start long, length int, ids_crc32 long, ids binary"


# The splitting pattern of byte-level BPE files, in full, and one that splits texts of Latin letters alike and faster.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LATIN = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+|'s|'t|'re|'ve|'m|'ll|'d| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_IS_LATIN = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*")
_SPACED, _BARE = re.compile(r" [A-Za-zÀ-ÖØ-öø-ÿ]+"), re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each pair, one after the other."""
    return np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())


class Encoder:
    """Token ids of texts by a ``tokenizers`` file of the byte-level BPE kind, which splits a text by PATTERN and encodes
    each part on its own.

    The ids of about ``CACHE_WORDS`` parts are kept, and only parts not met before are encoded: all of a batch in one call
    where they can be told apart again (words with a space before them one after the other, bare words a line each).
    """

    def __init__(self, file: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.plain = Tokenizer.from_file(file)  # here they become their ids
        self.special = [t.content for t in self.plain.get_added_tokens_decoder().values()]
        self.full = regex.compile(PATTERN)
        self.known: dict[str, int] = {}
        self.start, self.count, self.hits = (np.zeros(1 << 12, np.int64) for _ in range(3))
        self.flat, self.used = np.zeros(1 << 14, "<u4"), 0

    def _forget(self) -> None:
        """Keep the half of the parts that was used most; older uses count less and less."""
        n = len(self.known)
        stay = np.sort(np.argpartition(-self.hits[:n], CACHE_WORDS // 2)[:CACHE_WORDS // 2])
        names = list(self.known)
        self.known = {names[k]: i for i, k in enumerate(stay.tolist())}
        start, count = self.start[stay], self.count[stay]
        ids = self.flat[_ranges(start, count)]
        self.flat[:len(ids)], self.used = ids, len(ids)
        self.start[:len(stay)], self.count[:len(stay)] = np.cumsum(count) - count, count
        self.hits[:len(stay)] = self.hits[stay] // 2
        self.hits[len(stay):] = 0

    def _keep(self, parts: list[str], ids, counts: np.ndarray) -> None:
        """Add parts with their ids, which follow each other in ``ids``."""
        at = len(self.known)
        while at + len(parts) > len(self.start):
            self.start, self.count, self.hits = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.count, self.hits))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used:self.used + len(ids)] = ids
        self.count[at:at + len(parts)] = counts
        self.start[at:at + len(parts)] = self.used + np.cumsum(counts) - counts
        self.used += len(ids)
        self.known.update(zip(parts, range(at, at + len(parts))))

    def _learn(self, new: list[str]) -> None:
        spaced = [p for p in new if _SPACED.fullmatch(p)]
        bare = [p for p in new if _BARE.fullmatch(p)]
        for known, glue in ((spaced, ""), (bare, "\n")):  # a line end between bare words is a part of its own
            if known:
                found = self.tokenizer.encode(glue.join(known), add_special_tokens=False)
                part, ids = np.array(found.word_ids, np.int64), np.array(found.ids, "<u4")
                if glue:
                    ids, part = ids[part % 2 == 0], part[part % 2 == 0] // 2
                self._keep(known, ids, np.bincount(part, minlength=len(known)))
        for part in new:
            if part not in self.known:
                ids = self.tokenizer.encode(part, add_special_tokens=False).ids
                self._keep([part], ids, np.array([len(ids)]))

    def plain_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text as the tokenizer's own plain call gives them: strings of special tokens become their ids."""
        marked = [k for k, text in enumerate(texts) if any(s in text for s in self.special)]
        found = self.batch(["" if k in marked else text for k, text in enumerate(texts)] if marked else texts)
        for k in marked:
            found[k] = np.array(self.plain.encode(texts[k], add_special_tokens=False).ids, "<u4")
        return found

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, strings of special tokens as ordinary text."""
        parts, sizes = [], []
        for text in texts:
            found = (_LATIN if _IS_LATIN.fullmatch(text) else self.full).findall(text)
            parts += found
            sizes.append(len(found))
        if len(self.known) > CACHE_WORDS:
            self._forget()
        at = np.fromiter(map(self.known.get, parts, repeat(-1)), np.int64, len(parts))
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            self._learn(list(dict.fromkeys([parts[k] for k in missing])))
            at[missing] = [self.known[parts[k]] for k in missing]
        self.hits[:len(self.known)] += np.bincount(at, minlength=len(self.known))
        n = self.count[at]
        ids = self.flat[_ranges(self.start[at], n)]
        ends = np.concatenate([[0], np.cumsum(n)])[np.cumsum(sizes)]
        return np.split(ids, ends[:-1])


@lru_cache(4)
def encoder(file: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(file)


def pieces(ids: np.ndarray, length: int = LENGTH):
    """(start, end) of each piece: the remainder first, then full pieces."""
    at = len(ids) % length or length
    yield 0, min(at, len(ids))
    for start in range(at, len(ids), length):
        yield start, start + length


def batches(rows, text, chars: int = 1 << 19):
    """Lists of (row, text(row)) of about that many characters."""
    held, size = [], 0
    for row in rows:
        held.append((row, text(row)))
        size += len(held[-1][1])
        if size >= chars or len(held) >= 4096:
            yield held
            held, size = [], 0
    if held:
        yield held


def _tokenizer(file: str, length: int, with_ids: bool):
    def run(stream):
        for held in batches(stream, lambda row: row["text"]):
            for (row, _), ids in zip(held, encoder(file).plain_batch([t for _, t in held])):
                ids = np.append(ids, np.uint32(SEPARATOR)).astype("<u4")
                for k, (a, b) in enumerate(pieces(ids, length)):
                    data = ids[a:b].tobytes()
                    yield row["doc_id"], row["row"], k, a, b - a, zlib.crc32(data), data if with_ids else None
    return run


def tokenize(docs: DataFrame, file: str, length: int = LENGTH, with_ids: bool = True) -> DataFrame:
    """The pieces of every row of ``docs`` (doc_id, text), with their ids as little-endian 32-bit numbers
    (null without ``with_ids``). Null text counts as empty: one piece, the separator. ``row`` tells rows apart."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), empty_text().alias("text")).withColumn("row", F.monotonically_increasing_id())
    return map_rows(plain, _tokenizer(file, length, with_ids), PIECES)


class OpenBins:
    """Bins by free space; bit f of ``spaces`` is set when some open bin has f tokens free."""

    def __init__(self, length: int, limit: int):
        self.length, self.limit, self.spaces, self.count, self.next = length, limit, 0, 0, 0
        self.bins: list[list[int]] = [[] for _ in range(length + 1)]

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset) for a piece."""
        fits = self.spaces >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            bin_ = self._take(free)
        else:
            free, bin_ = self.length, self.next
            self.next += 1
        if free > size:
            self.bins[free - size].append(bin_)
            self.spaces |= 1 << (free - size)
            self.count += 1
            if self.count > self.limit:  # the fullest has the least free space: the lowest bit
                self._take((self.spaces & -self.spaces).bit_length() - 1)
        return bin_, self.length - free

    def _take(self, free: int) -> int:
        bin_ = self.bins[free].pop()
        if not self.bins[free]:
            self.spaces ^= 1 << free
        self.count -= 1
        return bin_


def _packer(length: int, open_bins: int):
    def run(stream):
        bins = OpenBins(length, open_bins)
        base = TaskContext.get().partitionId() << 40
        for row in stream:
            bin_, offset = bins.place(row["length"])
            yield row["doc_id"], row["row"], row["piece"], row["start"], row["length"], row["ids_crc32"], base + bin_, offset
    return run


PLACED = "doc_id long, row long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pack(found: DataFrame, length: int = LENGTH, open_bins: int = OPEN_BINS) -> DataFrame:
    """A place (sequence_id, offset) for each piece of ``tokenize``; ids stay behind."""
    tokens = found.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, tokens // (length * TASK_SEQUENCES))
    order = F.xxhash64("row", "piece")
    lengths = found.drop("ids").withColumn("order", order)
    dealt = lengths.repartition(tasks, "order").sortWithinPartitions(F.desc("length"), "order", "row", "piece").drop("order")
    return map_rows(dealt, _packer(length, open_bins), PLACED)


def pack_documents(docs: DataFrame, file: str, length: int = LENGTH, open_bins: int = OPEN_BINS) -> DataFrame:
    """One row per piece of every row of ``docs``: PLACED.

    Null and empty texts are one piece of one token. Rows with equal ids or texts are packed like any others. No rows
    give no rows; other columns are not looked at.
    """
    return pack(store(tokenize(docs, file, length, with_ids=False), "pieces"), length, open_bins)


def sequences(found: DataFrame, placed: DataFrame) -> DataFrame:
    """(sequence_id, ids, starts): the token ids of each sequence and the offsets at which its pieces start.

    ``found``: stored pieces with ids; ``placed``: their places by ``pack``. A sequence is bounded by its length.
    """
    both = placed.select("row", "piece", "sequence_id", "offset").join(found.select("row", "piece", "ids"), ["row", "piece"])
    parts = both.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    joined = parts.select("sequence_id", F.array_join(F.transform("p", lambda x: F.hex(x["ids"])), "").alias("h"), F.col("p.offset").alias("starts"))
    return joined.select("sequence_id", F.unhex("h").alias("ids"), "starts")


def ids_of(data: bytes) -> list[int]:
    return list(struct.unpack(f"<{len(data) // 4}I", data))
