"""Packing against its laws and plain encoding; chat formatting as an exact round trip."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sessionmill.llm import chat, packing
from tests.llm.conftest import prose

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    tool = Tokenizer.from_file(FILE)
    tool.encode_special_tokens = True
    return lambda t: tool.encode(t, add_special_tokens=False).ids


def test_pattern_is_the_published_one():
    assert packing.PATTERN == public_tokenizers.PATTERN


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aBé漢😀 \t\n.'s-_²½ªº1９\x1c\xa0ß<|>"), max_size=30), max_size=5))
def test_encoder_equals_the_tokenizer(texts):
    tool = packing.encoder(FILE)
    got = tool.batch([*texts, "don't <|endoftext|> l'été"])
    want = [tool.tokenizer.encode(t, add_special_tokens=False).ids for t in [*texts, "don't <|endoftext|> l'été"]]
    assert [g.tolist() for g in got] == want


def test_plain_call_reads_special_tokens():
    texts = ["a <|endoftext|>b", "", "no mark", "<|endoftext|>" * 3]
    tool = Tokenizer.from_file(FILE)
    assert [g.tolist() for g in packing.encoder(FILE).plain_batch(texts)] == [tool.encode(t, add_special_tokens=False).ids for t in texts]
    assert packing.encoder(FILE).plain_batch(["x <|endoftext|>"])[0].tolist() != packing.encoder(FILE).batch(["x <|endoftext|>"])[0].tolist()


def test_encoder_forgets_and_stays_right(monkeypatch, plain):
    monkeypatch.setattr(packing, "CACHE_WORDS", 20)
    tool = packing.Encoder(FILE)
    for seed in range(4):
        text = prose(random.Random(seed), 60)
        assert tool.batch([text])[0].tolist() == plain(text)


@pytest.mark.parametrize("length,open_bins", [(64, 4096), (64, 3), (2048, 4096)])
def test_packing_laws(make, odd_rows, plain, monkeypatch, length, open_bins):
    monkeypatch.setattr(packing, "TASK_SEQUENCES", 50)
    rng = random.Random(2)
    rows = [*odd_rows[:6], *odd_rows[10:13], *((100 + i, prose(rng, rng.randrange(0, 120))) for i in range(80))]
    got = packing.pack_documents(make(rows), FILE, length, open_bins).collect()
    by_row, by_sequence = {}, {}
    for r in got:
        by_row.setdefault(r.row, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    left = [(i, [*plain(t or ""), 0]) for i, t in rows]
    total = sum(len(ids) for _, ids in left)
    for own in by_row.values():
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        fit = next(x for x in left if x[0] == own[0].doc_id and len(x[1]) == sum(r.length for r in own)
                   and all(zlib.crc32(np.array(x[1][r.start:r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for r in own))
        left.remove(fit)
        assert all(r.length == length for r in own[1:]) and (len(own) == 1 or len(fit[1]) > length)
    assert not left
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
    if open_bins > 100:
        assert len(by_sequence) <= -(-total // length) * 1.1 + 1


def test_open_bins_best_fit():
    bins = packing.OpenBins(10, 2)
    assert bins.place(6) == (0, 0) and bins.place(8) == (1, 0)
    assert bins.place(2) == (1, 8) and bins.place(4) == (0, 6) and bins.count == 0 and bins.spaces == 0
    assert [bins.place(size)[0] for size in (3, 8, 9)] == [2, 3, 4]
    assert bins.count == 2
    assert bins.place(1) == (3, 8)  # bin 4, the fullest, had closed


def test_sequences_hold_the_ids(make, plain):
    rows = [(i, prose(random.Random(i), 30 + i)) for i in range(12)]
    found = packing.tokenize(make(rows), FILE, 128)
    found = found.sparkSession.createDataFrame(found.collect(), found.schema)
    placed = packing.pack(found, 128)
    built = packing.sequences(found, placed).collect()
    assert sorted(t for r in built for t in packing.ids_of(bytes(r.ids))) == sorted(t for _, x in rows for t in [*plain(x), 0])
    assert all(r.starts == sorted(r.starts) and r.starts[0] == 0 for r in built)


def test_no_documents(make):
    assert packing.pack_documents(make([]), FILE).count() == 0


CONTROLLED = st.lists(st.sampled_from(["\\", "</turn>", "<turn>", "### User:", "### Assistant:", "a", "\n", " ", "é", "<|endoftext|>"]), max_size=9).map("".join)


@settings(max_examples=300, deadline=None)
@given(CONTROLLED)
def test_escapes_are_reversible_and_complete(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text and chat._role(chat._line(text)) == text
    assert not re.search(rf"(?<!\\)(?:{chat._CONTROL})", escaped)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), CONTROLLED), CONTROLLED), max_size=5))
def test_formatted_text_parses_back(turns):
    text = "".join(chat.formatted(r, t) for r, t in turns)
    found = re.findall(r"(?s)(?<!\\)<turn>(.*?)\n(.*?)\n(?<!\\)</turn>\n(?=<turn>|\Z)", text)
    assert [(chat._role(chat.unescape(r)), chat.unescape(t)) for r, t in found] == turns


def test_round_trip(spark):
    rng = random.Random(3)
    roles = ["user", "assistant", "system", None, "tool\nx", "assistant"]
    bits = ["</turn>", "\\", "<turn>user", "### Assistant: hi", "ok", "\n", "😀", "<|endoftext|>", "é" * 30]
    rows = [(c, t, rng.choice(roles), None if rng.random() < 0.1 else " ".join(rng.choice(bits) for _ in range(rng.randrange(0, 8))))
            for c in [1, 2, 3, None] for t in range(rng.randrange(1, 6))]
    rows += [(9, t, roles[t % 2], f"turn {t}") for t in range(400)] + [(8, 0, "assistant", "x" * 300_000)]
    extra = "at long, ids string, n_ids int"  # clashing names
    table = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], f"conv_id long, turn long, role string, text string, {extra}").repartition(7)
    got = chat.read_back(chat.assemble(table, FILE), FILE).collect()
    assert len(got) == len({r[0] for r in rows})
    for g in got:
        own = sorted((r for r in rows if r[0] == g.conv_id), key=lambda r: r[1])
        learned = "".join(t or "" for _, _, r, t in own if r == "assistant")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert g.turns_sha256 == digest("".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own))
        assert (g.n_turns, g.loss_chars, g.loss_sha256) == (len(own), len(learned), digest(learned))
        assert g.formatted_chars == sum(len(chat.formatted(r, t or "")) for _, _, r, t in own)


def test_offsets_are_prefix_sums_and_masks_cover_assistants(spark):
    table = spark.createDataFrame([(1, 0, "user", "a b"), (1, 1, "assistant", "c d e"), (1, 2, "user", "")], "conv_id long, turn long, role string, text string")
    rows = sorted(chat.assemble(table, FILE).collect(), key=lambda r: r.turn)
    assert [r["at"] for r in rows] == [0, rows[0].n_ids, rows[0].n_ids + rows[1].n_ids]
    assert [(r.loss_to > r.loss_from) for r in rows] == [False, True, False]
    assert chat.assemble(table.limit(0), FILE).count() == 0 and chat.read_back(chat.assemble(table.limit(0), FILE), FILE).count() == 0
