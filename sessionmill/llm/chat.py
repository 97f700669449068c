"""Chat formatting at token level.

As text, a turn is written ``<turn>role``, newline, content, newline, ``</turn>``, newline. The control strings
that mark turns may occur inside contents and roles; there each gets one more backslash in front (and so does one
that already carries backslashes), which reading back removes. A newline always stands before
a closing mark, so content never runs into it.

As tokens, the marks are reserved ids beyond the vocabulary, and the role and content of each turn are encoded
separately between them; no text, whatever it says, yields a reserved id. Each turn is one row: its ids and the stretch
of them that counts for the loss (the content of an assistant's turn). Offsets in the conversation are prefix sums
over its turns, so a conversation of any length is never gathered: encoding happens before the
shuffle, row by row, and everything after it streams through sorted turns.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionmill.llm.frames import map_rows
from sessionmill.llm.packing import batches, encoder

OPEN, CLOSE = "<turn>", "</turn>"
HEADS = ("### System:", "### User:", "### Assistant:")  # marks of a widespread plain template, escaped as well
LEARNED = "assistant"
TURN_ID, BODY_ID, END_ID = 0, 1, 2  # added to the size of the vocabulary
_CONTROL = "|".join(map(re.escape, (OPEN, CLOSE, *HEADS)))
_ESCAPE = re.compile(rf"(?=\\*(?:{_CONTROL}))(?<!\\)")
_UNESCAPE = re.compile(rf"\\(\\*(?:{_CONTROL}))")


def escape(text: str) -> str:
    r"""One more backslash before each control string: ``</turn>`` becomes ``\</turn>``, ``\</turn>`` ``\\</turn>``."""
    return _ESCAPE.sub(r"\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def _line(role: str | None) -> str:
    """A role on one line; null and empty stay apart (a lone backslash-0 is null)."""
    return "\\0" if role is None else role.replace("\\", "\\\\").replace("\n", "\\n")


def _role(line: str) -> str | None:
    return None if line == "\\0" else re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], line)


def formatted(role: str | None, text: str) -> str:
    return f"{OPEN}{escape(_line(role))}\n{escape(text)}\n{CLOSE}\n"


SEGMENT = "conv_id long, turn long, role string, ids binary, n_ids long, loss_from long, loss_to long, chars long"


def _assemble(file: str):
    def run(stream):
        encode = encoder(file)
        base = encode.tokenizer.get_vocab_size()
        mark = lambda k: np.array([base + k], "<u4")
        for held in batches(stream, lambda row: escape(row["text"] or "")):
            roles = [escape(_line(row["role"])) for row, _ in held]
            for (row, text), role, head, body in zip(held, roles, encode.batch(roles), encode.batch([t for _, t in held])):
                ids = np.concatenate([mark(TURN_ID), head, mark(BODY_ID), body, mark(END_ID)])
                start = len(head) + 2
                learned = row["role"] == LEARNED
                yield (row["conv_id"], row["turn"], row["role"], ids.astype("<u4").tobytes(), len(ids), start if learned else 0,
                       start + len(body) if learned else 0, len(OPEN) + len(role) + len(text) + len(CLOSE) + 3)
    return run


def assemble(turns: DataFrame, file: str) -> DataFrame:
    """Turns (conv_id, turn, role, text) as tokens: SEGMENT and ``at``, the turn's offset in its conversation.

    ids: little-endian 32-bit numbers; loss_from, loss_to: the ids of the turn that count for the loss; chars: code points of the
    turn as text. Null text counts as empty; a null role stays null; null ids and turns form
    groups like others and come first. Turns with the same number are ordered by role and ids. No rows give no
    rows; other columns are not looked at.
    """
    plain = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    segments = map_rows(plain, _assemble(file), SEGMENT)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "ids")
    before = F.sum("n_ids").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_ids")
    return segments.withColumn("at", before)


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_turn(ids: np.ndarray, tokenizer, base: int) -> tuple[str | None, str]:
    """(role, text) of a turn's ids."""
    ends = np.flatnonzero(ids == base + BODY_ID)
    if not len(ids) or ids[0] != base + TURN_ID or ids[-1] != base + END_ID or len(ends) != 1:
        raise ValueError("not one whole turn")
    role = tokenizer.decode(ids[1:ends[0]].tolist(), skip_special_tokens=False)
    text = tokenizer.decode(ids[ends[0] + 1:-1].tolist(), skip_special_tokens=False)
    return _role(unescape(role)), unescape(text)


def _reader(file: str):
    def run(stream):
        tool = encoder(file).tokenizer
        base = tool.get_vocab_size()
        now, state = None, None

        def row():
            return now, state["n"], state["turns"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"]

        for r in stream:
            if state is None or r["conv_id"] != now:
                if state:
                    yield row()
                now, state = r["conv_id"], {"n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0}
            ids = np.frombuffer(r["ids"], "<u4")
            role, text = read_turn(ids, tool, base)
            state["n"] += 1
            state["turns"].update(f"{role or ''}\n{text}\n".encode("utf-8", "surrogatepass"))
            under_mask = ids[r["loss_from"]:r["loss_to"]]
            if len(under_mask):
                learned = unescape(tool.decode(under_mask.tolist(), skip_special_tokens=False))
                state["loss_chars"] += len(learned)
                state["loss"].update(learned.encode("utf-8", "surrogatepass"))
            state["chars"] += len(formatted(role, text))
        if state:
            yield row()
    return run


def read_back(segments: DataFrame, file: str) -> DataFrame:
    """One row per conversation, READ, from its tokens alone: turns as read, text under the loss mask, size as text.

    Turns stream through one task in order; only digests are held, so a conversation has no size limit.
    """
    # sorted as the window of ``assemble`` leaves them: by conversation and offset
    turns = segments.select("conv_id", "at", "ids", "loss_from", "loss_to").repartition("conv_id").sortWithinPartitions("conv_id", "at")
    return map_rows(turns, _reader(file), READ)
