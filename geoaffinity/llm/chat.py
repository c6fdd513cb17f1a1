"""Conversations as one text each, token ids, and a loss mask over the assistant's words.

A conversation is rendered whole and encoded once, with offsets. The character spans of assistant
turns are sorted, and so are the tokens' spans, so two binary searches per turn find its
tokens. The template's control strings are special tokens: no token reaches across a
turn's border, and inside texts the strings are escaped, so that reading back is exact.

Template: ``<s>``, then per turn ``<<SYS>>text<</SYS>>``, ``[INST]text[/INST]``, ``text</s>`` (assistant) or
``<<ROLE>>role<</ROLE>>text<</TURN>>`` for any other role.
"""

import os
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BEGIN = "<s>"
FRAMES = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("", "</s>")}
OTHER = ("<<ROLE>>", "<</ROLE>>", "<</TURN>>")
CONTROL = (BEGIN, *[c for f in FRAMES.values() for c in f if c], *OTHER)
TEXT = 1 << 18  # characters encoded at a time, or one longer conversation
FORMATTED = "formatted string, ids array<int>, starts array<int>, ends array<int>, loss array<boolean>"


def escape(text: str) -> str:
    r"""Text in which no control string occurs: ``\`` becomes ``\\``, and ``\|`` splits each string."""
    text = text.replace("\\", "\\\\")
    for c in CONTROL:
        text = text.replace(c, f"{c[0]}\\|{c[1:]}")
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "" if m[1] == "|" else m[1], text, flags=re.DOTALL)


def render(turns: Sequence[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation's text and the character spans of assistant texts in it."""
    parts, size, spans = [BEGIN], len(BEGIN), []
    for role, text in turns:
        body = escape(text)
        if role in FRAMES:
            opening, closing = FRAMES[role]
        else:
            opening, closing = f"{OTHER[0]}{escape(role)}{OTHER[1]}", OTHER[2]
        if role == "assistant":
            spans.append((size + len(opening), size + len(opening) + len(body)))
        parts += opening, body, closing
        size += len(opening) + len(body) + len(closing)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    opened = {f[0]: (role, f[1]) for role, f in FRAMES.items() if f[0]}
    turns, at = [], len(BEGIN)
    while at < len(formatted):
        mark = next((m for m in (*opened, OTHER[0]) if formatted.startswith(m, at)), "")
        role, closing = opened.get(mark, ("assistant", FRAMES["assistant"][1]))
        at += len(mark)
        if mark == OTHER[0]:
            stop = formatted.index(OTHER[1], at)
            role, closing, at = unescape(formatted[at:stop]), OTHER[2], stop + len(OTHER[1])
        stop = formatted.index(closing, at)
        turns.append((role, unescape(formatted[at:stop])))
        at = stop + len(closing)
    return turns


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: Sequence[tuple[int, int]]) -> np.ndarray:
    """Which tokens lie in one of the sorted spans."""
    low = np.searchsorted(ends, [a for a, _ in spans], "right")
    high = np.searchsorted(starts, [b for _, b in spans], "left")
    steps = np.zeros(len(starts) + 1, np.int64)
    np.add.at(steps, low, 1)
    np.add.at(steps, np.maximum(high, low), -1)
    return np.cumsum(steps[:-1]) > 0


def masked_text(formatted: str, starts: Sequence[int], ends: Sequence[int], loss: Sequence[bool]) -> str:
    """The text of all tokens under the mask, unescaped."""
    out, at = [], 0
    for a, b, under in zip(starts, ends, loss):
        if under and b > at:  # several tokens may share a character
            out.append((max(a, at), b))
            at = b
    return unescape("".join(formatted[a:b] for a, b in out))


def _encoder(tokenizer_file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import AddedToken, Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_file)
        tokenizer.add_special_tokens([AddedToken(c, normalized=False, special=True) for c in CONTROL])
        kinds = pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.bool_())

        def encoded(ids: pa.Array, texts: list[tuple[str, list]]) -> pa.RecordBatch:
            out = []
            for (text, spans), code in zip(texts, tokenizer.encode_batch([t for t, _ in texts],
                                                                         add_special_tokens=False)):
                at = np.array(code.offsets, np.int32).reshape(-1, 2)
                out.append((text, np.array(code.ids, np.int32), at[:, 0], at[:, 1],
                            loss_mask(at[:, 0], at[:, 1], spans)))
            return pa.RecordBatch.from_arrays(
                [ids, *[pa.array(list(c), k) for c, k in zip(zip(*out), kinds)]],
                names=["conv_id", "formatted", "ids", "starts", "ends", "loss"])

        for batch in batches:
            turns, texts, held, first = batch.column("turns"), [], 0, 0
            for k in range(batch.num_rows):
                texts.append(render([(t["role"], t["text"]) for t in turns[k].as_py()]))
                held += len(texts[-1][0])
                if held > TEXT or k == batch.num_rows - 1:  # offsets are large: a bounded text at a time
                    yield encoded(batch.column("conv_id").slice(first, k + 1 - first), texts)
                    texts, held, first = [], 0, k + 1

    return run


def format_chats(turns: DataFrame, tokenizer_file: str, *, conv_id: str = "conv_id", turn: str = "turn",
                 role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, formatted, ids, starts, ends (code points of each token), loss.

    Turns go by number; equal numbers by role, then text; a null number comes first. Null text or role is
    empty. Rows without a conv_id form one conversation. A conversation is the unit of
    work: it has to fit into a task's memory, as its output row does. An empty table gives an empty table.
    """
    empty = F.lit("")
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role), empty).alias("role"),
        F.coalesce(F.col(text), empty).alias("text")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    kind = whole.schema["conv_id"].dataType.simpleString()
    return whole.mapInArrow(_encoder(tokenizer_file), f"conv_id {kind}, {FORMATTED}")


def _slices(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    for first in range(0, batch.num_rows, rows):
        yield batch.slice(first, rows)


def read_back(chats: DataFrame) -> DataFrame:
    """conv_id, turns (role, text) and loss_text, from the formatted text, offsets and mask alone."""
    kind = chats.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        for batch in (part for whole in batches for part in _slices(whole, 64)):
            rows = batch.select(["formatted", "starts", "ends", "loss"]).to_pylist()
            turns = [[{"role": r, "text": t} for r, t in parse(row["formatted"])] for row in rows]
            loss = [masked_text(**row) for row in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array(turns, shape), pa.array(loss, pa.string()),
                 pa.array([len(row["formatted"]) for row in rows], pa.int64())],
                names=["conv_id", "turns", "loss_text", "formatted_chars"])

    return chats.drop("ids").mapInArrow(
        run, f"conv_id {kind}, turns array<struct<role string, text string>>, loss_text string, formatted_chars long")
