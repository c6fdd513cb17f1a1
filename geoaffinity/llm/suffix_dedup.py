"""Repeated byte strings: every byte covered by a string that starts anywhere else goes.

Suffixes of the corpus are range-partitioned by their leading tokens: the suffixes that start at
anchors (``repeats``), with the bytes before them, dealt by sampled splitters on the anchor's bytes. A bucket sorts the windows of its contexts by multikey quicksort: all windows are split
by their first 8-byte symbol, and only groups of equal ones go on to the next, so
neighbours that stay together to the end are equal. Splitters separate different leading tokens only, and
inside a task the group that a batch ends in is carried over, so no equal windows are parted by a
boundary. Anchors with many places have whole windows as leading tokens.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..runtime import spread
from .grouped import group_starts, whole_groups
from .repeats import Windows, remove_repeats
from .text import text_bytes

BYTES = 200
GRAM = 32
SYMBOL = 8
SORTED = 1 << 20  # windows sorted at a time, about
ANSWER = "key long, one long, two long, places long, offs array<long>"


def equal_strings(data: np.ndarray, start: np.ndarray, group: np.ndarray, size: int) -> np.ndarray:
    """Which strings of ``size`` bytes equal another one of their group: multikey quicksort with
    8-byte symbols, all groups side by side; strings that are alone leave."""
    symbols = np.ndarray((max(0, len(data) - SYMBOL + 1),), ">u8", np.ascontiguousarray(data), strides=(1,))
    live = np.arange(len(start))
    part = group
    for depth in [*range(0, size - SYMBOL, SYMBOL), size - SYMBOL]:
        symbol = symbols[start[live] + depth].astype(np.uint64)
        order = np.lexsort((symbol, part))
        live, symbol, part = live[order], symbol[order], part[order]
        new = np.ones(len(live), bool)
        new[1:] = (part[1:] != part[:-1]) | (symbol[1:] != symbol[:-1])
        lone = new & np.append(new[1:], True)
        part = np.cumsum(new)[~lone]
        live = live[~lone]
        if not len(live):
            break
    out = np.zeros(len(start), bool)
    out[live] = True
    return out


def _compare(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, ["suffix"], 2000):
            own = group_starts(table, ["suffix", "one", "two"])  # equal contexts of several map tasks
            places = np.add.reduceat(table.column("places").to_numpy(), own)
            bucket = np.searchsorted(starts, own, "right")
            crowd = np.bincount(bucket)[bucket]
            stay = (crowd > 1) | (places > 1)
            rows, places, bucket, crowd = own[stay], places[stay], bucket[stay], crowd[stay]
            picked = table.take(pa.array(rows))
            data, at = text_bytes(picked.column("content").combine_chunks())
            count, lead = picked.column("windows").to_numpy(), picked.column("lead").to_numpy()
            first = np.cumsum(count) - count
            step = np.arange(int(count.sum())) - np.repeat(first, count)
            again = np.repeat(places > 1, count)
            many = np.flatnonzero(np.repeat(crowd > 1, count))
            if len(many):
                # equal windows have their anchor at the same place: few places at a time bound the memory
                shift = (np.repeat(lead, count)[many] - step[many]).astype(np.int16)
                for part in np.array_split(np.arange(-1, size), -(-len(many) // SORTED)):
                    few = many[(shift >= part[0]) & (shift <= part[-1])] if len(part) else many[:0]
                    if len(few):
                        where = np.searchsorted(first, few, "right") - 1
                        group = bucket[where] * (size + 2) + lead[where] - step[few]
                        again[few] |= equal_strings(data, at[where] + step[few], group, size)
            opens, closes = again.copy(), again.copy()
            opens[1:] &= ~again[:-1] | (step[1:] == 0)
            closes[:-1] &= ~again[1:] | (step[1:] == 0)
            a, b = np.flatnonzero(opens), np.flatnonzero(closes)
            context = np.searchsorted(first, a, "right") - 1
            found, sizes = np.unique(context, return_counts=True)
            offs = np.stack([step[a], step[b] + 1], axis=1).ravel()
            lists = pa.ListArray.from_arrays(
                pa.array(np.append(0, np.cumsum(2 * sizes)), pa.int32()), pa.array(offs, pa.int64()))
            out = picked.select(["key", "one", "two"]).take(pa.array(found)).combine_chunks()
            columns = [c.combine_chunks() for c in out.columns]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(places[found]), lists],
                                             names=["key", "one", "two", "places", "offs"])

    return run


def _removed(answer: tuple, did: int, at: int) -> Iterator[tuple[int, int]]:
    offs = answer[0]
    for a, b in zip(offs[::2], offs[1::2]):
        yield at + a, at + b


def kept_bytes(texts: list[bytes], ranges: list | None) -> Iterator[tuple[bytes, list]]:
    for k, text in enumerate(texts):
        own = ranges[k] if ranges is not None else []
        if own:
            text = b"".join([text[a:b] for a, b in zip([0, *[r[1] for r in own]], [*[r[0] for r in own], len(text)])])
        yield text, own


def digest(texts, ranges) -> dict[str, pa.Array]:
    rows = [(len(t), len(t) - len(k), len(own), hashlib.sha256(k).hexdigest())
            for t, (k, own) in zip(texts, kept_bytes(texts, ranges))]
    n, r, s, h = zip(*rows) if rows else [()] * 4
    return {"n_bytes": pa.array(list(n), pa.int64()), "n_removed": pa.array(list(r), pa.int64()),
            "n_spans": pa.array(list(s), pa.int64()), "kept_sha256": pa.array(list(h), pa.string())}


DIGEST = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remains(texts, ranges) -> dict[str, pa.Array]:
    rows = list(kept_bytes(texts, ranges))
    return {"n_bytes": pa.array([len(t) for t in texts], pa.int64()),
            "removed": pa.array([[list(r) for r in own] for _, own in rows], pa.list_(pa.list_(pa.int64()))),
            "kept": pa.array([k for k, _ in rows], pa.binary())}


REMAINS = "n_bytes long, removed array<array<long>>, kept binary"


def dedup_bytes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = BYTES,
                gram: int | None = None, hot: int = 100_000, finish=remains, finished: str = REMAINS) -> DataFrame:
    """One row per document: doc_id, n_bytes, removed (byte ranges), kept (or what ``finish`` gives).

    A byte of the UTF-8 text goes if a string of ``size`` bytes around it also starts anywhere else, in the
    same document or another; all copies lose it. Strings are judged on the input and do not cross
    documents. Null text is empty. Rows that share an id are answered each by its own text; equal rows are copies
    of one another and lose what they share. Ids are integers; null is allowed.
    """
    gram = gram or GRAM
    windows = Windows(size, gram, False, hot)
    suffix = F.when(F.col("lead") < 0, F.col("content")).otherwise(
        F.substring("content", F.col("lead").cast("int") + 1, F.lit(gram)))

    def compare(contexts: DataFrame) -> DataFrame:
        ranged = spread(contexts.withColumn("suffix", suffix), "bucket")
        return ranged.sortWithinPartitions("suffix", "one", "two").mapInArrow(_compare(size), ANSWER)

    return remove_repeats(docs, windows, doc_id=doc_id, text=text, compare=compare, removed=_removed,
                          removed_columns=["offs"], finish=finish, finished=finished, split=True)
