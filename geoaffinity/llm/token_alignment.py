"""Which tokens of two tokenizers cover the same bytes, in every document and over the corpus.

Documents are tokenised whole by both. Wherever tokens of both end at the same byte and the next token of both starts with
a space, the document is cut; the ends are compared, not assumed. What lies between two cuts is a window, a
few token ids on each side that mean the same wherever they stand, so a window is aligned once and remembered by its id tuples.

Two passes: the first tokenises, writes the ids packed and counts how often each pair of ids is linked; the second
reads the ids back and prices each link with the corpus-wide counts. These are broadcast in shards of a
bounded number of pairs, with a pass over the packed ids for each shard.
"""

import functools
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..runtime import cut, scratch_path
from .text import row_blocks, text_bytes

SHARD = 1 << 22  # id pairs broadcast at a time
TEXT = 1 << 20  # bytes of text tokenised at a time, or one longer text
WINDOWS = 300_000  # windows remembered
IDS = 1 << 22  # ids in remembered windows
BLANK = 50_000  # white space of this length is beyond the pattern engine of the faster library
LONG_BLANK = re.compile(rf"\s{{{BLANK}}}")

# Fixed value: the word pattern of the byte-level tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary entry stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


class ByteBpe:
    """A byte-level BPE vocabulary file: the ids of a text, and the bytes of each id."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["id"] for t in spec["added_tokens"]}
        byte = byte_alphabet()
        entries = {i: bytes(byte[c] for c in token) for token, i in spec["model"]["vocab"].items() if i not in special}
        self.path, self.size = path, 1 + max([*entries, *special])
        self.bytes = [entries.get(i, b"") for i in range(self.size)]
        # An entry's id is its merge rank, so the faster library gives the same ids.
        self.fast = tiktoken.Encoding("entries", pat_str=PATTERN, mergeable_ranks={b: i for i, b in entries.items()},
                                      special_tokens={})

    @functools.cached_property
    def slow(self):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(self.path)
        tokenizer.encode_special_tokens = True
        return tokenizer

    def encode(self, text: str) -> list[int]:
        if len(text) > BLANK and LONG_BLANK.search(text):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


class PieceBpe:
    """A sentencepiece model: the ids of a text, and the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.vocab_size()
        self.bytes = [bytes([int(self.model.id_to_piece(i)[1:-1], 16)]) if self.model.is_byte(i)
                      else self.model.id_to_piece(i).replace("▁", " ").encode() for i in range(self.size)]

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text)


@functools.cache
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


@functools.cache
def piece_bpe(path: str) -> PieceBpe:
    return PieceBpe(path)


class Side:
    """What aligning needs to know of a vocabulary."""

    def __init__(self, entries: list[bytes]):
        self.kind = np.dtype(np.uint16 if len(entries) < 1 << 16 else np.uint32)
        self.size = np.array([len(e) for e in entries], np.int64)
        self.spaced = np.array([e.startswith(b" ") for e in entries])

    def cuts(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where documents may be cut: numbers of tokens before, and bytes before. Ends of documents are among them."""
        may = np.append(self.spaced[ids[1:]], True)
        may[at[1:][at[1:] > 0] - 1] = True
        last = np.flatnonzero(may)
        return last + 1, np.cumsum(self.size[ids])[last]


def windows(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, left: Side, right: Side):
    """Ends of windows in both id sequences, and the first window of each document (n + 1).

    ``at`` and ``bt`` are the documents' borders; both sequences of a document stand for the same bytes.
    """
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    token_a, byte_a = left.cuts(a, at)
    token_b, byte_b = right.cuts(b, bt)
    there = np.minimum(np.searchsorted(byte_b, byte_a), len(byte_b) - 1)
    same = byte_b[there] == byte_a
    ends = token_a[same]
    return ends, token_b[there[same]], np.searchsorted(ends, at, "right")


def _ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of runs with these beginnings and sizes, end to end."""
    return np.arange(int(sizes.sum())) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)


def align(a: np.ndarray, b: np.ndarray, left: Side, right: Side) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Alignment of token sequences of the same bytes: the byte at which each link ends and the tokens it links (places
    in a and b); the bytes at which groups end, where tokens of both do.

    A stretch between two neighbouring ends, of whichever side, is covered by one token of each, and a pair of tokens that
    overlap covers one such stretch.
    """
    end_a, end_b = np.cumsum(left.size[a]), np.cumsum(right.size[b])
    both = np.concatenate([end_a, end_b])
    both.sort(kind="stable")  # two sorted runs
    again = np.zeros(len(both), bool)
    again[1:] = both[1:] == both[:-1]
    ends, groups = both[~again], both[again]
    return ends, np.searchsorted(end_a, ends), np.searchsorted(end_b, ends), groups


class Memo(dict):
    """Numbers of windows by their packed id tuples; new ones are aligned, many at a time."""

    def __init__(self, left: Side, right: Side, most: int, texts: bool):
        self.left, self.right, self.most, self.keep = left, right, most, texts
        self.kind = max(left.kind, right.kind)
        if texts:
            numbers = [str(i).encode() for i in range(max(len(left.size), len(right.size)))]
            width = len(numbers[-1]) + 1
            self.digits = np.frombuffer(b"".join(n.ljust(width) for n in numbers), np.uint8).reshape(-1, width)
            self.length = np.array([len(n) for n in numbers])
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.texts: list[bytes] = []
        self.links, self.sizes, self.held = np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def codes(self, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
        """The number of each window, by the ends of windows in both sequences."""
        size_a, size_b = np.diff(ends_a, prepend=0), np.diff(ends_b, prepend=0)
        number = np.arange(len(ends_a))
        packed = np.full(len(a) + len(b) + len(ends_a), np.iinfo(self.kind).max, self.kind)  # no id between the sides
        packed[np.arange(len(a)) + np.repeat(ends_b - size_b + number, size_a)] = a
        packed[np.arange(len(b)) + np.repeat(ends_a + number + 1, size_b)] = b
        raw, stops = packed.tobytes(), ((ends_a + ends_b + number + 1) * self.kind.itemsize).tolist()
        keys = [raw[i:j] for i, j in zip([0, *stops[:-1]], stops)]
        found = np.array([self.get(k, -1) for k in keys], np.int64)
        fresh = []
        for k in np.flatnonzero(found < 0).tolist():
            known = len(self)
            found[k] = self.setdefault(keys[k], known)
            if found[k] == known:
                fresh.append(k)
        if fresh:
            self._learn(a, b, ends_a, ends_b, size_a, size_b, np.array(fresh))
        return found

    def _learn(self, a, b, ends_a, ends_b, size_a, size_b, new: np.ndarray) -> None:
        a = a[_ranges((ends_a - size_a)[new], size_a[new])]
        b = b[_ranges((ends_b - size_b)[new], size_b[new])]
        ends, in_a, in_b, groups = align(a, b, self.left, self.right)
        stops = np.cumsum(self.left.size[a])[np.cumsum(size_a[new]) - 1]  # bytes at which windows end
        self.links = np.concatenate([self.links, a[in_a].astype(np.int64) << 32 | b[in_b].astype(np.int64)])
        self.sizes = np.concatenate([self.sizes, np.diff(np.searchsorted(ends, stops, "right"), prepend=0)])
        self.held += len(a) + len(b)
        if self.keep:
            self._write(a, b, groups, stops)

    def _write(self, a: np.ndarray, b: np.ndarray, groups: np.ndarray, stops: np.ndarray) -> None:
        """Texts of the windows: ids of a, |, ids of b, and ; between groups."""
        end_a, end_b = np.cumsum(self.left.size[a]), np.cumsum(self.right.size[b])
        last_a, last_b = np.searchsorted(end_a, groups), np.searchsorted(end_b, groups)  # of each group
        group_a, group_b = np.searchsorted(groups, end_a), np.searchsorted(groups, end_b)
        before_b = np.append(0, last_b[:-1] + 1)
        place_a, place_b = np.arange(len(a)) + before_b[group_a], np.arange(len(b)) + last_a[group_b] + 1
        ids, mark = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[place_a], ids[place_b] = a, b
        mark[place_a[last_a]], mark[place_b[last_b]] = ord("|"), ord(";")
        final = place_b[np.searchsorted(end_b, stops)]  # nothing stands behind a window
        size = self.length[ids]
        shown = self.digits[ids]
        shown[np.arange(len(ids)), size] = mark
        size[final] -= 1
        raw = shown[np.arange(shown.shape[1]) <= size[:, None]].tobytes()
        at = np.cumsum(size + 1)[final].tolist()
        self.texts += [raw[i:j] for i, j in zip([0, *at[:-1]], at)]

    @property
    def full(self) -> bool:
        return len(self) > self.most or self.held > IDS


def _packed(ids: np.ndarray, at: np.ndarray) -> pa.Array:
    size = ids.dtype.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [
        None, pa.py_buffer((at * size).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(ids))]).cast(pa.binary())


def _tokenised(a_file: str, b_file: str, remembered: int):
    names = ["doc_id", "a", "b", "n_a", "n_b", "n_groups", "groups_sha256", "pair", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        one, two = byte_bpe(a_file), piece_bpe(b_file)
        left, right = Side(one.bytes), Side(two.bytes)
        memo, times, id_type = Memo(left, right, remembered, texts=True), np.zeros(0, np.int64), pa.null()

        def flush() -> Iterator[pa.RecordBatch]:
            pair, where = np.unique(memo.links, return_inverse=True)
            n = np.zeros(len(pair), np.int64)
            np.add.at(n, where, np.repeat(times, memo.sizes))
            size = len(pair)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(size, id_type), pa.nulls(size, pa.binary()), pa.nulls(size, pa.binary()),
                 *[pa.nulls(size, pa.int64())] * 3, pa.nulls(size, pa.string()), pa.array(pair), pa.array(n)], names=names)
            memo.reset()

        for batch in batches:
            id_type = batch.column("doc_id").type
            raw, borders = text_bytes(batch.column("text"))
            for low, high in row_blocks(borders, TEXT):
                ids_a, ids_b = [], []
                for r in range(low, high):
                    given = raw[borders[r]: borders[r + 1]].tobytes()
                    x, y = [], []
                    if given:
                        text = given.decode()
                        x, y = one.encode(" " + text), two.encode(text)
                        given = b" " + given
                        if b"".join(map(one.bytes.__getitem__, x)) != given or b"".join(map(two.bytes.__getitem__, y)) != given:
                            x, y = [], []
                    ids_a.append(x)
                    ids_b.append(y)
                at, bt = (np.cumsum([0, *map(len, ids)]) for ids in (ids_a, ids_b))
                a = np.fromiter(chain.from_iterable(ids_a), left.kind, at[-1])
                b = np.fromiter(chain.from_iterable(ids_b), right.kind, bt[-1])
                ends_a, ends_b, first = windows(a, at, b, bt, left, right)
                codes = memo.codes(a, b, ends_a, ends_b)
                grown = np.bincount(codes, minlength=len(memo))
                grown[: len(times)] += times
                times = grown
                texts, groups, digests, codes = memo.texts, [], [], codes.tolist()
                for i, j in zip(first[:-1].tolist(), first[1:].tolist()):
                    text = b";".join([texts[c] for c in codes[i:j]])
                    groups.append(text.count(b"|"))
                    digests.append(sha256(text).hexdigest() if text else "")
                size = high - low
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(low, size), _packed(a, at), _packed(b, bt), pa.array(np.diff(at)),
                     pa.array(np.diff(bt)), pa.array(groups, pa.int64()), pa.array(digests, pa.string()),
                     pa.nulls(size, pa.int64()), pa.nulls(size, pa.int64())], names=names)
                if memo.full:
                    yield from flush()
                    times = np.zeros(0, np.int64)
        if len(memo):
            yield from flush()

    return run


def _priced(a_file: str, b_file: str, remembered: int, shard, out: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = shard.value
        left, right = Side(byte_bpe(a_file).bytes), Side(piece_bpe(b_file).bytes)
        memo = Memo(left, right, remembered, texts=False)
        sums = np.zeros((2, 0), np.int64)

        for batch in batches:
            (raw_a, at), (raw_b, bt) = text_bytes(batch.column("a")), text_bytes(batch.column("b"))
            for low, high in row_blocks(at, TEXT):
                a = np.frombuffer(raw_a[at[low]: at[high]].tobytes(), left.kind)
                b = np.frombuffer(raw_b[bt[low]: bt[high]].tobytes(), right.kind)
                ends_a, ends_b, first = windows(a, (at[low: high + 1] - at[low]) // left.kind.itemsize,
                                                b, (bt[low: high + 1] - bt[low]) // right.kind.itemsize, left, right)
                codes = memo.codes(a, b, ends_a, ends_b)
                known = sums.shape[1]
                if len(memo) > known:  # price the new windows
                    sizes = memo.sizes[known:]
                    links = memo.links[len(memo.links) - int(sizes.sum()):]
                    where = np.minimum(np.searchsorted(pair, links), max(0, len(pair) - 1))
                    hit = pair[where] == links
                    start = np.cumsum(sizes) - sizes
                    new = [np.add.reduceat(np.where(hit, v[where], 0).astype(np.int64), start) for v in (best, n)]
                    sums = np.concatenate([sums, new], axis=1)
                run_sums = np.concatenate([np.zeros((2, 1), np.int64), np.cumsum(sums[:, codes], axis=1)], axis=1)
                per_doc = run_sums[:, first[1:]] - run_sums[:, first[:-1]]
                rest = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays(
                    [*[rest.column(c) for c in out], pa.array(per_doc[0]), pa.array(per_doc[1])],
                    names=[*out, "n_best", "count_sum"])
                if memo.full:
                    memo.reset()
                    sums = np.zeros((2, 0), np.int64)

    return run


def tokenised(docs: DataFrame, a_file: str, b_file: str, *, doc_id: str = "doc_id", text: str = "text",
              remembered: int = WINDOWS) -> DataFrame:
    """A table of two kinds of rows: documents (``pair`` is null) with packed ids, numbers of tokens and groups; and
    partial counts ``n`` of linked id pairs (a << 32 | b)."""
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    path = scratch_path(docs.sparkSession, "cut")
    src.mapInArrow(_tokenised(a_file, b_file, remembered), f"doc_id {kind}, a binary, b binary, n_a long, n_b long, n_groups long, "
                   "groups_sha256 string, pair long, n long").withColumn(
        "row", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def pair_counts(table: DataFrame) -> DataFrame:
    """pair, n (links in the corpus), best (whether no pair with the same right id has more). A right id has at
    most as many pairs as the left vocabulary has ids."""
    counts = table.where("pair is not null").groupBy("pair").agg(F.sum("n").alias("n"))
    right = F.col("pair").bitwiseAND(0xFFFFFFFF)
    return counts.withColumn("best", F.col("n") == F.max("n").over(W.partitionBy(right)))


def aligned(docs: DataFrame, a_file: str, b_file: str, *, shard: int = SHARD, remembered: int = WINDOWS,
            **columns) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``a_file`` is a byte-level BPE (a space is put before the text), ``b_file`` a sentencepiece model that adds the space itself.
    Null and empty texts, and those whose tokens do not give the bytes of the text back, have no tokens: zeros, and an empty
    ``groups_sha256``. Rows are never merged, whatever their ids; ids may be null; other columns do not matter; an
    empty table gives an empty table. A text has to fit into a task. ``shard`` and ``remembered`` (windows kept by a task) do not
    change the result.
    """
    spark: SparkSession = docs.sparkSession
    table = tokenised(docs, a_file, b_file, remembered=remembered, **columns)
    counts = cut(pair_counts(table))
    rows = table.where("pair is null").select("row", "doc_id", "a", "b", "n_a", "n_b", "n_groups", "groups_sha256")
    out = ["row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256"]
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in out) + ", n_best long, count_sum long"
    shards = max(1, -(-counts.count() // shard))
    passes = []
    for k in range(shards):
        some = counts.where(F.pmod(F.xxhash64("pair"), F.lit(shards)) == k).toArrow()
        pair, n, best = (some.column(c).to_numpy() for c in ("pair", "n", "best"))
        order = np.argsort(pair)
        value = pair[order], n[order], best[order]
        if not len(pair):
            value = np.full(1, -1), np.zeros(1, np.int64), np.zeros(1, bool)
        sent = spark.sparkContext.broadcast(value)
        passes.append(rows.mapInArrow(_priced(a_file, b_file, remembered, sent, out), schema))
        if shards > 1:  # one shard at a time is held
            passes[-1] = cut(passes[-1])
            sent.destroy()
    found = functools.reduce(DataFrame.unionByName, passes)
    if shards > 1:
        found = found.groupBy(*out).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", (F.col("n_a") + F.col("n_b") - F.col("n_groups")).alias("n_links"),
                        "n_best", "count_sum", "groups_sha256")
