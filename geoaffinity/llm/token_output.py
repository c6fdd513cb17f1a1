"""Token ids of documents, packed into 64-bit words (Simple-8b) and read back.

Documents are range-partitioned by id and encoded partition by partition, so the files
hold all ids in ascending document order without any global sort in one task. A row of a
file is a chunk of whole documents: their ids and lengths, the packed words, the
offset of each block of ``BLOCK`` token ids in the words, and escapes.

A packed word has a selector in its upper 4 bits and ``COUNTS[selector]`` ids of equal width in the
lower 60. Selector 0 points to an escape, an id that needs more than 60 bits. Blocks are
packed on their own, so a reader can start at any block, and all words that
share a selector are unpacked by one shift and mask.

The files are Parquet written and committed by Spark: a lost executor costs a task, not a file.
"""

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from ..runtime import scratch_path
from .text import PIECE, SpanHash, row_blocks, text_bytes

COUNTS = (0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)  # by selector; 60 // count bits each
BLOCK = 1024  # ids
CHUNK = 1 << 18  # ids, or one longer document
CACHE = 800_000  # distinct pieces of text remembered by a Python worker
JOINED = 500  # pieces that go through the tokenizer in one string


# --- coding -----------------------------------------------------------------------

def _windows(width: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each count, smallest first, the greatest width among so many ids from each on."""
    most, done = {1: width}, 1
    yield 1, width
    for count in sorted(COUNTS[1:])[1:]:
        head = most[done]
        while done < count:  # grow the window by windows known already
            step = max(k for k in most if k <= count - done)
            tail = np.full_like(head, 255)
            tail[: len(head) - done] = most[step][done:]
            head, done = np.maximum(head, tail), done + step
        most[count] = head
        yield count, head


_POWERS = np.uint64(1) << np.arange(60, dtype=np.uint64)
_SMALL = np.maximum(np.searchsorted(_POWERS, np.arange(1 << 16, dtype=np.uint64), "right"), 1).astype(np.uint8)


def pack(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, the first word of each block, and escapes, of unsigned 64-bit ids."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.uint64)
    wide = np.flatnonzero(ids >> np.uint64(60))
    width = _SMALL[np.minimum(ids, len(_SMALL) - 1).astype(np.int64)]
    large = np.flatnonzero(ids >= len(_SMALL))
    width[large] = np.searchsorted(_POWERS, ids[large], "right")
    width[wide] = 254
    place = np.arange(n)
    room = np.minimum(block - place % block, n - place)
    best = np.zeros(n, np.int64)  # ids in the word that starts here; 0: an escape
    for count, most in _windows(width):
        fits = (most <= 60 // count) & (count <= room)
        if not fits.any():
            break
        best[fits] = count
    step = np.maximum(best, 1)
    at = np.arange(0, n, block)
    stop = np.minimum(at + block, n)
    rounds, live = [], at
    while len(live):  # all blocks side by side, one word each
        rounds.append(live)
        live, stop = live + step[live], stop
        inside = live < stop
        live, stop = live[inside], stop[inside]
    starts = np.sort(np.concatenate(rounds))
    counts, words = best[starts], np.zeros(len(starts), np.uint64)
    for selector, count in enumerate(COUNTS):
        rows = np.flatnonzero(counts == count)
        if not len(rows):
            continue
        if selector == 0:
            words[rows] = np.searchsorted(wide, starts[rows]).astype(np.uint64)
            continue
        word = np.full(len(rows), selector << 60, np.uint64)
        for k in range(count):
            word |= ids[starts[rows] + k] << np.uint64(k * (60 // count))
        words[rows] = word
    return words, np.searchsorted(starts, at).astype(np.int32), ids[wide]


def unpack(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """The ids of any run of whole words."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = np.maximum(np.array(COUNTS, np.int64)[selectors], 1)
    first = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for selector, count in enumerate(COUNTS):
        rows = np.flatnonzero(selectors == selector)
        if not len(rows):
            continue
        if selector == 0:
            out[first[rows]] = escapes[words[rows].astype(np.int64)]
            continue
        bits = 60 // count
        for k in range(count):
            out[first[rows] + k] = (words[rows] >> np.uint64(k * bits)) & np.uint64((1 << bits) - 1)
    return out


# --- encoding ---------------------------------------------------------------------

#: Bytes after a space that are certain not to begin white space.
_SOLID = np.zeros(256, bool)
_SOLID[0x21:0x7F] = True
_SOLID[0xC3:] = True
_SOLID[0xE1:0xE4] = False


class PieceEncoder:
    """Encodes texts piece by piece; each distinct piece goes through the tokenizer once.

    The tokenizer splits text before every single space that something visible follows and
    never merges across, so pieces cut there encode as they do in the whole text.
    """

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.hash = SpanHash(1)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        #: bytes of each id: a byte-level token has one character per byte
        self.width = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)], np.int64)
        self.known: dict[bytes, int] = {}
        self.ids, self.first, self.uses = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, np.int32)

    def _forget(self) -> None:
        """Keep only the pieces that several blocks of text had, half of the cache at most."""
        kept = np.flatnonzero(self.uses > 1)
        if len(kept) > CACHE // 2:
            kept = kept[:0]
        size = self.first[kept + 1] - self.first[kept]
        before = np.cumsum(size) - size
        self.ids = self.ids[np.repeat(self.first[kept] - before, size) + np.arange(int(size.sum()))]
        self.first = np.concatenate(([0], np.cumsum(size)))
        names = list(self.known)
        self.known = {names[k]: i for i, k in enumerate(kept.tolist())}
        self.uses = np.ones(len(kept), np.int32)

    def _look_up(self, pieces: list[bytes], plain: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Entries of distinct pieces; ``plain`` ones start like a cut, ``size`` is in bytes."""
        if len(self.known) > CACHE:
            self._forget()
        known, old = self.known, len(self.known)
        entry = np.array([known.setdefault(p, len(known)) for p in pieces], np.int64)
        new = np.flatnonzero(entry >= old)
        if len(new):
            new = new[np.argsort(entry[new], kind="stable")]
            new = new[np.diff(entry[new], prepend=old - 1) > 0]
            ids, sizes = self._code([pieces[k] for k in new.tolist()], plain[new], size[new])
            self.ids = np.concatenate([self.ids, ids])
            self.first = np.concatenate([self.first, np.cumsum(sizes) + self.first[-1]])
            self.uses = np.concatenate([self.uses, np.zeros(len(sizes), np.int32)])
        self.uses[entry] += 1  # each piece is looked up once a block
        return entry

    def _code(self, pieces: list[bytes], plain: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, end to end, and the number of ids of each.

        Pieces that start like a cut (a space and something visible) go through the tokenizer joined, and
        the ids are told apart by their numbers of bytes; the others go alone.
        """
        alone, joined = np.flatnonzero(~plain), np.flatnonzero(plain)
        together = [pieces[k] for k in joined.tolist()] if len(alone) else pieces
        runs = [pieces[k] for k in alone.tolist()]
        runs += [b"".join(together[i: i + JOINED]) for i in range(0, len(together), JOINED)]
        codes = self.tokenizer.encode_batch_fast([r.decode() for r in runs], add_special_tokens=False)
        flat = np.array([k for code in codes for k in code.ids], np.int32)
        order = np.concatenate([alone, joined])
        last = np.searchsorted(np.cumsum(self.width[flat]), np.cumsum(size[order]), "right")
        sizes = np.empty(len(pieces), np.int64)
        sizes[order] = np.diff(last, prepend=0)
        start = np.empty(len(pieces), np.int64)
        start[order] = last - sizes[order]
        before = np.cumsum(sizes) - sizes
        return flat[np.repeat(start - before, sizes) + np.arange(len(flat))], sizes

    def _differ(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, model: np.ndarray) -> bool:
        """Whether some piece is not the piece ``model`` stands for: the first and last 8 bytes say
        it for up to 16 bytes, all others are compared for more."""
        size = ends - starts
        padded = np.concatenate([np.zeros(8, np.uint8), raw, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(raw) + 9,), "<u8", padded, strides=(1,))
        head = eight[starts + 8] << (np.uint64(8) * (8 - np.minimum(size, 8)).astype(np.uint64))
        tail = np.where(size > 8, eight[ends], 0)
        if any(not np.array_equal(x, x[model]) for x in (size, head, tail)):
            return True
        long = np.flatnonzero((size > 16) & (model != np.arange(len(model))))
        inner = size[long] - 16
        total, k = np.cumsum(inner), 0
        while k < len(long):  # a bounded number of bytes, or one longer piece
            stop = max(k + 1, int(np.searchsorted(total, total[k] - inner[k] + PIECE, "right")))
            some, n = long[k:stop], inner[k:stop]
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + 8
            if not np.array_equal(raw[np.repeat(starts[some], n) + step], raw[np.repeat(starts[model[some]], n) + step]):
                return True
            k = stop
        return False

    def encode(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, end to end, and the number of ids of each row."""
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(len(at) - 1, np.int64)
        begins = np.zeros(len(raw), bool)
        begins[:-1] = (raw[:-1] == 32) & _SOLID[raw[1:]]
        plain = begins.copy()
        begins[at[:-1][at[:-1] < len(raw)]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(raw))
        _, sample, which = np.unique(self.hash.bytes(raw, starts, ends), return_index=True, return_inverse=True)
        if self._differ(raw, starts, ends, sample[which]):  # two pieces share a hash
            sample = which = np.arange(len(starts))
        text, low, high = raw.tobytes(), starts[sample], ends[sample]
        entry = self._look_up([text[a:b] for a, b in zip(low.tolist(), high.tolist())], plain[low], high - low)
        begin, size = self.first[entry], np.diff(self.first)[entry]
        begin, size = begin[which], size[which]
        before = np.cumsum(size) - size
        out = self.ids[np.repeat(begin - before, size) + np.arange(int(size.sum()))]
        edge = np.append(before, len(out))[np.searchsorted(starts, at)]
        return out, np.diff(edge)


@lru_cache(maxsize=1)
def worker_encoder(tokenizer_file: str) -> PieceEncoder:
    """The encoder of this Python worker, which keeps it from task to task. Ids do not depend on what it remembers."""
    return PieceEncoder(tokenizer_file)


def _chunks(tokenizer_file: str, end_id: int | None, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = worker_encoder(tokenizer_file), TaskContext.get().partitionId()
        ids, sizes, names, waiting, start, number = [], [], [], 0, 0, 0

        def chunk() -> pa.RecordBatch:
            flat, lengths = np.concatenate(ids), np.concatenate(sizes)
            words, offsets, escapes = pack(flat)
            cols = [[part], [number], [start], [len(flat)], [pa.concat_arrays(names)], [lengths.tolist()],
                    [words.astype("<u8").tobytes()], [offsets.tolist()], [escapes.astype("<u8").tobytes()]]
            cols[4] = pa.ListArray.from_arrays(pa.array([0, len(lengths)], pa.int32()), cols[4][0])
            return pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, schema)],
                schema=schema)

        for batch in batches:
            raw, at = text_bytes(batch.column("text"))
            for a, b in row_blocks(at, 2 * PIECE):
                flat, lengths = encoder.encode(raw[at[a]: at[b]], at[a: b + 1] - at[a])
                if end_id is not None:
                    flat = np.insert(flat, np.cumsum(lengths), end_id)
                    lengths = lengths + 1
                ids.append(flat)
                sizes.append(lengths)
                names.append(batch.column("doc_id").slice(a, b - a))
                waiting += len(flat)
                if waiting >= CHUNK:
                    yield chunk()
                    start, number = start + waiting, number + 1
                    ids, sizes, names, waiting = [], [], [], 0
        if ids:
            yield chunk()

    return run


def _schema(id_type: T.DataType) -> T.StructType:
    return T.StructType.fromDDL(
        f"part int, chunk int, start long, n long, doc_ids array<{id_type.simpleString()}>, "
        "lengths array<long>, words binary, blocks array<int>, escapes binary")


def write_tokens(docs: DataFrame, path: str, tokenizer_file: str, *, doc_id: str = "doc_id",
                 text: str = "text", end_id: int | None = None) -> None:
    """Write the token ids of ``docs`` below ``path``, in ascending id order.

    A null id sorts first. Null text is empty: its row holds the end id alone (or nothing, without one). Rows that
    share an id follow one another in text order. An empty table writes an empty file set.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = _schema(src.schema["doc_id"].dataType)
    ordered = src.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_chunks(tokenizer_file, end_id, to_arrow_schema(schema)), schema).write.parquet(path)


def read_tokens(spark: SparkSession, path: str, digest) -> DataFrame:
    """doc_id, start, n_tokens and ``ids_crc32`` of every document in the files.

    ``start`` counts all ids in the files before the document: the chunk's place in its
    partition plus the totals of the partitions before, one row per partition.
    """
    chunks = spark.read.parquet(path)
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    totals = chunks.groupBy("part").agg(F.sum("n").alias("total")).select(
        "part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    kind = chunks.schema["doc_ids"].dataType.elementType.simpleString()
    out = f"doc_id {kind}, start long, n_tokens long, {digest[0]} {digest[1]}"
    return chunks.join(totals, "part").select(
        (F.col("base") + F.col("start")).alias("start"), "doc_ids", "lengths", "words", "escapes"
    ).mapInArrow(_reader(digest), out)


def _reader(digest):
    name, _, of = digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                words = np.frombuffer(row["words"].as_buffer(), "<u8")
                ids = unpack(words, np.frombuffer(row["escapes"].as_buffer(), "<u8"))
                lengths = np.asarray(row["lengths"].values)
                ends = np.cumsum(lengths)
                values = [of(ids[a:b]) for a, b in zip((ends - lengths).tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [row["doc_ids"].values, pa.array(row["start"].as_py() + ends - lengths), pa.array(lengths),
                     pa.array(values)], names=["doc_id", "start", "n_tokens", name])

    return run


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


CRC = "ids_crc32", "long", crc


def token_digests(docs: DataFrame, tokenizer_file: str, *, end_id: int | None = 2, **columns) -> DataFrame:
    """Write ``docs`` as token files in the shared folder and read them back."""
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    write_tokens(docs, path, tokenizer_file, end_id=end_id, **columns)
    return read_tokens(spark, path, CRC)
