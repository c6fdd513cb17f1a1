"""Near copies by SimHash: fingerprints at most a few bits apart are linked.

Distinct fingerprints are dealt into tables by pairs of 16-bit blocks: if two of them differ in at
most two bits, two of their four blocks are equal. Inside a bucket, a Gray-order index does the search:
fingerprints sorted by Gray rank stand near others that share bits, so nodes of ``FANOUT``
neighbours share many masked bits. A search compares a node's shared bits once for all
fingerprints below and leaves the node when these differences alone exceed the radius.

A bucket of more than ``PIECE`` fingerprints is cut into pieces and searched piece against piece in tasks of its
own. Each task returns a spanning forest of its links, never all pairs, and components are
found in rounds of joins. Rows that share a fingerprint meet only in pre-aggregated counts.
"""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..runtime import cut, spread
from .components import components
from .grouped import whole_groups
from .skew import join_counted
from .text import LOWER, row_texts

RADIUS = 2
BLOCKS = 4  # of 16 bits; RADIUS < BLOCKS - 1, so that two blocks of linked fingerprints are equal
FANOUT = 8
PIECE = 8192
SEED = 42
PAIRS = 1 << 20  # pairs of fingerprint and node compared at a time


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64 bits as a signed integer; bit k is set if over half of the shingles' hashes have it."""
    tokens = text.translate(LOWER).split()
    if not tokens:
        return 0
    size = min(shingle, len(tokens))
    runs = map(b" ".join, zip(*[tokens[k:] for k in range(size)]))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(r, SEED) for r in runs], "<u8")
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[i: i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_key (a 64-bit hash of the text), fp. Null text has no words: fingerprint 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t) for t in row_texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(found, pa.int64())],
                names=["doc_id", "text_key", "fp"])

    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"),
                      F.xxhash64(F.col(text)).alias("text_key"))
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, text_key long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The position of each 64-bit code in Gray order."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """An index over groups of fingerprints. Rows and nodes of a group follow one another."""

    def __init__(self, codes: np.ndarray, group: np.ndarray):
        self.order = np.lexsort((gray_rank(codes), group))
        self.codes, self.group = codes[self.order], group[self.order]
        #: per level, from the leaves up: shared bits, their values, first child, children, group
        self.levels: list[tuple[np.ndarray, ...]] = []
        low = high = self.codes
        owner = self.group
        while True:
            edge = np.flatnonzero(np.diff(owner, prepend=owner[0] - 1))
            place = np.arange(len(owner)) - np.repeat(edge, np.diff(np.append(edge, len(owner))))
            starts = np.flatnonzero(place % FANOUT == 0)
            low, high = np.bitwise_and.reduceat(low, starts), np.bitwise_or.reduceat(high, starts)
            sizes = np.diff(np.append(starts, len(owner)))
            owner = owner[starts]
            self.levels.append((~(low ^ high), low, starts, sizes))
            if len(np.unique(owner)) == len(owner):
                break
        self.top = np.searchsorted(owner, self.group)

    def near(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows (in ``order``) of one group that differ in at most ``radius`` bits."""
        stack = [(len(self.levels) - 1, np.arange(len(self.codes)), self.top)]
        while stack:
            level, query, node = stack.pop()
            if len(query) > PAIRS // FANOUT:
                half = len(query) // 2
                stack += [(level, query[half:], node[half:]), (level, query[:half], node[:half])]
                continue
            mask, value, first, size = self.levels[level]
            apart = np.bitwise_count((self.codes[query] ^ value[node]) & mask[node])
            stay = apart <= radius
            query, node = query[stay], node[stay]
            sizes = size[node]
            step = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            child = np.repeat(first[node], sizes) + step
            query = np.repeat(query, sizes)
            if level:
                stack.append((level - 1, query, child))
                continue
            match = (query < child) & (np.bitwise_count(self.codes[query] ^ self.codes[child]) <= radius)
            if match.any():
                yield query[match], child[match]

    def forest(self, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Links (pairs of codes) that join the same rows as all pairs do, fewer than rows."""
        root = np.arange(len(self.codes))
        for a, b in self.near(radius):
            while True:
                ra, rb = root[a], root[b]
                if np.array_equal(ra, rb):
                    break
                low = np.minimum(ra, rb)
                np.minimum.at(root, ra, low)
                np.minimum.at(root, rb, low)
                while not np.array_equal(up := root[root], root):
                    root = up
        moved = np.flatnonzero(root != np.arange(len(root)))
        return self.codes[moved], self.codes[root[moved]]


def _search(radius: int):
    keys = ["pair", "bits", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, keys):
            codes = table.column("fp").to_numpy().view(np.uint64)
            group = np.zeros(len(codes), np.int64)
            group[starts[1:]] = 1
            a, b = GrayIndex(codes, np.cumsum(group)).forest(radius)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))],
                                             names=["a", "b"])

    return run


def link(codes: DataFrame, *, radius: int = RADIUS, piece: int = PIECE) -> DataFrame:
    """Links a, b between distinct fingerprints ``codes(fp)`` at most ``radius`` bits apart: enough of
    them to connect every two that are."""
    if radius > BLOCKS - 2:
        raise ValueError(f"radius {radius} needs more than {BLOCKS} blocks")
    width = 64 // BLOCKS
    part = [F.shiftrightunsigned("fp", width * k).bitwiseAND((1 << width) - 1) for k in range(BLOCKS)]
    tables = F.array(*[F.struct(F.lit(n).alias("pair"), (part[x] * (1 << width) + part[y]).alias("bits"))
                       for n, (x, y) in enumerate(combinations(range(BLOCKS), 2))])
    dealt = cut(codes.select("fp", F.explode(tables).alias("t")).select("fp", "t.pair", "t.bits"))
    sizes = cut(dealt.groupBy("pair", "bits").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"))
    bucketed = join_counted(dealt, sizes, ["pair", "bits"], "rows", "inner")
    pieces = F.ceil(F.col("rows") / F.lit(piece)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int")
    pairs = bucketed.withColumn("pieces", pieces).withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).select(
        "fp", "pair", "bits", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    keys = ["pair", "bits", "i", "j"]
    return spread(pairs, *keys).sortWithinPartitions(*keys).mapInArrow(_search(radius), "a long, b long")


def _components(rows: DataFrame, radius: int, piece: int) -> DataFrame:
    """fp, rows, root for every fingerprint that several rows or several fingerprints share."""
    groups = cut(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("rows")))
    roots = cut(components(link(groups.select("fp"), radius=radius, piece=piece)))
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    found = groups.join(roots, groups["fp"] == roots["node"], "left").select(
        "fp", "rows", F.coalesce("root", "fp").alias("root"), F.col("root").isNotNull().alias("linked"))
    return cut(found.where("linked or rows > 1").drop("linked"))


def near_copies(docs: DataFrame, *, radius: int = RADIUS, piece: int = PIECE, **columns) -> DataFrame:
    """One row per document: doc_id, text_key, fp, root (the component's smallest fingerprint as
    a signed number), component_id (its smallest doc_id).

    Documents without words have fingerprint 0 and are linked like any other. Rows are never merged: rows that share
    an id or a text each get an answer. Null ids are answered too, but name no component unless
    all of its ids are null. An empty table gives an empty table.
    """
    rows = cut(fingerprints(docs, **columns))
    shared = _components(rows, radius, piece)
    known = cut(join_counted(rows, shared, ["fp"], "rows"))
    first = known.where("root is not null").groupBy("root").agg(
        F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("members"))
    out = join_counted(known.where("root is not null"), cut(first), ["root"], "members").select(
        "doc_id", "text_key", "fp", "root", F.col("first").alias("component_id"))
    alone = known.where("root is null").select("doc_id", "text_key", "fp", F.col("fp").alias("root"),
                                               F.col("doc_id").alias("component_id"))
    return out.unionByName(alone)


def one_per_group(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The document with the smallest id of each group of near copies (a null id comes last),
    columns as in ``docs``. Of repeated rows one stays."""
    return first_rows(docs, near_copies(docs, doc_id=doc_id, text=text, **options), doc_id, text)


def first_rows(docs: DataFrame, found: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The rows of ``docs`` that stay, of groups ``found(doc_id, text_key, root)``."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key", "n")).alias("k")
    stay = cut(found.groupBy("root", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("n"))
               .groupBy("root").agg(first).select(F.col("k.doc_id").alias("_stay_id"),
                                                  F.col("k.text_key").alias("_stay_key"), "k.n"))
    # Under a struct, no column of ``docs`` can clash with the names of this join.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(doc_id).alias("_doc_id"),
                       F.xxhash64(F.col(text)).alias("_text_key"))

    def picked(some: DataFrame) -> DataFrame:
        return rows.join(some, rows["_doc_id"].eqNullSafe(some["_stay_id"])
                         & (rows["_text_key"] == some["_stay_key"]), "left_semi")

    kept, repeated = picked(stay.where("n = 1")), stay.where("n > 1")
    if not repeated.isEmpty():  # rows equal in id and text
        kept = kept.unionByName(picked(repeated).dropDuplicates(["_doc_id", "_text_key"]))
    return kept.select("_row.*")
