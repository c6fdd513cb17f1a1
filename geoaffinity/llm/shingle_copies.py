"""Near copies by shared word runs: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from MinHash bands: ``BANDS`` keys of ``WIDTH`` minima each. A pair at similarity s shares no
key with probability (1 - s^WIDTH)^BANDS, 2.3e-9 at 0.8. A link is never taken from a key: both sets are compared.

Documents with equal sets are one node. In every bucket all members are compared with its smallest one first,
so the rows grow with the bucket and not with its square. Buckets that are then still in several
components are compared whole, in tasks of bounded pieces that count shared shingles and return a forest.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from ..runtime import cut, discard, spread
from .components import components
from .grouped import whole_groups
from .keyfilter import inside, key_filter, passing
from .simhash import SEED, first_rows
from .skew import join_counted
from .text import LOWER, row_texts

SHINGLE = 5
SIMILARITY = 0.8
BANDS, WIDTH = 50, 5
PIECE = 1024  # sets of an open bucket that meet as many others in a task

_draw = np.random.default_rng(SEED)
_SALT = _draw.integers(0, 1 << 32, (BANDS * WIDTH, 1), np.uint32)
_FACTOR = _draw.integers(0, 1 << 32, (BANDS * WIDTH, 1), np.uint32) | np.uint32(1)


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word runs; a shorter text is one run."""
    tokens = text.translate(LOWER).split()
    if not tokens:
        return np.zeros(0, np.uint64)
    size = min(size, len(tokens))
    digest = xxhash.xxh64_intdigest
    runs = map(b" ".join, zip(*[tokens[k:] for k in range(size)]))
    return np.unique(np.fromiter((digest(r, SEED) for r in runs), np.uint64))


def bands(hashes: np.ndarray) -> list[int]:
    """The bucket keys of a set, signed; none for the empty set."""
    if not len(hashes):
        return []
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * WIDTH, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 1024):
        np.minimum(least, ((low[i: i + 1024] ^ _SALT) * _FACTOR).min(axis=1), out=least)
    rows = least.reshape(BANDS, WIDTH)
    return [xxhash.xxh64_intdigest(r.tobytes(), k) - (1 << 63) for k, r in enumerate(rows)]


def _signed_key(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED) - (1 << 63)


def _sketches(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, text_key, node (a hash of the set), size, bands. Null text has no words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, keys = [], [], []
            for t in row_texts(batch.column("text")):
                found = shingles(t)
                nodes.append(_signed_key(found))
                sizes.append(len(found))
                keys.append(bands(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(nodes, pa.int64()),
                 pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "text_key", "node", "size", "bands"])

    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"),
                      F.xxhash64(F.col(text)).alias("text_key"))
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, text_key long, node long, size long, bands array<long>")


def _shared(nodes: DataFrame, sent: Broadcast) -> DataFrame:
    """node, size, bucket: a row for each bucket of a node that may be in the filter. Buckets of one node are most of all and
    are neither written nor shuffled again."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bands = batch.column("bands")
            buckets = bands.flatten()
            row = np.repeat(np.arange(batch.num_rows), bands.value_lengths().fill_null(0).to_numpy())
            there = np.flatnonzero(inside(sent.value, buckets.to_numpy()))
            own = batch.select(["node", "size"]).take(pa.array(row[there]))
            yield pa.RecordBatch.from_arrays([own.column("node"), own.column("size"), buckets.take(pa.array(there))],
                                             names=["node", "size", "bucket"])

    return nodes.select("node", "size", "bands").mapInArrow(run, "node long, size long, bucket long")


def _sets(docs: DataFrame, rows: DataFrame, nodes: DataFrame, text: str) -> DataFrame:
    """node, hashes (bytes of the sorted set) of the wanted ``nodes``, from one text each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t).tobytes() for t in row_texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.binary())],
                                             names=["node", "hashes"])

    chosen = cut(rows.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("text_key").alias("_key")))
    texts = docs.select(F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("_key"))
    sent = key_filter(chosen.select("_key"))  # other texts are not shuffled
    likely = passing(texts.where("_key is not null"), "_key", sent)
    held = likely.join(chosen, "_key").select("node", "text").dropDuplicates(["node"])
    out = cut(held.mapInArrow(run, "node long, hashes binary"))
    sent.unpersist()
    discard(chosen)
    return out


def _counted(sets: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    n = pairs.groupBy(side).agg(F.count(F.lit(1)).alias("n"))
    return cut(n.join(sets.withColumnsRenamed({"node": side, "hashes": f"h{side}"}), side))


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs(a, b)`` whose sets are similar, as a table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for k, (x, y) in enumerate(zip(batch.column("ha"), batch.column("hb"))):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                good[k] = both / (len(x) + len(y) - both) >= similarity
            yield batch.select(["a", "b"]).filter(pa.array(good))

    first, second = (_counted(sets, pairs, side) for side in ("a", "b"))
    one = join_counted(pairs, first, ["a"], "n", "inner").drop("n")
    both = join_counted(one, second, ["b"], "n", "inner")
    out = cut(both.select("a", "b", "ha", "hb").mapInArrow(run, "a long, b long"))
    discard(first, second)
    return out


def _links(sets: list[np.ndarray], own: np.ndarray, root: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Positions of similar sets of different components: enough to join all that are joined by such pairs.

    ``root`` names each set's component so far. Sets of the commonest one are not counted out
    themselves, as every pair wanted has a member outside of it.
    """
    size = np.array([len(s) for s in sets])
    word, where = np.unique(np.concatenate(sets), return_inverse=True)
    holder = np.repeat(np.arange(len(sets)), size)
    first = np.append(0, np.cumsum(size))
    order = np.argsort(where, kind="stable")
    holders, edge = holder[order], np.append(0, np.cumsum(np.bincount(where, minlength=len(word))))
    names, number, many = np.unique(root, return_inverse=True, return_counts=True)
    group, out = number.copy(), []
    for i in np.flatnonzero(number != many.argmax()).tolist():
        mine = where[first[i]: first[i + 1]]
        shared = np.bincount(np.concatenate([holders[edge[w]: edge[w + 1]] for w in mine.tolist()]), minlength=len(sets))
        near = np.flatnonzero(shared / (size + size[i] - shared) >= similarity)
        for g in np.unique(group[near]).tolist():
            if g != group[i]:
                out.append((i, int(near[group[near] == g][0])))
                group[group == g] = group[i]
    return out


def _search(similarity: float):
    keys = ["bucket", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, keys, least=1):
            node, root = (table.column(c).to_numpy() for c in ("node", "root"))
            raw = table.column("hashes").to_pylist()
            a, b = [], []
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows]):
                if hi - lo < 2:
                    continue
                sets = [np.frombuffer(v, np.uint64) for v in raw[lo:hi]]
                for x, y in _links(sets, node[lo:hi], root[lo:hi], similarity):
                    a.append(node[lo + x])
                    b.append(node[lo + y])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _whole(open_rows: DataFrame, sets: DataFrame, similarity: float, piece: int) -> DataFrame:
    """Links inside ``open_rows(bucket, node, root, m)``, whole buckets of m members, as a table."""
    pieces = F.ceil(F.col("m") / F.lit(piece)).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int")
    dealt = open_rows.withColumn("pieces", pieces).withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).select(
        "bucket", "node", "root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    dealt = cut(dealt)
    counted = cut(dealt.groupBy("node").agg(F.count(F.lit(1)).alias("n")).join(sets, "node"))
    keys = ["bucket", "i", "j"]
    full = join_counted(dealt, counted, ["node"], "n", "inner").select(*keys, "node", "root", "hashes")
    out = cut(spread(full, *keys).sortWithinPartitions(*keys).mapInArrow(_search(similarity), "a long, b long"))
    discard(dealt, counted)
    return out


def near_copies(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY,
                piece: int = PIECE) -> DataFrame:
    """One row per document: doc_id, text_key, root (the same number for all documents that a chain of
    similar ones joins). Documents without words are copies of each other."""
    rows = cut(_sketches(docs, doc_id, text))
    nodes = cut(rows.groupBy("node").agg(F.first("size").alias("size"), F.first("bands").alias("bands"),
                                         F.count(F.lit(1)).alias("rows")))
    every = nodes.select("node", "size", F.explode("bands").alias("bucket"))
    buckets = cut(every.groupBy("bucket").agg(F.min(F.struct("node", "size")).alias("lead"),
                                              F.count(F.lit(1)).alias("m")).where("m > 1"))
    sent = key_filter(buckets.select("bucket"))
    dealt = cut(_shared(nodes, sent))
    sent.unpersist()
    met = cut(join_counted(dealt, buckets, ["bucket"], "m", "inner"))
    discard(dealt, buckets)
    close = F.least("size", "lead.size") / F.greatest("size", "lead.size") >= similarity
    pairs = cut(met.where(close & (F.col("node") != F.col("lead.node"))).select(
        F.col("lead.node").alias("a"), F.col("node").alias("b")).distinct())
    sets = _sets(docs, rows, met.where("m > 2").select("node").unionByName(pairs.select(F.col("a").alias("node")))
                 .unionByName(pairs.select(F.col("b").alias("node"))).distinct(), text)
    links = _similar(pairs, sets, similarity)
    discard(pairs)

    roots = _rooted(nodes, links)
    ours = _per_node(met, roots)
    known = cut(join_counted(met.where("m > 2").select("bucket", "node", "m"), ours, ["node"], "n", "inner").select(
        "bucket", "node", "root", "m"))
    discard(met, ours)
    # Buckets with the same members are one, and those inside one component are done.
    state = cut(known.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("s"),
                                            F.min("root").alias("low"), F.max("root").alias("high"))
                .where("low != high").groupBy("m", "s").agg(F.min("bucket").alias("bucket")).select("bucket", "m"))
    rest = join_counted(known.drop("m"), state, ["bucket"], "m", "inner").select("bucket", "node", "root", "m")
    more = _whole(rest, sets, similarity, piece)
    discard(known, state, sets)
    if not more.isEmpty():
        old, roots = roots, _rooted(nodes, links.unionByName(more))
        discard(old)
    discard(links, more)
    counted = cut(nodes.select("node", "rows").join(roots, "node"))
    discard(nodes, roots)
    out = cut(join_counted(rows.select("doc_id", "text_key", "node"), counted, ["node"], "rows", "inner").select(
        "doc_id", "text_key", "root"))
    discard(rows, counted)
    return out


def _rooted(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node, root of all nodes, as a table; a node without links is its own root."""
    found = components(links)
    out = cut(nodes.select("node").join(found.withColumnRenamed("root", "_root"), "node", "left").select(
        "node", F.coalesce("_root", "node").alias("root")))
    discard(found)
    return out


def _per_node(met: DataFrame, roots: DataFrame) -> DataFrame:
    return cut(met.where("m > 2").groupBy("node").agg(F.count(F.lit(1)).alias("n")).join(roots, "node"))


def one_per_group(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The document with the smallest id of each group of near copies, as ``simhash.one_per_group``."""
    return first_rows(docs, near_copies(docs, doc_id=doc_id, text=text, **options), doc_id, text)
