"""How far the sources of a language are apart: smoothed term shares compared by hash-consed segment trees.

Kept terms have dense ids per language, frequent ones first. A group's counts are the leaves of a segment tree
over these ids; equal subtrees, of any groups, are one node. Two trees are compared by going down both at once,
level by level: equal pairs of nodes are merged before they are opened, with the number of times they occurred, so that each is
priced once. Rare terms make most subtrees empty or equal, which is where this saves.

A task holds one aligned subtree of all groups of a language (``LEAVES`` terms or fewer, so that leaves times
groups are bounded); above these subtrees the trees only add up, which is an aggregation. Shares and values are whole numbers.
"""

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..runtime import cut, ordered_prefix, spread
from .grouped import whole_groups
from .skew import join_counted
from .text import row_texts

LEAST = 10  # documents of the language that a kept term occurs in
TOP = 10
SCALE_DIGITS = 3  # shares are in units of 1000 ** -3
LEAVES = 1 << 12  # of a task's subtree, fewer where a language has over CELLS / LEAVES groups
CELLS = 1 << 21
FRONTIER = 1 << 20  # pairs of nodes held at a time
HELD = 200_000  # different terms counted before they are passed on

_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters and non-ASCII characters; only A-Z are lower-cased."""
    return text.translate(_TERMS).split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["lang", "source", "term", "n", "docs"]
    found: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in found.items():
            size = len(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()),
                 pa.array(list(n), pa.binary()).cast(pa.string()), pa.array(list(n.values()), pa.int64()),
                 pa.array([docs[t] for t in n], pa.int64())], names=names)
        found.clear()

    held = 0
    for batch in batches:
        langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
        for lang, source, text in zip(langs, sources, row_texts(batch.column("text"))):
            n, docs = found.setdefault((lang, source), (Counter(), Counter()))
            mine = Counter(terms(text))
            held -= len(n)
            n.update(mine)
            docs.update(mine.keys())
            held += len(n)
            if held > HELD:
                yield from flush()
                held = 0
    yield from flush()


def kept_terms(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, source, term, n (occurrences) of the terms in at least ``least`` documents of the language.

    Counted in the tasks that read the texts, so a frequent term is a few rows per task and source.
    """
    counted = spread(docs.mapInArrow(_counted, "lang string, source string, term string, n long, docs long"),
                     "lang", "term")
    whole = counted.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return whole.withColumn("df", F.sum("docs").over(W.partitionBy("lang", "term"))).where(
        F.col("df") >= least).drop("docs")


def shares(counts: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(1000 ** SCALE_DIGITS * (counts + 2) / whole), exactly, by long division."""
    if len(whole) and max(whole.max(), counts.max()) >= 1 << 53:
        counts, whole = counts.astype(object), whole.astype(object)
    rest = counts + 2
    out = rest // whole
    rest = rest - out * whole
    for _ in range(SCALE_DIGITS):
        digit = rest * 1000 // whole
        rest = rest * 1000 - digit * whole
        out = out * 1000 + digit
    return (out + 1).astype(np.int64)


def prices(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


class Forest:
    """The segment trees of several count rows (one tree a row, a power of two of leaves each)."""

    def __init__(self, counts: np.ndarray):
        self.counts, ids = np.unique(counts, return_inverse=True)
        self.leaves = ids.reshape(counts.shape)
        #: per level above the leaves: left and right child of each different node
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        level, size = self.leaves, len(self.counts)
        while level.shape[1] > 1:
            nodes, ids = np.unique(level[:, ::2] * size + level[:, 1::2], return_inverse=True)
            self.levels.append((nodes // size, nodes % size))
            level, size = ids.reshape(len(level), -1), len(nodes)
        self.roots = level[:, 0]

    def compared(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The different pairs of leaves that rows a[i] and b[i] have in the same places, sorted by i:
        i, leaf of a, leaf of b, number of places."""
        i, x, y, times = np.arange(len(a)), self.roots[a], self.roots[b], np.ones(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            left, right = self.levels[k]
            i, times = np.tile(i, 2), np.tile(times, 2)
            x, y = np.concatenate([left[x], right[x]]), np.concatenate([left[y], right[y]])
            size = len(self.levels[k - 1][0]) if k else len(self.counts)
            key = (i * size + x) * size + y
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.diff(key[order], prepend=-1))
            times = np.add.reduceat(times[order], first)
            key = key[order][first]
            i, x, y = key // (size * size), key // size % size, key % size
        return i, x, y, times


def _audited(top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(lang: str, a: np.ndarray, b: np.ndarray, term: np.ndarray | None, value: np.ndarray) -> pa.RecordBatch:
            term = pa.nulls(len(a), pa.int64()) if term is None else pa.array(term, pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(a), pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), term,
                 pa.array(value, pa.int64())], names=["lang", "a", "b", "term", "value"])

        for table, starts in whole_groups(batches, ["lang", "block"], least=1):
            for low, high in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows]):
                part = table.slice(low, high - low)
                g, at, n = (part.column(c).to_numpy() for c in ("g", "at", "n"))
                lang, block, size = (part.column(c)[0].as_py() for c in ("lang", "block", "size"))
                kept = int(n[g < 0][0])
                head = (at < 0) & (g >= 0)
                total = np.zeros(int(head.sum()), np.int64)
                total[g[head]] = n[head]
                whole = np.append(total, total.sum()) + 2 * kept  # the last row is the language
                counts = np.zeros((len(whole), size), np.int64)
                counts[g[at >= 0], at[at >= 0]] = n[at >= 0]
                counts[-1] = counts[:-1].sum(axis=0)
                counts[:, kept - block * size:] = -1  # no such terms
                trees = Forest(counts)

                def priced(a: np.ndarray, b: np.ndarray):
                    i, x, y, times = trees.compared(a, b)
                    there = trees.counts[x] >= 0
                    i, x, y, times = i[there], x[there], y[there], times[there]
                    p, q = shares(trees.counts[x], whole[a[i]]), shares(trees.counts[y], whole[b[i]])
                    return i, x, y, times, p, q

                sources, step = len(total), max(1, FRONTIER // size)
                first, second = np.triu_indices(sources, 1)
                for k in range(0, len(first), step):
                    a, b = first[k: k + step], second[k: k + step]
                    i, _, _, times, p, q = priced(a, b)
                    yield out(lang, a, b, None, np.add.reduceat(prices(p, q) * times, np.flatnonzero(np.diff(i, prepend=-1))))
                for k in range(0, sources, step):
                    a = np.arange(k, min(k + step, sources))
                    i, x, y, _, p, q = priced(a, np.full(len(a), sources))
                    width = len(trees.counts)
                    memo = (i * width + x) * width + y
                    value = np.where((trees.counts[x] > 0) & (p > q), prices(p, q), -1)
                    real = min(size, kept - block * size)
                    key = (np.arange(len(a))[:, None] * width + trees.leaves[a, :real]) * width + trees.leaves[-1, :real]
                    found = value[np.searchsorted(memo, key)]
                    if real > top:  # the best of each source, ties included
                        found[found < np.partition(found, real - top, axis=1)[:, [real - top]]] = -1
                    row, place = np.nonzero(found >= 0)
                    yield out(lang, a[row], np.full(len(row), -1), block * size + place, found[row, place])

    return run


def audit(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST,
          top: int = TOP, leaves: int = LEAVES) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part ``pair``: the distance to each other source of the language, all ranks. Part ``term``: the ``top``
    terms that the source has more of than its language. Rank goes by value, descending, then by item in UTF-8 order.

    Null text, lang and source are empty. A document without terms still names its group; a language without kept
    terms has distance 0 between all sources. Repeated rows are documents of their own, ids are not read, other columns
    do not matter, an empty table gives no rows. A text has to fit into a task. ``leaves``, a power of two,
    bounds a task and does not change the result.
    """
    def given(c: str):
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    rows = docs.select(given(lang).alias("lang"), given(source).alias("source"), given(text).alias("text"))
    kept = cut(kept_terms(rows, least))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("rows"))
    by_lang = W.partitionBy("lang")
    groups = cut(rows.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").select(
        "lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("rows", F.lit(0)).alias("rows"),
        (F.row_number().over(by_lang.orderBy("source")) - 1).cast("long").alias("g"),
        F.count(F.lit(1)).over(by_lang).alias("sources")))

    # Dense ids in the order language, frequency, term; a task's subtree shrinks as a language has more sources.
    numbered = ordered_prefix(kept.groupBy("lang", "term").agg(F.first("df").alias("df")),
                              ["lang", "df", "term"], [True, False, True])
    halved = F.greatest(F.lit(0), F.ceil(F.log2((F.col("sources") + 1) * leaves / F.lit(CELLS))))
    langs = cut(numbered.groupBy("lang").agg(F.min("pos").alias("base"), F.count(F.lit(1)).alias("kept")).join(
        groups.groupBy("lang").agg(F.max("sources").alias("sources")), "lang").withColumn(
        "size", F.greatest(F.lit(1), (F.lit(leaves) / F.pow(F.lit(2), halved)).cast("long"))))
    ids = cut(join_counted(numbered.select("lang", "term", "pos"), langs, ["lang"], "kept", "inner").select(
        "lang", "term", (F.col("pos") - F.col("base")).alias("id"), "size", "kept"))

    named = join_counted(kept.select("lang", "source", "term", "n"), groups.select("lang", "source", "g", "rows"),
                         ["lang", "source"], "rows", "inner")
    leaf = named.join(ids, ["lang", "term"]).select(
        "lang", F.expr("id div size").alias("block"), "size", "g", (F.col("id") % F.col("size")).alias("at"), "n")
    blocks = langs.select("lang", "size", "kept", F.explode(F.sequence(F.lit(0), F.expr("(kept - 1) div size"))).alias("block"))
    none = F.lit(-1).cast("long")
    heads = blocks.join(groups, "lang").select("lang", "block", "size", "g", none.alias("at"), F.col("total").alias("n"))
    sizes = blocks.select("lang", "block", "size", none.alias("g"), none.alias("at"), F.col("kept").alias("n"))
    dealt = spread(leaf.unionByName(heads).unionByName(sizes), "lang", "block").sortWithinPartitions("lang", "block")
    found = cut(dealt.mapInArrow(_audited(top), "lang string, a long, b long, term long, value long"))

    apart = found.where("term is null").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    one = groups.select("lang", "source", "g")
    other = groups.select("lang", F.col("source").alias("item"), F.col("g").alias("h"))
    pairs = one.join(other, "lang").where("g != h").select(
        "lang", "source", "item", F.least("g", "h").alias("a"), F.greatest("g", "h").alias("b")).join(
        apart, ["lang", "a", "b"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    best = found.where("term is not null").select("lang", F.col("a").alias("g"), F.col("term").alias("id"), "value").join(
        ids.select("lang", "id", F.col("term").alias("item")), ["lang", "id"]).join(one, ["lang", "g"]).select(
        "lang", "source", F.lit("term").alias("part"), "item", "value")

    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).cast("int")
    return pairs.withColumn("rank", rank).unionByName(best.withColumn("rank", rank).where(F.col("rank") <= top))
