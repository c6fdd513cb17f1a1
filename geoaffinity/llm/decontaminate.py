"""Benchmark passages in documents, by a generalised suffix automaton.

The items are normalised (A-Z lower-cased, words of letters, digits and non-ASCII characters) and
added to suffix automata, which are broadcast. Documents are streamed through them word by word:
where the longest match reaches a window's length, the words are hit. Runs of words that
no item contains cannot match and are skipped without a step.

A benchmark is dealt into shards of at most ``SHARD_WORDS`` words (or one item), so that
no broadcast exceeds that size however large the benchmark is; documents pass the shards one after another.
"""

import re
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..runtime import cut
from .automaton import SuffixAutomaton
from .text import row_texts

WINDOW = 10
SHARD_WORDS = 500_000

KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
             for c in range(256))
STATE = "_n long, _hits array<int>, _items array<string>"


def words(text: bytes) -> list[bytes]:
    return text.translate(KEEP).split()


class Passages:
    """The windows of a shard of items, ready to be found in documents."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.window, self.vocabulary = window, {}
        self.automaton, self.names = SuffixAutomaton(), {}
        runs, known = [], self.vocabulary
        for name, text in items:
            run = [known.setdefault(w, len(known)) for w in words(text)]
            if run:
                self.automaton.add(run)
                runs.append((name, run))
        self.shortest = min((min(len(run), window) for _, run in runs), default=window)
        short: dict[int, list] = {}
        for name, run in runs:
            size = min(window, len(run))
            for i, (state, _) in enumerate(self.automaton.follow(run)):
                if i + 1 >= size:
                    at = self.automaton.holder(state, size)
                    if size == window:
                        self.names.setdefault(at, set()).add(name)
                    else:
                        short.setdefault(at, []).append((size, name))
        # the short items that end a state's run: its own and those of its suffixes
        self.short = {}
        link = self.automaton.link
        if short:
            for state in sorted(range(len(link)), key=self.automaton.length.__getitem__):
                found = short.get(state, []) + self.short.get(link[state], [])
                if found:
                    self.short[state] = found

    def find(self, tokens: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """A mask of hit words, and the items whose windows occur."""
        hit, names = np.zeros(len(tokens), bool), set()
        ids = np.fromiter(map(self.vocabulary.get, tokens, repeat(-1)), np.int64, len(tokens))
        known = np.concatenate(([False], ids >= 0, [False]))
        edges = np.flatnonzero(known[1:] != known[:-1])
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a >= self.shortest:
                self._stream(ids[a:b].tolist(), a, hit, names)
        return hit, names

    def _stream(self, run: list[int], first: int, hit: np.ndarray, names: set[str]) -> None:
        window, link, length = self.window, self.automaton.link, self.automaton.length
        for i, (state, size) in enumerate(self.automaton.follow(run), first + 1):
            if size >= window:
                at = state
                while length[link[at]] >= window:
                    at = link[at]
                hit[i - window: i] = True
                names |= self.names[at]
            for n, name in self.short.get(state, ()):
                if n <= size:
                    hit[i - n: i] = True
                    names.add(name)


def shards(items: DataFrame, item_id: str, text: str, most: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items in pieces of at most ``most`` words (or one item each)."""
    src = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("name"),
                       F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = cut(src.withColumn("w", F.length("text") / 2 + 1))  # a word takes two characters at least
    n = max(1, int((rows.agg(F.sum("w")).first()[0] or 0) // most) + 1)
    while True:
        piece = F.pmod(F.xxhash64("name", "text"), F.lit(n))
        over = (rows.groupBy(piece.alias("p")).agg(F.sum("w").alias("w"), F.countDistinct("name", "text").alias("k"))
                .where((F.col("w") > most) & (F.col("k") > 1)))
        if n == 1 and most >= (rows.agg(F.sum("w")).first()[0] or 0) or over.isEmpty():
            break
        n *= 2
    for p in range(n):
        yield [(r["name"], r["text"].encode()) for r in
               rows.where(piece == p).select("name", "text").distinct().collect()]


def scan(docs: DataFrame, items: DataFrame, *, text: str, item_id: str = "item_id",
         item_text: str = "text", window: int = WINDOW, most: int = SHARD_WORDS,
         then: Callable | None = None, schema: T.StructType | None = None) -> DataFrame:
    """``docs`` with _n (words), _hits (borders of hit word ranges) and _items (sorted ids); or what ``then`` makes of
    batches of these, with ``schema``, in the same Python worker."""
    rows = docs.withColumns({"_n": F.lit(0).cast("long"), "_hits": F.lit([]).cast("array<int>"),
                             "_items": F.lit([]).cast("array<string>")})
    context, passages = docs.sparkSession.sparkContext, None
    for shard in shards(items, item_id, item_text, most):  # one at least
        if passages is not None:  # a table between two shards: one Python worker and one shard in memory at a time
            rows = cut(rows.mapInArrow(_scanner(passages, text), rows.schema))
        passages = context.broadcast(Passages(shard, window))
    last = _scanner(passages, text)
    if then is None:
        return rows.mapInArrow(last, rows.schema)
    return rows.mapInArrow(lambda batches: then(last(batches)), schema)


def _scanner(shared, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages = shared.value
        for batch in batches:
            counts, hits, names = [], [], []
            before = batch.column("_hits").to_pylist(), batch.column("_items").to_pylist()
            for doc, old, own in zip(row_texts(batch.column(text)), *before):
                tokens = words(doc)
                hit, found = passages.find(tokens)
                for a, b in zip(old[::2], old[1::2]):
                    hit[a:b] = True
                counts.append(len(tokens))
                hits.append(np.flatnonzero(np.diff(hit, prepend=False, append=False)).tolist() if hit.any() else [])
                names.append(sorted(found.union(own)))
            new = {"_n": counts, "_hits": hits, "_items": names}
            yield pa.RecordBatch.from_arrays(
                [pa.array(new[f.name], f.type) if f.name in new else batch.column(f.name)
                 for f in batch.schema], schema=batch.schema)

    return run


def find_leaks(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
               **options) -> DataFrame:
    """doc_id, n_words, n_hit, hit_ranges (borders of hit word ranges), item_ids (sorted strings).

    An item of fewer words than the window is one window; an item without words has none.
    Null text has no words; a null item id reads "null"; items that share an id are one. Repeated
    rows are answered each on its own. Either table may be empty.
    """
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = scan(src, items, text="text", **options)
    signed = F.transform("_hits", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x).cast("long"))
    covered = F.aggregate(signed, F.lit(0).cast("long"), lambda n, x: n + x)
    return found.select("doc_id", F.col("_n").alias("n_words"),
                        covered.alias("n_hit"),
                        F.col("_hits").alias("hit_ranges"), F.col("_items").alias("item_ids"))


def remove_leaks(docs: DataFrame, items: DataFrame, *, text: str = "text", length: str | None = "n_chars",
                 max_coverage: float = 0.5, **options) -> DataFrame:
    """Documents without benchmark passages, columns as in ``docs``.

    Hit word ranges are cut out of the text; a document whose words are hit to more than
    ``max_coverage`` is dropped. Other texts stay byte for byte. ``length`` names a column that holds
    the number of characters, if there is one.
    """
    src = docs.withColumnsRenamed({c: f"_c{i}" for i, c in enumerate(docs.columns)})
    at = dict(zip(docs.columns, src.columns))
    kept = scan(src, items, text=at[text], then=_cutter(at[text], at.get(length), max_coverage), schema=src.schema, **options)
    return kept.withColumnsRenamed({v: k for k, v in at.items()})


def _cutter(text: str, length: str | None, most: float):
    word = re.compile(rb"[^ ]+")

    def cleaned(doc: bytes, hits: list[int]) -> str:
        spans = [m.span() for m in word.finditer(doc.translate(KEEP))]
        out, at = [], 0
        for a, b in zip(hits[::2], hits[1::2]):
            out.append(doc[at: spans[a][0]])
            at = spans[b - 1][1]
        return b"".join([*out, doc[at:]]).decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [n for n in batch.schema.names if n not in ("_n", "_hits", "_items")]
            hits, counts = batch.column("_hits").to_pylist(), batch.column("_n").to_pylist()
            share = [sum(h[1::2]) - sum(h[::2]) for h in hits]
            stays = [s <= most * n for s, n in zip(share, counts)]
            part = batch.select(names).filter(pa.array(stays, pa.bool_()))
            hits = [h for h, s in zip(hits, stays) if s]
            if any(hits):
                texts, sizes = part.column(text).to_pylist(), None
                texts = [cleaned(t.encode(), h) if h else t for t, h in zip(texts, hits)]
                new = {text: texts}
                if length:
                    sizes = part.column(length).to_pylist()
                    new[length] = [len(t) if h else n for t, h, n in zip(texts, hits, sizes)]
                part = pa.RecordBatch.from_arrays(
                    [pa.array(new[f.name], f.type) if f.name in new else part.column(f.name)
                     for f in part.schema], schema=part.schema)
            yield part

    return run
