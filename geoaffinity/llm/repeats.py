"""Find strings of a fixed number of tokens that occur more than once in a corpus.

Comparing every window of every document with every other would move each token many times. Instead each window
names an anchor, the token gram in it with the least hash, leftmost on ties: equal
windows name equal anchors at equal places. Windows that follow one another and share an anchor form
a *context*. Then

1. anchors are counted; those that occur once are done, with all of their windows,
2. documents with repeated anchors give the contexts around them; equal contexts are
   put together, by map task and then in the shuffle, so that copies weigh as one,
3. contexts that share an anchor meet in one task, where an operator's own method compares their windows,
4. its answers go back to all places of a context, and from there to the documents.

An anchor with more than ``hot`` places is replaced by its windows, one context each. So what meets in a
task is bounded, whatever its share of the corpus: at most ``hot`` contexts of a cold anchor, or
one window with one row per map task. Joins go through ``skew.join_counted``. Nothing is collected.
"""

from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..runtime import cut, discard
from .skew import join_counted
from .text import PIECE, SpanHash, row_blocks, text_bytes, word_borders

PLACE_BITS = np.uint64(21)
ROWS = 1 << 17  # contexts handled at a time
HELD = 100_000  # distinct contexts that a map task holds before it passes them on
SLICE = 1 << 20  # windows at a time; with the window itself below 2 ** PLACE_BITS
LONG = 64  # bytes of a word that is hashed by itself
NO_ID = 2**63 - 1  # stands for a null id: it sorts last


@dataclass(frozen=True)
class Windows:
    """What a window is: ``size`` tokens, anchored by grams of ``gram`` tokens."""

    size: int
    gram: int
    of_words: bool
    hot: int

    def tokens(self, raw: np.ndarray, at: np.ndarray, words: SpanHash, gram: SpanHash):
        """Hash values, starts and ends of tokens, and the first token of each row (n + 1)."""
        if self.of_words:
            starts, ends, first = word_borders(raw, at)
            values = words.bytes(raw, starts, ends)
            # Sums modulo 2**64 are equal for some long words of a regular build, whatever the base.
            for k in np.flatnonzero(ends - starts > LONG).tolist():
                values[k] = xxhash.xxh3_64_intdigest(raw[starts[k]: ends[k]].tobytes())
            return values, starts, ends, first
        place = np.arange(len(raw) + 1)
        return gram.value[raw], place[:-1], place[1:], at


class Finder:
    """Contexts in blocks of rows."""

    def __init__(self, windows: Windows):
        self.w = windows
        self.word, self.gram, self.left, self.right = (SpanHash(s) for s in (11, 12, 13, 14))

    def contexts(self, raw: np.ndarray, at: np.ndarray):
        """(tokens, row, anchor, first window, windows, place of the anchor) of all contexts."""
        tokens = values, _, _, first = self.w.tokens(raw, at, self.word, self.gram)
        parts, size, reach = [], self.w.size, self.w.size - self.w.gram + 1
        n = len(values)
        counts = np.diff(first)
        valid = np.zeros(n + 1, np.int8)  # where windows lie inside their row
        long = np.flatnonzero(counts >= size)
        valid[first[long]] += 1
        valid[first[long + 1] - size + 1] -= 1
        valid = np.cumsum(valid[:-1]) > 0 if n else valid[:0]
        for low in range(0, n - size + 1, SLICE):
            high = min(n, low + SLICE + size - 1)
            inside = valid[low: high - size + 1]
            if not inside.any():
                continue
            sums = self.gram.sums(values[low:high])
            begin = np.arange(high - low - self.w.gram + 1)
            hashes = self.gram.between(sums, begin, begin + self.w.gram)
            least = (hashes >> PLACE_BITS << PLACE_BITS) | begin.astype(np.uint64)
            span = 1
            while 2 * span <= reach:
                least = np.minimum(least[:-span], least[span:])
                span *= 2
            if span < reach:
                least = np.minimum(least[: len(least) - (reach - span)], least[reach - span:])
            place = (least & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
            place = np.where(inside, place, -1)
            edge = np.flatnonzero(np.diff(place, prepend=-2))
            length = np.diff(np.append(edge, len(place)))
            edge, length = edge[place[edge] >= 0], length[place[edge] >= 0]
            parts.append((hashes[place[edge]], edge + low, length, place[edge] + low))
        anchor, start, length, place = (np.concatenate(x) for x in zip(*parts)) if parts else (
            np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
        # a context cut by two slices keeps its anchor: its parts are contexts of their own
        row = np.searchsorted(first, start, "right") - 1
        return tokens, row, anchor, start, length, place

    def names(self, values: np.ndarray, start: np.ndarray, end: np.ndarray, place: np.ndarray):
        """128 bits that identify contexts: their tokens and where the anchor stands."""
        out = []
        for h in (self.left, self.right):
            name = np.zeros(len(start), np.uint64)
            for i in range(0, len(start), SLICE):
                s, e = start[i: i + SLICE], end[i: i + SLICE]
                low = int(s.min())
                sums = h.sums(values[low: int(e.max())])
                name[i: i + SLICE] = h.between(sums, s - low, e - low)
            out.append((name ^ (place - start + 1).astype(np.uint64) * h.value[3]).view(np.int64))
        return out


def _anchors(windows: Windows):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(windows)
        for batch in batches:
            raw, at = text_bytes(batch.column("text"))
            for lo, hi in row_blocks(at, PIECE):
                _, row, anchor, start, _, _ = finder.contexts(raw[at[lo]: at[hi]], at[lo: hi + 1] - at[lo])
                rows = pa.array(row + lo)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("did").take(rows), batch.column("tk").take(rows),
                     pa.array(anchor.view(np.int64)), pa.array(start)], names=["did", "tk", "anchor", "at"])

    return run


def _places(finder: Finder, windows: Windows, batch: pa.RecordBatch):
    """Contexts around repeated anchors, block by block, hot ones window by window: the block's first row, its bytes
    and tokens, and for each context row, key, two names, first window in the row, number of windows,
    first token, end, place of the anchor, whether it is one window of a hot anchor."""
    raw, at = text_bytes(batch.column("text"))
    wanted, heavy = batch.column("anchors"), batch.column("hot")
    for lo, hi in row_blocks(at, PIECE // 2):
        block = raw[at[lo]: at[hi]]
        tokens, row, anchor, start, length, place = finder.contexts(block, at[lo: hi + 1] - at[lo])
        values, first = tokens[0], tokens[3]
        pick = wanted.slice(lo, hi - lo)
        flat = np.asarray(pick.flatten())
        owner = np.repeat(np.arange(hi - lo), np.diff(np.asarray(pick.offsets)))
        hot = np.asarray(heavy.slice(lo, hi - lo).flatten().cast(pa.int8())).astype(bool)
        order = np.lexsort((flat, owner))
        ask = np.stack([owner[order], flat[order]])
        # rank (row, anchor) of contexts among the asked ones
        mine = anchor.view(np.int64)
        found = np.full(len(mine), -1)
        if ask.shape[1]:
            bounds = np.searchsorted(ask[0], np.arange(hi - lo + 1))
            for r in np.unique(row).tolist():
                a, b = bounds[r], bounds[r + 1]
                if a == b:
                    continue
                here = slice(*np.searchsorted(row, [r, r + 1]))
                k = np.minimum(np.searchsorted(ask[1, a:b], mine[here]), b - a - 1) + a
                found[here] = np.where(ask[1, k] == mine[here], k, -1)
        keep = found >= 0
        row, anchor, start, length, place = (x[keep] for x in (row, mine, start, length, place))
        split = hot[order][found[keep]] if keep.any() else np.zeros(0, bool)
        many = np.where(split, length, 1)  # a hot context becomes its windows
        total = np.cumsum(many)
        low = 0
        while low < len(many):  # a bounded number of windows at a time
            high = max(low + 1, int(np.searchsorted(total, total[low] - many[low] + ROWS, "right")))
            own = many[low:high]
            step = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
            r, key, s, p, whole, n = (np.repeat(x[low:high], own) for x in (row, anchor, start, place, split, length))
            s, n = s + step, np.where(whole, 1, n)
            e = s + n - 1 + windows.size
            one, two = finder.names(values, s, e, p)
            key = np.where(whole, one ^ 0x5851F42D4C957F2D, key)
            yield lo, block, tokens, r, key, one, two, s - first[r], n, s, e, p, whole
            low = high


def _occurrences(windows: Windows):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(windows)
        for batch in batches:
            for lo, _, _, row, key, one, two, at, length, *_ in _places(finder, windows, batch):
                rows = pa.array(row + lo)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("did").take(rows), batch.column("tk").take(rows),
                     *map(pa.array, (key, one, two, at))], names=["did", "tk", "key", "one", "two", "at"])

    return run


def _contexts(windows: Windows, splitters: list[bytes]):
    """Distinct contexts of a batch (or of ``HELD`` of them): content, number of places, the earliest of
    them, and the range of ``splitters`` that their anchor's bytes fall into."""
    def flushed(seen: dict[tuple[int, int, int], list]) -> pa.RecordBatch:
        names = list(zip(*seen)) or [(), (), ()]
        rest = list(zip(*seen.values())) or [()] * 7
        kinds = (pa.int64(),) * 7 + (pa.binary(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), t) for c, t in zip((*names, *rest), kinds)],
            names=["key", "one", "two", "windows", "places", "did", "at", "content", "lead", "bucket"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(windows)
        for batch in batches:
            seen: dict[tuple[int, int, int], list] = {}
            ids = np.asarray(batch.column("did"))
            for lo, block, tokens, row, key, one, two, at, length, start, end, place, split in _places(
                    finder, windows, batch):
                _, begin, stop, _ = tokens
                view = memoryview(np.ascontiguousarray(block))
                did = ids[row + lo]
                order = np.lexsort((at, did, two, one, key))  # the first of equal contexts is the earliest
                new = np.ones(len(order), bool)
                new[1:] = np.diff(key[order]) != 0
                new[1:] |= (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0)
                edge = np.flatnonzero(new)
                pick, times = order[edge], np.diff(np.append(edge, len(order)))
                columns = zip(times.tolist(), *(x[pick].tolist() for x in (
                    key, one, two, did, at, length, begin[start], stop[end - 1], begin[place] - begin[start], split)))
                for many, k, a, b, d, i, n, low, high, lead, whole in columns:
                    old = seen.get((k, a, b))
                    if old is None:
                        text = bytes(view[low:high])
                        if windows.of_words:
                            text = b" ".join(text.split())
                        elif whole:
                            lead = -1
                        suffix = text if whole or windows.of_words else text[lead: lead + windows.gram]
                        seen[k, a, b] = [n, many, d, i, text, lead, bisect_right(splitters, suffix)]
                    else:
                        old[1] += many
                        if (d, i) < (old[2], old[3]):
                            old[2], old[3] = d, i
                if len(seen) > HELD:
                    yield flushed(seen)
                    seen.clear()
            yield flushed(seen)

    return run


PLACES = "did long, tk long, key long, one long, two long, at long"
CONTEXTS = ("key long, one long, two long, windows long, places long, did long, at long, "
            "content binary, lead long, bucket long")


def remove_repeats(docs: DataFrame, windows: Windows, *, doc_id: str, text: str,
                   compare: Callable[[DataFrame], DataFrame], removed: Callable, removed_columns: list[str],
                   finish: Callable, finished: str, split: bool = False) -> DataFrame:
    """doc_id and what ``finish`` makes of each document and the token ranges removed from it.

    ``compare`` gets the contexts and returns key, one, two, places and ``removed_columns``, a row
    for each context from which some place may lose tokens. ``removed(row of these columns as lists, did, at)``
    yields ranges of removed windows' first tokens for one place. ``finish(texts, ranges)`` returns Arrow arrays of the
    columns in the schema text ``finished`` (no types with commas).
    """
    src = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("did"),
                      F.coalesce(F.col(text), F.lit("")).alias("text"))
    src = src.withColumn("tk", F.xxhash64("text"))
    anchors = cut(src.mapInArrow(_anchors(windows), "did long, tk long, anchor long, at long").drop("at"))
    repeated = cut(anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("places")).where("places > 1"))
    wanted = join_counted(anchors, repeated, ["anchor"], "places", "inner").groupBy("did", "tk").agg(
        F.collect_set(F.struct("anchor", (F.col("places") > windows.hot).alias("hot"))).alias("a")).select(
        "did", "tk", F.col("a.anchor").alias("anchors"), F.col("a.hot").alias("hot"))
    # the one shuffle of all texts: documents without a repeated anchor are finished at once
    staged = cut(src.join(wanted, ["did", "tk"], "left").mapInArrow(
        _stage(finish), f"did long, tk long, text string, anchors array<long>, hot array<boolean>, {finished}"))
    discard(anchors, repeated)
    open_docs = staged.where("text is not null").select("did", "tk", "text", "anchors", "hot")
    splitters = sample_splitters(open_docs, windows) if split else []
    contexts = open_docs.mapInArrow(_contexts(windows, splitters), CONTEXTS)
    answers = cut(compare(contexts))
    places = cut(open_docs.mapInArrow(_occurrences(windows), PLACES))
    met = join_counted(places, answers, ["key", "one", "two"], "places", "inner")
    ranges = met.select("did", "tk", "at", *removed_columns).mapInArrow(
        _ranges(removed, removed_columns, windows.size), "did long, tk long, low long, high long")
    lists = ranges.distinct().groupBy("did", "tk").agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("r")).select(
        "did", "tk", F.col("r.low").alias("low"), F.col("r.high").alias("high"))
    rest = open_docs.select("did", "tk", "text").join(lists, ["did", "tk"], "left").mapInArrow(
        _finish(finish), f"did long, {finished}")
    columns = [c.split(" ", 1)[0] for c in finished.split(", ")]
    done = staged.where("text is null").select("did", *columns).unionByName(rest)
    return done.select(F.when(F.col("did") != NO_ID, F.col("did")).alias("doc_id"), *columns)


def sample_splitters(docs: DataFrame, windows: Windows, sample: int = 1000, most: int = 20_000) -> list[bytes]:
    """Leading tokens that cut the suffixes of the contexts of ``docs`` into as many ranges of about equal
    size as there are shuffle partitions, from at most ``most`` suffixes of about ``sample`` documents. They
    decide where rows go, never what comes out."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = max(1, docs.count() // sample)
    some = docs.where(F.pmod("tk", F.lit(every)) == 0).mapInArrow(_contexts(windows, []), CONTEXTS)
    lead = F.when(F.col("lead") < 0, F.col("content")).otherwise(
        F.substring("content", F.col("lead").cast("int") + 1, F.lit(windows.gram)))
    suffixes = sorted(bytes(r["s"]) for r in some.select(lead.alias("s")).limit(most).collect())
    return sorted({suffixes[len(suffixes) * k // parts] for k in range(1, parts)}) if suffixes else []


def _stage(finish: Callable):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            waits = np.asarray(batch.column("anchors").is_valid())
            for flag in (True, False):
                part = batch.filter(pa.array(waits == flag))
                if not part.num_rows:
                    continue
                if flag:
                    made = finish([b""] * part.num_rows, None)
                    made = {n: pa.nulls(part.num_rows, a.type) for n, a in made.items()}
                    text = part.column("text")
                else:
                    made = finish(_rows(part.column("text")), None)
                    text = pa.nulls(part.num_rows, part.column("text").type)
                yield pa.RecordBatch.from_arrays(
                    [part.column("did"), part.column("tk"), text, part.column("anchors"), part.column("hot"),
                     *made.values()], names=["did", "tk", "text", "anchors", "hot", *made])

    return run


def _rows(column: pa.Array) -> list[bytes]:
    raw, at = text_bytes(column)
    view = memoryview(np.ascontiguousarray(raw))
    return [bytes(view[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def merged(low: list[int], high: list[int]) -> list[tuple[int, int]]:
    """Ranges in order of their starts, joined where they meet."""
    out: list[tuple[int, int]] = []
    for a, b in zip(low, high):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _ranges(removed: Callable, columns: list[str], size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, low, high = [], [], []
            answers = zip(*(batch.column(c).to_pylist() for c in columns))
            for k, (did, at, answer) in enumerate(zip(batch.column("did").to_pylist(),
                                                      batch.column("at").to_pylist(), answers)):
                for a, b in removed(answer, did, at):
                    rows.append(k)
                    low.append(a)
                    high.append(b - 1 + size)
            pick = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("did").take(pick), batch.column("tk").take(pick), pa.array(low, pa.int64()),
                 pa.array(high, pa.int64())], names=["did", "tk", "low", "high"])

    return run


def _finish(finish: Callable):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("low").to_pylist(), batch.column("high").to_pylist())
            made = finish(_rows(batch.column("text")), [merged(a or [], b or []) for a, b in pairs])
            yield pa.RecordBatch.from_arrays([batch.column("did"), *made.values()], names=["did", *made])

    return run
