"""Repeated passages: windows of words that also start earlier are removed.

A suffix automaton of a shard of reference passages says, for every place of a text streamed through it,
how long the passage that ends there is and where it occurs first. The references are the corpus's own
repeated passages, which have no size bound, so automata are not broadcast: passages and the
contexts to be matched are dealt by their anchors (``repeats``), a shard holds whole groups
of about ``SHARD`` words, and its automaton lives in the task that its contexts are sent to. The windows
of a group of many different contexts are dealt to several automata by their words.
"""

import hashlib
from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame

from ..runtime import spread
from .automaton import SuffixAutomaton
from .grouped import whole_groups
from .repeats import Windows, remove_repeats

WORDS = 20
SHARD = 20_000  # words of reference passages in one automaton, or one group
ANSWER = "key long, one long, two long, places long, windows long, offs array<long>, dids array<long>, ats array<long>"
AT = 40  # bits of a place in a document


def first_places(contexts: list[tuple[int, int, list[bytes]]], size: int) -> Iterator[list[tuple[int, int]]]:
    """For contexts (document, first word, words): document and place where each window occurs first
    among all of them."""
    automaton, ids = SuffixAutomaton(), {}
    coded = [[ids.setdefault(w, len(ids)) for w in words] for _, _, words in contexts]
    states = [automaton.add(c) for c in coded]
    first = [None] * len(automaton.link)
    for (did, at, _), own in zip(contexts, states):
        place = (did << AT) + at
        for state in own:
            if first[state] is None or place < first[state]:
                first[state] = place
            place += 1
    link, length, mask = automaton.link, automaton.length, (1 << AT) - 1
    for state in sorted(range(1, len(link)), key=length.__getitem__, reverse=True):
        up, place = link[state], first[state]
        if place is not None and (first[up] is None or place < first[up]):
            first[up] = place
    for code in coded:
        out = []
        for state in islice(automaton.path(code), size - 1, None):  # the ends of windows
            while length[link[state]] >= size:  # as ``holder``
                state = link[state]
            place = first[state] - size + 1
            out.append((place >> AT, place & mask))
        yield out


def crowd_places(group: list[tuple], size: int) -> list[list[tuple[int, int]]]:
    """``first_places`` for more contexts than one automaton should hold: their windows are dealt by
    their words into classes of about ``SHARD`` words, an automaton each."""
    classes = sum(g[3] for g in group) * size // SHARD + 1
    dealt: list[list[tuple[int, int]]] = [[] for _ in range(classes)]
    for k, g in enumerate(group):
        words = g[7].split()
        for j in range(len(words) - size + 1):
            dealt[crc32(b" ".join(words[j: j + size])) % classes].append((k, j))
    out = [[(0, 0)] * g[3] for g in group]
    for places in dealt:
        texts = [(group[k][5], group[k][6] + j, group[k][7].split()[j: j + size]) for k, j in places]
        for (k, j), (first,) in zip(places, first_places(texts, size)):
            out[k][j] = first
    return out


def _compare(size: int):
    def answer(group: list[tuple]) -> Iterator[tuple]:
        crowd = sum(g[3] + size - 1 for g in group) > 5 * SHARD
        found = crowd_places(group, size) if crowd else first_places(
            [(g[5], g[6], g[7].split()) for g in group], size)
        for (key, one, two, windows, places, did, at, _), firsts in zip(group, found):
            offs, dids, ats = [], [], []
            for j, (d, i) in enumerate(firsts):
                if not offs or d != dids[-1] or i != ats[-1] + j - offs[-1]:
                    offs.append(j)
                    dids.append(d)
                    ats.append(i)
            if places > 1 or len(offs) > 1 or (dids[0], ats[0]) != (did, at):
                yield key, one, two, places, windows, offs, dids, ats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(),) * 5 + (pa.list_(pa.int64()),) * 3
        names = [c.split(" ")[0] for c in ANSWER.split(", ")]
        for table, starts in whole_groups(batches, ["key"], 2000):
            columns = [table.column(c).to_pylist() for c in (
                "key", "one", "two", "windows", "places", "did", "at", "content")]
            edges, out, shard, held = [*starts.tolist(), table.num_rows], [], [], 0
            for a, b in zip(edges[:-1], edges[1:]):
                merged: dict[tuple[int, int], list] = {}
                for key, one, two, n, places, did, at, content in zip(*(c[a:b] for c in columns)):
                    old = merged.get((one, two))
                    if old is None:
                        merged[one, two] = [key, one, two, n, places, did, at, content]
                    else:
                        old[4] += places
                        if (did, at) < (old[5], old[6]):
                            old[5], old[6] = did, at
                if len(merged) == 1 and next(iter(merged.values()))[4] == 1:
                    continue  # a window beside a hot anchor that occurs once
                more = sum(g[3] + size - 1 for g in merged.values())
                if shard and held + more > SHARD:
                    out += answer(shard)
                    shard, held = [], 0
                shard += merged.values()
                held += more
                if held > SHARD:
                    out += answer(shard)
                    shard, held = [], 0
            out += answer(shard) if shard else ()
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(zip(*out) if out else [()] * 8, kinds)], names=names)

    return run


def _removed(answer: tuple, did: int, at: int) -> Iterator[tuple[int, int]]:
    offs, dids, ats, windows = answer
    for j, end, d, i in zip(offs, [*offs[1:], windows], dids, ats):
        if d < did or (d == did and i < at + j):
            yield at + j, at + end


def kept_words(texts: list[bytes], ranges: list | None) -> Iterator[tuple[int, int, bytes]]:
    """Words, removed words, and the words kept, joined by one space."""
    for k, text in enumerate(texts):
        words = text.split()
        n = len(words)
        if ranges is not None and ranges[k]:
            kept, at = [], 0
            for a, b in ranges[k]:
                kept += words[at:a]
                at = b
            words = kept + words[at:]
        yield n, n - len(words), b" ".join(words)


def digest(texts, ranges) -> dict[str, pa.Array]:
    rows = [(n, r, hashlib.sha256(t).hexdigest()) for n, r, t in kept_words(texts, ranges)]
    n, r, h = zip(*rows) if rows else [()] * 3
    return {"n_words": pa.array(list(n), pa.int64()), "n_removed": pa.array(list(r), pa.int64()),
            "kept_sha256": pa.array(list(h), pa.string())}


DIGEST = "n_words long, n_removed long, kept_sha256 string"


def texts(texts, ranges) -> dict[str, pa.Array]:
    rows = [(n, r, t.decode()) for n, r, t in kept_words(texts, ranges)]
    n, r, t = zip(*rows) if rows else [()] * 3
    return {"n_words": pa.array(list(n), pa.int64()), "n_removed": pa.array(list(r), pa.int64()),
            "kept": pa.array(list(t), pa.string())}


TEXTS = "n_words long, n_removed long, kept string"


def dedup_passages(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = WORDS,
                   gram: int | None = None, hot: int = 50_000, finish=texts, finished: str = TEXTS) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (or what ``finish`` gives instead).

    Words are what white space separates. A word goes if a window of ``size`` words around it also
    starts earlier: in a document with a smaller id (a null id is the largest), or earlier in the
    same document. Windows are judged on the input. Rows that share an id count as one document, so rows that
    are equal in id and text do not remove anything from one another. Null text has no words; ids are integers.
    """
    windows = Windows(size, gram or max(1, size // 4), True, hot)

    def compare(contexts: DataFrame) -> DataFrame:
        return spread(contexts, "key").sortWithinPartitions("key").mapInArrow(_compare(size), ANSWER)

    return remove_repeats(docs, windows, doc_id=doc_id, text=text, compare=compare, removed=_removed,
                          removed_columns=["offs", "dids", "ats", "windows"], finish=finish, finished=finished)
