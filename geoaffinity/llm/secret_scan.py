"""Secrets in documents: fixed patterns, and formats learned from labelled credentials.

Grammar inference (ALERGIA): credentials become strings of character classes, a prefix tree counts
them, and states whose outgoing frequencies agree by Hoeffding's bound are merged, red to blue,
into a probabilistic automaton. One automaton is learned for each kind of credential. Every run of
token characters in every text is then a candidate and is scored by its likelihood per
character; a candidate whose likelihood lies where nearly all labelled credentials lie is a secret.
Both sides count: a run of digits alone is likelier than any key that mixes digits and letters.

The labelled credentials are the values that the fixed patterns find: a sample of at most
``SAMPLE`` distinct values per kind, those with the smallest hashes, is all that reaches the driver.
"""

import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .text import row_blocks, text_bytes

#: The base patterns and the least length of what they must hold.
KINDS = ("assign", "access", "hex")
ASSIGN = rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = rb"AKIA[A-Z0-9]+", rb"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24

LEARNED = "format"  # kind of the spans that the automata add
SAMPLE = 2000  # labelled values per kind
CANDIDATE = 16  # shortest run of token characters that is scored
QUANTILE = 0.01  # of labelled values that may score below, and above, the accepted range
ALPHA = 0.05  # of the compatibility test
FEWEST = 20  # labelled values that a kind needs for an automaton

_assign = re.compile(ASSIGN, re.IGNORECASE)  # on bytes: ASCII letters only


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_DIGITS, _HEXA = b"0123456789", b"0123456789abcdef"
_LOWERS, _UPPERS = bytes(range(97, 123)), bytes(range(65, 91))
_IS_HEX, _IS_ACCESS = _table(_HEXA), _table(_UPPERS + _DIGITS)
_IS_TOKEN = _table(_LOWERS + _UPPERS + _DIGITS + b"+/_.=-")

#: Character classes: digits, a-f, g-z, A-F, G-Z and each other token character.
CLASS = np.full(256, 255, np.uint8)
for _k, _chars in enumerate((_DIGITS, b"abcdef", b"ghijklmnopqrstuvwxyz", b"ABCDEF", b"GHIJKLMNOPQRSTUVWXYZ",
                             b"+", b"/", b"_", b".", b"=", b"-")):
    CLASS[list(_chars)] = _k
CLASSES = 11


def _runs(inside: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of at least ``least`` marked bytes inside one row."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.zeros_like(inside)
    before[1:] = inside[:-1]
    before[at[:-1][at[:-1] < len(inside)]] = False
    after = np.zeros_like(inside)
    after[:-1] = inside[1:]
    after[at[1:][at[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    long = ends - starts >= least
    return starts[long], ends[long]


def base_spans(raw: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(row, kind, start, end, value start) of the fixed patterns, in bytes of ``raw``.

    Runs of hex digits and of upper-case letters and digits are as long as they can be, so a
    match that is too short hides none: only ``assign`` needs the pattern itself.
    """
    out = []
    for a, b in zip(*_runs(_IS_HEX[raw], at, HEX_LEAST)):
        out.append((2, int(a), int(b), int(a)))
    for a, b in zip(*_runs(_IS_ACCESS[raw], at, ACCESS_LEAST)):
        k = raw[a:b].tobytes().find(ACCESS[:4])
        if k >= 0 and b - a - k >= ACCESS_LEAST:
            out.append((1, int(a) + k, int(b), int(a) + k))
    view = memoryview(np.ascontiguousarray(raw))
    for low, high in zip(at[:-1].tolist(), at[1:].tolist()):
        for m in _assign.finditer(view[low:high]):
            if m.end(2) - m.start(2) >= ASSIGN_LEAST:
                out.append((0, low + m.start(), low + m.end(), low + m.start(2)))
    rows = np.searchsorted(at, [s[1] for s in out], "right") - 1
    return [(int(r), *s) for r, s in zip(rows, out)]


class FormatAutomaton:
    """A probabilistic automaton of strings of character classes, learned by state merging."""

    def __init__(self, words: Sequence[bytes], alpha: float = ALPHA):
        self.alpha = alpha
        self.next, self.seen, self.stop = [{}], [0], [0]  # edges: class -> [state, count]
        for word in words:
            at = 0
            self.seen[0] += 1
            for c in CLASS[np.frombuffer(word, np.uint8)].tolist():
                edge = self.next[at].get(c)
                if edge is None:
                    edge = self.next[at][c] = [len(self.next), 0]
                    self.next.append({})
                    self.seen.append(0)
                    self.stop.append(0)
                edge[1] += 1
                at = edge[0]
                self.seen[at] += 1
            self.stop[at] += 1
        self._merge()
        self._score_table()

    def _differ(self, x: int, n: int, y: int, m: int) -> bool:
        bound = math.sqrt(0.5 * math.log(2 / self.alpha)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
        return abs(x / n - y / m) > bound

    def _compatible(self, red: int, blue: int) -> bool:
        todo = [(red, blue)]
        while todo:
            r, b = todo.pop()
            n, m = self.seen[r], self.seen[b]
            if not n or not m:
                continue
            if self._differ(self.stop[r], n, self.stop[b], m):
                return False
            for c in self.next[r].keys() | self.next[b].keys():
                x, y = self.next[r].get(c), self.next[b].get(c)
                if self._differ(x[1] if x else 0, n, y[1] if y else 0, m):
                    return False
                if x and y:
                    todo.append((x[0], y[0]))
        return True

    def _fold(self, red: int, blue: int) -> None:
        todo = [(red, blue)]
        while todo:
            r, b = todo.pop()
            self.seen[r] += self.seen[b]
            self.stop[r] += self.stop[b]
            for c, (to, count) in self.next[b].items():
                own = self.next[r].get(c)
                if own is None:
                    self.next[r][c] = [to, count]
                else:
                    own[1] += count
                    todo.append((own[0], to))

    def _merge(self) -> None:
        red = [0]
        blue = [(0, c) for c in self.next[0]]
        while blue:
            blue.sort(key=lambda e: -self.seen[self.next[e[0]][e[1]][0]])  # the best known first
            parent, c = blue.pop(0)
            state = self.next[parent][c][0]
            for r in red:
                if self._compatible(r, state):
                    self.next[parent][c][0] = r
                    self._fold(r, state)
                    break
            else:
                red.append(state)
            inside = set(red)
            blue = [(r, k) for r in red for k, e in self.next[r].items() if e[0] not in inside]
        self.states = red

    def _score_table(self) -> None:
        """Log probabilities by state and class; what was never seen keeps a small share."""
        number = {r: i for i, r in enumerate(self.states)}
        n = len(self.states)
        self.to = np.zeros((n, CLASSES), np.int32)
        self.log = np.zeros((n, CLASSES))
        for r, i in number.items():
            whole = self.seen[r] + 0.01 * (CLASSES + 1)
            self.log[i] = math.log(0.01 / whole)
            for c, (to, count) in self.next[r].items():
                self.to[i, c], self.log[i, c] = number[to], math.log((count + 0.01) / whole)
        del self.next, self.seen, self.stop, self.states

    def score(self, classes: list[np.ndarray]) -> np.ndarray:
        """Mean log likelihood per character, all strings side by side."""
        size = np.array([len(c) for c in classes])
        first = np.cumsum(size) - size
        flat = np.concatenate(classes) if classes else np.zeros(0, np.uint8)
        at, total = np.zeros(len(size), np.int64), np.zeros(len(size))
        for k in range(int(size.max(initial=0))):
            live = np.flatnonzero(size > k)
            c = flat[first[live] + k]
            total[live] += self.log[at[live], c]
            at[live] = self.to[at[live], c]
        return total / np.maximum(size, 1)


def labelled_values(docs: DataFrame, sample: int = SAMPLE) -> dict[str, list[bytes]]:
    """At most ``sample`` distinct values of each kind that the fixed patterns find in ``docs(text)``:
    those with the smallest hashes, from all documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = text_bytes(batch.column("text"))
            kinds, values = [], []
            for lo, hi in row_blocks(at):
                block = raw[at[lo]: at[hi]]
                for _, kind, _, end, value in base_spans(block, at[lo: hi + 1] - at[lo]):
                    kinds.append(kind)
                    values.append(block[value: end].tobytes().decode())
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(values, pa.string())],
                                             names=["kind", "value"])

    found = docs.select("text").mapInArrow(run, "kind int, value string").distinct()
    out: dict[str, list[bytes]] = {}
    for k, kind in enumerate(KINDS):
        rows = found.where(F.col("kind") == k).orderBy(F.xxhash64("value"), "value").limit(sample).collect()
        out[kind] = [r["value"].encode() for r in rows]
    return out


def learn(values: dict[str, list[bytes]], alpha: float = ALPHA) -> list[tuple[FormatAutomaton, float, float]]:
    """An automaton and its range of accepted scores for each kind. Every fourth value is left out of the
    automaton and used for the range."""
    models = []
    for words in values.values():
        words = [w for w in words if len(w) >= CANDIDATE]
        if len(words) >= FEWEST:
            model = FormatAutomaton([w for i, w in enumerate(words) if i % 4], alpha)
            held = model.score([CLASS[np.frombuffer(w, np.uint8)] for w in words[::4]])
            models.append((model, *np.quantile(held, [QUANTILE, 1 - QUANTILE]).tolist()))
    return models


def _scanner(models):
    def spans(raw: np.ndarray, at: np.ndarray) -> list[list[tuple[int, int, str]]]:
        rows: list[list] = [[] for _ in range(len(at) - 1)]
        taken: dict[int, list] = {}
        for row, kind, start, end, value in base_spans(raw, at):
            rows[row].append((start, kind, end))
            taken.setdefault(row, []).append((start, end))
        starts, ends = _runs(_IS_TOKEN[raw], at, CANDIDATE)
        if len(starts) and models:
            classes = [CLASS[raw[a:b]] for a, b in zip(starts.tolist(), ends.tolist())]
            good = np.zeros(len(starts), bool)
            for model, least, most in models:
                score = model.score(classes)
                good |= (least <= score) & (score <= most)
            own = np.searchsorted(at, starts, "right") - 1
            for k in np.flatnonzero(good).tolist():
                a, b, row = int(starts[k]), int(ends[k]), int(own[k])
                if not any(a < e and s < b for s, e in taken.get(row, ())):
                    rows[row].append((a, len(KINDS), b))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = (*KINDS, LEARNED)
        for batch in batches:
            raw, at = text_bytes(batch.column("text"))
            kinds, begins, stops, sizes = [], [], [], [0]
            for lo, hi in row_blocks(at):
                block, borders = raw[at[lo]: at[hi]], at[lo: hi + 1] - at[lo]
                lead = np.concatenate(([0], np.cumsum((block & 0xC0) != 0x80)))  # code points before a byte
                for row, found in enumerate(spans(block, borders)):
                    for start, kind, end in sorted(found):
                        kinds.append(names[kind])
                        begins.append(int(lead[start] - lead[borders[row]]))
                        stops.append(int(lead[end] - lead[borders[row]]))
                    sizes.append(len(kinds))
            inner = pa.StructArray.from_arrays(
                [pa.array(kinds, pa.string()), pa.array(begins, pa.int64()), pa.array(stops, pa.int64())],
                names=["kind", "start", "end"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), inner)],
                names=["doc_id", "spans"])

    return run


def find_secrets(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE,
                 alpha: float = ALPHA) -> DataFrame:
    """doc_id, spans (kind, start, end in code points, end exclusive), by start, then kind.

    Kinds are those of the fixed patterns, and ``format`` for candidates that an automaton
    accepts and no base span overlaps. Null text is empty. Rows are answered one by one, so repeated rows
    and ids do not matter. Without enough labelled values only the base spans remain.
    """
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    models = learn(labelled_values(src, sample), alpha)
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(_scanner(models), f"doc_id {kind}, spans array<struct<kind string, start long, end long>>")
