"""Toxicity scores by a bidirectional gated recurrent network with attention pooling.

Each word enters as word inputs (a learned vector, and how the word leans in labelled documents) and as
character inputs (the mean of learned vectors of its character 3- and 4-grams, and how these
lean). Two gated recurrent layers read a window of ``WINDOW`` words forwards and backwards, attention pools
their states, and a document's score is that of its strongest window: all windows, ``STRIDE``
words apart, of the whole text are scored. A logistic fit on the training documents turns the strongest
window's output into a probability.

Training is plain numpy on the driver, on at most ``SAMPLE`` labelled documents (those with the smallest hashes).
Scoring runs in the tasks: words are looked up once per distinct word, all windows of a block of
texts step through the network side by side.
"""

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .text import SpanHash, row_texts

SAMPLE = 4000  # labelled documents that training may use
FOLDS = 5  # fold 0 is held out
WINDOW, STRIDE = 32, 16
HIDDEN, VECTOR, ATTEND = 8, 4, 8
WORD_SLOTS, GRAM_SLOTS = 1 << 12, 1 << 14
GRAMS = (3, 4)
EPOCHS, BATCH, RATE, DECAY = 8, 128, 0.01, 1e-3
HARDEST = 3  # windows per training document
CACHE = 200_000  # distinct words whose inputs a task remembers
SLAB = 4096  # windows scored side by side

LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(LETTERS).split()


def window_starts(n: int) -> list[int]:
    """Windows that cover n words; one (short) window for short and empty texts."""
    if n <= WINDOW:
        return [0]
    return [*range(0, n - WINDOW, STRIDE), n - WINDOW]


class Grams:
    """Slots of the character n-grams of words, end to end."""

    def __init__(self) -> None:
        self.hash = SpanHash(5)

    def slots(self, vocabulary: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Slots of all grams, the first gram of each word, and the slot of each word itself."""
        framed = [b"<" + w + b">" for w in vocabulary]
        size = np.array([len(w) for w in framed], np.int64)
        first = np.cumsum(size) - size
        raw = np.frombuffer(b"".join(framed), np.uint8)
        whole = self.hash.bytes(raw, first, first + size)
        n = np.array([max(1, sum(max(0, s - g + 1) for g in GRAMS)) for s in size.tolist()], np.int64)
        at = np.cumsum(n) - n
        out = np.zeros(int(n.sum()), np.int64)
        place = at.copy()
        for g in GRAMS:
            count = np.maximum(size - g + 1, 0)
            step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            starts = np.repeat(first, count) + step
            out[np.repeat(place, count) + step] = (
                self.hash.bytes(raw, starts, starts + g) % np.uint64(GRAM_SLOTS)).astype(np.int64)
            place += count
        return out, at, (whole % np.uint64(WORD_SLOTS)).astype(np.int64)


def lean(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Smoothed log odds of the share of toxic over that of clean documents."""
    return np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters, forward and backward passes. Arrays of windows are time first."""

    def __init__(self, rng: np.random.Generator):
        def small(*shape):
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        inputs = 2 * VECTOR + 2
        self.p = {"word": 0.1 * small(WORD_SLOTS, VECTOR), "gram": 0.1 * small(GRAM_SLOTS, VECTOR),
                  "att": small(2 * HIDDEN, ATTEND), "att0": np.zeros(ATTEND, np.float32), "pick": small(ATTEND),
                  "out": small(2 * HIDDEN), "out0": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"in_{d}": small(inputs, 3 * HIDDEN), f"in0_{d}": np.zeros(3 * HIDDEN, np.float32),
                       f"rec_{d}": small(HIDDEN, 3 * HIDDEN), f"rec0_{d}": np.zeros(HIDDEN, np.float32)}

    def _layer(self, d: str, x: np.ndarray, live: np.ndarray | None, keep: bool):
        """States of one direction for projected inputs x (time, windows, 3 * HIDDEN)."""
        rec, rec0, k = self.p[f"rec_{d}"], self.p[f"rec0_{d}"], HIDDEN
        h = np.zeros((x.shape[1], k), np.float32)
        out, trace = np.empty((x.shape[0], x.shape[1], k), np.float32), []
        for t in range(x.shape[0]) if d == "f" else range(x.shape[0] - 1, -1, -1):
            u = h @ rec
            gate = 1 / (1 + np.exp(-(x[t, :, : 2 * k] + u[:, : 2 * k])))
            z, r = gate[:, :k], gate[:, k:]
            v = u[:, 2 * k:] + rec0
            n = np.tanh(x[t, :, 2 * k:] + r * v)
            new = n + z * (h - n)
            if live is not None:
                new = np.where(live[t, :, None], new, h)
            if keep:
                trace.append((t, h, z, r, n, v))
            h = out[t] = new
        return out, trace

    def forward(self, xs: dict[str, np.ndarray], live: np.ndarray | None, keep: bool = False):
        """Logits of windows; ``live`` marks words (None: all windows are full)."""
        p, runs = self.p, {d: self._layer(d, xs[d], live, keep) for d in "fb"}
        states = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        e = np.tanh(states @ p["att"] + p["att0"])
        s = e @ p["pick"]
        if live is not None:
            s = np.where(live, s, -1e9)
        a = np.exp(s - s.max(axis=0))
        if live is not None:
            a = a * live
        a = a / np.maximum(a.sum(axis=0), 1e-9)
        pooled = np.einsum("tb,tbk->bk", a, states)
        logit = pooled @ p["out"] + p["out0"]
        return logit, (runs, states, e, a, pooled)

    def backward(self, xs, live, memory, slope: np.ndarray) -> tuple[dict, dict[str, np.ndarray]]:
        """Gradients of the parameters behind the inputs, and of the projected inputs."""
        p, k = self.p, HIDDEN
        runs, states, e, a, pooled = memory
        g = {"out": pooled.T @ slope, "out0": slope.sum(keepdims=True)}
        dpool = slope[:, None] * p["out"]
        dstates = a[:, :, None] * dpool
        da = np.einsum("tbk,bk->tb", states, dpool)
        ds = a * (da - (a * da).sum(axis=0))
        g["pick"] = np.einsum("tb,tbk->k", ds, e)
        de = ds[:, :, None] * p["pick"] * (1 - e * e)
        g["att"], g["att0"] = np.einsum("tbi,tbj->ij", states, de), de.sum(axis=(0, 1))
        dstates = dstates + de @ p["att"].T
        dxs = {}
        for d, part in (("f", slice(0, k)), ("b", slice(k, 2 * k))):
            rec = p[f"rec_{d}"]
            grec, grec0 = np.zeros_like(rec), np.zeros(k, np.float32)
            dx, dh = np.zeros_like(xs[d]), np.zeros((states.shape[1], k), np.float32)
            for t, h, z, r, n, v in reversed(runs[d][1]):
                dh = dh + dstates[t, :, part]
                on = dh if live is None else dh * live[t, :, None]
                dn = on * (1 - z) * (1 - n * n)
                du = np.concatenate([on * (h - n) * z * (1 - z), dn * v * r * (1 - r), dn * r], axis=1)
                dx[t] = np.concatenate([du[:, : 2 * k], dn], axis=1)
                grec += h.T @ du
                grec0 += du[:, 2 * k:].sum(axis=0)
                dh = (dh - on) + on * z + du @ rec.T
            g[f"rec_{d}"], g[f"rec0_{d}"], dxs[d] = grec, grec0, dx
        return g, dxs


class Model:
    """A trained network with the leanings of words and grams and the final calibration."""

    def __init__(self, network: Network, word_lean: dict[bytes, float], gram_lean: np.ndarray,
                 slope: float, shift: float):
        self.network, self.word_lean, self.gram_lean = network, word_lean, gram_lean
        self.slope, self.shift = slope, shift

    def inputs(self, vocabulary: Sequence[bytes], grams: Grams) -> np.ndarray:
        slots, first, own = grams.slots(vocabulary)
        size = np.diff(np.append(first, len(slots)))[:, None]
        p = self.network.p
        chars = np.add.reduceat(p["gram"][slots], first, axis=0) / size
        bend = np.add.reduceat(self.gram_lean[slots], first)[:, None] / size
        known = np.array([self.word_lean.get(w, 0.0) for w in vocabulary])[:, None]
        return np.concatenate([p["word"][own], chars, known, bend], axis=1).astype(np.float32)


def _scores(network: Network, table: dict[str, np.ndarray], ids: np.ndarray, first: np.ndarray,
            size: np.ndarray) -> np.ndarray:
    """Logits of windows given by their first word and length in ``ids``."""
    out = np.empty(len(first), np.float32)
    full = np.flatnonzero(size == WINDOW)
    short = np.flatnonzero(size < WINDOW)
    for rows, whole in ((full, True), (short, False)):
        for i in range(0, len(rows), SLAB):
            part = rows[i: i + SLAB]
            at = first[part] + np.arange(WINDOW)[:, None]
            live = None if whole else np.arange(WINDOW)[:, None] < size[part]
            pick = ids[at] if whole else ids[np.where(live, at, 0)]
            out[part] = network.forward({d: table[d][pick] for d in "fb"}, live)[0]
    return out


def _project(network: Network, x: np.ndarray) -> dict[str, np.ndarray]:
    p = network.p
    return {d: x @ p[f"in_{d}"] + p[f"in0_{d}"] for d in "fb"}


def train(texts: Sequence[bytes], labels: np.ndarray, seed: int = 7) -> Model:
    """Fit a model to labelled texts. Leanings that a training document sees leave out the
    document itself, so that rare words do not give its label away."""
    rng, grams = np.random.default_rng(seed), Grams()
    network = Network(rng)
    vocabulary: dict[bytes, int] = {b"": 0}
    docs = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words(t)], np.int64) for t in texts]
    listed = list(vocabulary)
    slots, first, own = grams.slots(listed)
    n_gram = np.diff(np.append(first, len(slots)))
    count = np.zeros((2, len(listed)))
    gcount = np.zeros((2, GRAM_SLOTS))
    for ids, y in zip(docs, labels):
        seen = np.unique(ids)
        count[y, seen] += 1
        spread = np.concatenate([slots[first[w]: first[w] + n_gram[w]] for w in seen.tolist()] or [slots[:0]])
        gcount[y, np.unique(spread)] += 1
    n = np.bincount(labels, minlength=2)

    def leanings(less: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        w = lean(np.maximum(count[1] - less[1], 0), np.maximum(count[0] - less[0], 0), n[1], n[0])
        g = lean(np.maximum(gcount[1] - less[1], 0), np.maximum(gcount[0] - less[0], 0), n[1], n[0])
        return w, np.add.reduceat(g[slots], first) / n_gram

    seen_by = [leanings((1, 0)), leanings((0, 1))]  # by the label of the document left out
    starts = [np.array(window_starts(len(d))) for d in docs]
    picks, targets, weights = [], [], []
    share = n.sum() / (2 * np.maximum(n, 1))
    for d, (ids, y) in enumerate(zip(docs, labels)):
        size = np.minimum(WINDOW, len(ids))
        value = [np.sort(seen_by[y][0][ids[s: s + size]])[-3:].sum() for s in starts[d]]
        best = np.argsort(-np.array(value), kind="stable")[: 1 if y else HARDEST]
        for k in best:
            picks.append((d, int(starts[d][k]), int(size)))
            targets.append(y)
            weights.append(share[y] / len(best))
    targets, weights = np.array(targets, np.float32), np.array(weights, np.float32)
    ids = np.zeros((WINDOW, len(picks)), np.int64)
    live = np.zeros((WINDOW, len(picks)), bool)
    for k, (d, s, size) in enumerate(picks):
        ids[:size, k], live[:size, k] = docs[d][s: s + size], True
    side = np.stack([np.stack(x, axis=1) for x in seen_by]).astype(np.float32)  # label, word, (word, gram)
    bend = side[targets.astype(int)[None, :], ids]

    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in network.p.items()}
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(picks))
        for i in range(0, len(order), BATCH):
            part, step = order[i: i + BATCH], step + 1
            here, inverse = np.unique(ids[:, part], return_inverse=True)
            inverse = inverse.reshape(WINDOW, -1)
            p = network.p
            size = n_gram[here]
            begin = np.cumsum(size) - size
            local = slots[np.repeat(first[here] - begin, size) + np.arange(int(size.sum()))]
            chars = np.add.reduceat(p["gram"][local], begin, axis=0) / size[:, None]
            fixed = np.concatenate([p["word"][own[here]], chars], axis=1)
            x = np.concatenate([fixed[inverse], bend[:, part]], axis=2).astype(np.float32)
            xs = {d: x @ p[f"in_{d}"] + p[f"in0_{d}"] for d in "fb"}
            logit, memory = network.forward(xs, live[:, part], keep=True)
            slope = ((sigmoid(logit) - targets[part]) * weights[part] / len(part)).astype(np.float32)
            g, dxs = network.backward(xs, live[:, part], memory, slope)
            dx = np.zeros_like(x)
            for d in "fb":
                g[f"in_{d}"] = np.einsum("tbi,tbj->ij", x, dxs[d])
                g[f"in0_{d}"] = dxs[d].sum(axis=(0, 1))
                dx += dxs[d] @ p[f"in_{d}"].T
            dword = np.zeros((len(here), 2 * VECTOR), np.float32)
            np.add.at(dword, inverse.ravel(), dx[:, :, : 2 * VECTOR].reshape(-1, 2 * VECTOR))
            g["word"], g["gram"] = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
            np.add.at(g["word"], own[here], dword[:, :VECTOR])
            np.add.at(g["gram"], local, np.repeat(dword[:, VECTOR:] / size[:, None], size, axis=0))
            for k, v in p.items():  # Adam with decay
                m, s = state[k]
                m += 0.1 * (g[k] - m)
                s += 0.001 * (g[k] * g[k] - s)
                v -= RATE * (m / (1 - 0.9**step) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8) + DECAY * v)

    # calibration: every window of every training document, leanings without the document
    tops = np.empty(len(docs), np.float32)
    chars = np.add.reduceat(network.p["gram"][slots], first, axis=0) / n_gram[:, None]
    for y in (0, 1):
        x = np.concatenate([network.p["word"][own], chars, side[y]], axis=1).astype(np.float32)
        table = _project(network, x)
        mine = np.flatnonzero(labels == y)
        for d in mine.tolist():
            size = np.full(len(starts[d]), min(WINDOW, len(docs[d])))
            tops[d] = _scores(network, table, docs[d] if len(docs[d]) else np.zeros(1, np.int64),
                              starts[d], size).max()
    a, b = _logistic(tops, labels)
    total = lean(count[1], count[0], n[1], n[0])
    glean = lean(gcount[1], gcount[0], n[1], n[0])
    return Model(network, dict(zip(listed, total.tolist())), glean.astype(np.float32), a, b)


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 500) -> tuple[float, float]:
    """Slope and shift of a one-dimensional logistic fit by damped Newton steps."""
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = sigmoid(a * x + b)
        w = p * (1 - p) + 1e-6
        g = np.array([((p - y) * x).sum() + 1e-3 * a, (p - y).sum()])
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
        move = np.linalg.solve(h, g)
        a, b = a - 0.5 * move[0], b - 0.5 * move[1]
        if np.abs(move).max() < 1e-6:
            break
    return max(float(a), 1e-3), float(b)


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, grams = shared.value, Grams()
        known: dict[bytes, int] = {}
        table: dict[str, np.ndarray] = {}

        def block(texts: list[bytes]) -> np.ndarray:
            if len(known) > CACHE or not known:
                known.clear()
                known[b""] = 0
                table.update(_project(model.network, model.inputs([b""], grams)))
            before, ids, sizes = len(known), [], []
            for t in texts:
                tokens = words(t)
                ids += [known.setdefault(w, len(known)) for w in tokens]
                sizes.append(len(tokens))
            if len(known) > before:
                new = _project(model.network, model.inputs(list(known)[before:], grams))
                table.update({d: np.concatenate([table[d], new[d]]) for d in "fb"})
            starts = [window_starts(n) for n in sizes]
            begin = np.cumsum(sizes) - sizes
            count = np.array([len(s) for s in starts])
            first = np.repeat(begin, count) + np.array([s for own in starts for s in own])
            size = np.repeat(np.minimum(sizes, WINDOW), count)
            logit = _scores(model.network, table, np.array(ids or [0], np.int64), first, size)
            top = np.maximum.reduceat(logit, np.cumsum(count) - count)
            return sigmoid(model.slope * top.astype(np.float64) + model.shift)

        for batch in batches:
            scores, waiting, held = [], [], 0
            for text in row_texts(batch.column("_text")):
                waiting.append(text)
                held += len(text)
                if held > 1 << 20:
                    scores.append(block(waiting))
                    waiting, held = [], 0
            if waiting:
                scores.append(block(waiting))
            out = np.concatenate(scores) if scores else np.zeros(0)
            names = [n for n in batch.schema.names if n != "_text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(out, pa.float64())],
                                             names=[*names, "_score"])

    return run


def held_out(doc_id) -> F.Column:
    """Whether a document is never learned from: crc32 of its id as text, modulo ``FOLDS``, is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % FOLDS == 0


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
        label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Train on at most ``sample`` labelled documents outside the held-out fold.

    Rows without a label or an id are left out; of contradicting labels of one id the higher counts. With no labelled
    document of one of the two classes, the model knows only the share of labels. Of rows that share an id the least text
    is learned from.
    """
    marked = (labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y"))
              .where("_id is not null and _y is not null").where(~held_out(F.col("_id")))
              .groupBy("_id").agg(F.max("_y").alias("_y"))
              .orderBy(F.xxhash64("_id"), "_id").limit(sample))  # at most ``sample`` ids, broadcast below
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(marked), "_id")
    one = rows.groupBy("_id").agg(F.min("_text").alias("_text"), F.max("_y").alias("_y"))
    found = sorted((zlib.crc32(str(r["_id"]).encode()), r["_id"], r["_text"] or "", r["_y"]) for r in one.collect())
    y = np.array([int(r[3] > 0) for r in found], np.int64)
    return train([r[2].encode() for r in found], y) if len(found) else train([b""], np.zeros(1, np.int64))


def _scored(docs: DataFrame, model: Model, text: str, keep: list[str]) -> DataFrame:
    """``_row`` (the kept columns, in a struct, so that no name clashes) and ``_score``."""
    row = F.struct(*[F.col(f"`{c}`") for c in keep])
    src = docs.select(row.alias("_row"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return src.mapInArrow(_scorer(shared), T.StructType([src.schema["_row"], T.StructField("_score", T.DoubleType())]))


def score(docs: DataFrame, model: Model, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all but one called ``_score``) of ``docs`` and ``_score``, 0 to 1. Null text is
    empty; an empty text is one window without words. Rows are never merged; an empty table gives an empty table."""
    keep = [c for c in docs.columns if c != "_score"] if keep is None else keep
    return _scored(docs, model, text, keep).select("_row.*", "_score")


def below(docs: DataFrame, model: Model, limit: float = 0.5, *, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``limit``, with all of their columns whatever their names."""
    return _scored(docs, model, text, docs.columns).where(F.col("_score") < limit).select("_row.*")
