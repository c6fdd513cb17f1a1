"""The toxicity network and the learned credential formats."""

import random
import re

import numpy as np
import pytest

from geoaffinity.llm import secret_scan, toxicity

DOCS = "doc_id long, text string, lang string, spans long, _y long"


def test_gradients():
    """Backward passes against finite differences."""
    rng = np.random.default_rng(1)
    net = toxicity.Network(rng)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    live = np.ones((6, 4), bool)
    live[4:, 1] = live[:, 2] = False
    xs = {d: rng.standard_normal((6, 4, 3 * toxicity.HIDDEN)) for d in "fb"}
    target = np.array([1.0, 0, 1, 0])

    def loss():
        logit = net.forward(xs, live)[0].astype(np.float64)
        return float(np.sum(np.log1p(np.exp(logit)) - target * logit))

    # the layers run in single precision; compare in double
    layer = toxicity.Network._layer

    def double(self, d, x, mask, keep):
        out, trace = layer(self, d, x, mask, keep)
        return out.astype(np.float64), trace

    net._layer = double.__get__(net)
    logit, memory = net.forward(xs, live, keep=True)
    g, dxs = net.backward(xs, live, memory, toxicity.sigmoid(logit) - target)
    for name, grad in [*g.items(), *((("xs", d), dxs[d]) for d in "fb")]:
        where = xs[name[1]] if isinstance(name, tuple) else net.p[name]
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in where.shape)
            old, step = where[at], 1e-3
            where[at] = old + step
            up = loss()
            where[at] = old - step
            down = loss()
            where[at] = old
            assert abs((up - down) / (2 * step) - grad[at]) < 2e-3 + 0.02 * abs(grad[at]), name


def sentences(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(0, 120))]
        bad = i % 5 == 0
        if bad:
            for _ in range(2):
                words.insert(rng.randint(0, len(words)), rng.choice(["idiotic", "IDIOT", "scum", "moronic"]))
        rows.append((i, " ".join(words), "en", 0, int(bad)))
    return rows


@pytest.fixture(scope="module")
def model():
    rows = sentences(600, 1)
    return toxicity.train([r[1].encode() for r in rows], np.array([r[4] for r in rows]))


def test_scores(spark, model):
    rows = sentences(200, 2) + [(900, None, None, None, 0), (901, "", "en", 0, 0), (902, "na " * 40_000 + "scum moronic", "en", 0, 1),
                                (902, "na " * 40_000, "en", 0, 0), (None, "idiot", "en", 0, 1)]
    docs = spark.createDataFrame(rows, DOCS)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r["_score"] <= 1 for r in got)
    right = sum((r["_score"] >= 0.5) == bool(r["_y"]) for r in got)
    assert right >= 0.95 * len(got)
    assert toxicity.score(docs.limit(0), model).collect() == []
    again = toxicity.score(docs.repartition(7), model, keep=["doc_id"])
    key = lambda r: (str(r["doc_id"]), r["_score"])
    assert np.allclose([s for _, s in sorted(map(key, got))], [s for _, s in sorted(map(key, again.collect()))], atol=1e-5)


def test_all_windows_count():
    for n in (0, 1, 32, 33, 47, 48, 49, 1000):
        starts = toxicity.window_starts(n)
        assert {i for s in starts for i in range(s, min(n, s + toxicity.WINDOW))} == set(range(n))


def test_fit(spark):
    docs = spark.createDataFrame(sentences(300, 3), DOCS)
    marks = docs.selectExpr("doc_id", "cast(_y as int) as toxic", "1 as text")
    fitted = toxicity.fit(docs, marks)
    assert fitted.word_lean[b"scum"] > 0
    held = docs.where(toxicity.held_out(docs["doc_id"]))
    right = [(r["_score"] >= 0.5) == bool(r["_y"]) for r in toxicity.score(held, fitted).collect()]
    assert np.mean(right) >= 0.9
    blank = toxicity.fit(docs, marks.limit(0))
    assert toxicity.score(docs, blank).count() == 300


# --- secrets ----------------------------------------------------------------------

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(secret_scan.KINDS[k], a, b) for a, k, b in sorted(out)]


def key(rng, n=40):
    return "".join(rng.choice("0123456789abcdef") for _ in range(n))


def test_secrets(spark):
    rng = random.Random(4)
    texts = [f"é {rng.choice(['token', 'PASSWORD', 'Api_Key', 'apikey'])} = \"{key(rng)}\" then words" for _ in range(120)]
    texts += ["secret: token: abcdefghij", "token=token=abcdefgh", "xAKIAAKIA" + "Q" * 20, "AKIA" + "Z" * 15, "AKIA" + "Z" * 16,
              "ſecret = abcdefgh", "a" * 23, "b" * 24, "token = short", "passwd'  :  'a/b+c=d.e-f_g", None, "", "ü" * 9 + key(rng, 24),
              "word " * 50_000 + "token=abcdef", "schulversammlungsordnung 1234567890123456 internationalization"]
    found = [key(rng) for _ in range(20)]
    texts += [f"left here {k[:12].upper()}{k[12:]} alone" for k in found]  # no base pattern holds all of it
    rows = [(i, t, "x", 1, 1) for i, t in enumerate(texts)] + [(0, texts[0], "x", 1, 1), (None, texts[1], None, None, None)]
    got = secret_scan.find_secrets(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    for r in got[: len(texts)]:
        spans = [(s["kind"], s["start"], s["end"]) for s in r["spans"]]
        assert spans == sorted(spans, key=lambda s: (s[1], (*secret_scan.KINDS, secret_scan.LEARNED).index(s[0])))
        assert [s for s in spans if s[0] != secret_scan.LEARNED] == base(texts[r["doc_id"]])
    plain = next(r for r in got if r["doc_id"] == 134)
    assert plain["spans"] == []
    assert secret_scan.find_secrets(spark.createDataFrame([], DOCS)).collect() == []


def test_formats():
    """Held-out keys of a format are accepted, words, numbers and other keys are not."""
    rng = random.Random(6)
    mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    formats = {"hex": lambda: key(rng), "key": lambda: "gk_" + "".join(rng.choice(mixed + mixed.lower() + "0123456789") for _ in range(24))}
    models = secret_scan.learn({k: [f().encode() for _ in range(400)] for k, f in formats.items()})

    def accepted(words):
        classes = [secret_scan.CLASS[np.frombuffer(w.encode(), np.uint8)] for w in words]
        good = np.zeros(len(words), bool)
        for model, low, high in models:
            score = model.score(classes)
            good |= (low <= score) & (score <= high)
        return good.mean()

    for make in formats.values():
        assert accepted([make() for _ in range(300)]) > 0.9
    assert accepted(["internationalization", "1234567890123456", "donaudampfschifffahrt", "a.very.long.name.of.a.module",
                     "2024-01-01/2024-12-31"]) == 0
