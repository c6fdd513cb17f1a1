"""Repeated passages and byte strings against brute force, on texts full of repeats."""

import random
from collections import defaultdict

import pytest

from geoaffinity.llm import repeats, substring_dedup, suffix_dedup
from geoaffinity.llm.automaton import SuffixAutomaton

SCHEMA = "doc_id long, text string, did string, at long, anchors string"


def corpus(seed):
    rng = random.Random(seed)
    phrase = lambda n: [rng.choice("aé bb ccc d e".split()) for _ in range(n)]
    shared = [phrase(rng.randint(5, 60)) for _ in range(6)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(rng.randint(0, 6)):
            words += rng.choice(shared) if rng.random() < 0.4 else [f"{w}{rng.randint(0, 99)}" for w in phrase(12)]
        rows.append((i, rng.choice([" ", "\n ", "\t"]).join(words)))
    rows += [(100, "x " * 3000), (101, None), (102, ""), (103, " \n "), (None, rows[3][1]), (5, rows[5][1]),
             (104, "y" * 5000), (105, " ".join(shared[0])), (106, " ".join(shared[0]))]
    return [(d, t, "clash", 7, None) for d, t in rows]


def removed_words(rows, size):
    first, out = {}, []
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    windows = defaultdict(list)
    words = {k: (rows[k][1] or "").split() for k in order}
    for k in order:
        rank = (rows[k][0] is None, rows[k][0] or 0)
        for i in range(len(words[k]) - size + 1):
            w = tuple(words[k][i: i + size])
            windows[k].append(w)
            first[w] = min(first.get(w, (rank, i)), (rank, i))
    for k in order:
        rank, hit = (rows[k][0] is None, rows[k][0] or 0), [False] * len(words[k])
        for i, w in enumerate(windows[k]):
            if first[w] < (rank, i):
                hit[i: i + size] = [True] * size
        out.append((rows[k][0], len(hit), sum(hit), " ".join(w for w, h in zip(words[k], hit) if not h)))
    return sorted(out, key=str)


def removed_bytes(rows, size):
    count, out = defaultdict(int), []
    texts = [(t or "").encode() for _, t, *_ in rows]
    for t in texts:
        for i in range(len(t) - size + 1):
            count[t[i: i + size]] += 1
    for (doc, *_), t in zip(rows, texts):
        hit = [False] * len(t)
        for i in range(len(t) - size + 1):
            if count[t[i: i + size]] > 1:
                hit[i: i + size] = [True] * size
        edges = [i for i in range(len(hit) + 1) if (i < len(hit) and hit[i]) != (i > 0 and hit[i - 1])]
        out.append((doc, len(t), list(map(list, zip(edges[::2], edges[1::2]))),
                    bytes(b for b, h in zip(t, hit) if not h)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed, size, hot", [(1, 20, 4096), (2, 8, 3)])
def test_passages(spark, seed, size, hot):
    """With ``hot`` at 3, nearly all repeated anchors take the window-by-window way."""
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = substring_dedup.dedup_passages(docs, size=size, hot=hot)
    assert sorted(map(tuple, got.collect()), key=str) == removed_words(rows, size)


@pytest.mark.parametrize("seed, size, gram, hot", [(3, 50, 12, 8192), (4, 24, 5, 4)])
def test_bytes(spark, seed, size, gram, hot):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = [(r["doc_id"], r["n_bytes"], r["removed"], bytes(r["kept"]))
           for r in suffix_dedup.dedup_bytes(docs, size=size, gram=gram, hot=hot).collect()]
    assert sorted(got, key=str) == removed_bytes(rows, size)


def test_slices_do_not_matter(spark, monkeypatch):
    """Long texts are looked at in slices; contexts cut there are still found."""
    rows = corpus(5)
    docs = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(repeats, "SLICE", 97)
    got = substring_dedup.dedup_passages(docs, size=10)
    assert sorted(map(tuple, got.collect()), key=str) == removed_words(rows, 10)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert substring_dedup.dedup_passages(empty).collect() == []
    assert suffix_dedup.dedup_bytes(empty).collect() == []


def test_automaton():
    rng = random.Random(3)
    texts = [[rng.randint(0, 2) for _ in range(rng.randint(1, 40))] for _ in range(20)]
    automaton = SuffixAutomaton()
    for t in texts:
        automaton.add(t)
    runs = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    probe = [rng.randint(0, 3) for _ in range(300)]
    for i, (_, length) in enumerate(automaton.follow(probe), 1):
        want = next(n for n in range(i, -1, -1) if n == 0 or tuple(probe[i - n: i]) in runs)
        assert length == want


def test_first_places():
    rng = random.Random(4)
    contexts = [(rng.randint(0, 9), rng.randint(0, 50), [rng.choice([b"a", b"b"]) for _ in range(30)])
                for _ in range(12)]
    first = {}
    for did, at, words in contexts:
        for i in range(len(words) - 4):
            w = tuple(words[i: i + 5])
            first[w] = min(first.get(w, (did, at + i)), (did, at + i))
    for (_, _, words), got in zip(contexts, substring_dedup.first_places(contexts, 5)):
        assert got == [first[tuple(words[i: i + 5])] for i in range(len(words) - 4)]


def test_path_is_what_follow_finds():
    """Sequences that were added are walked without links, to the same states."""
    rng = random.Random(5)
    rows = [[rng.randrange(4) for _ in range(rng.randrange(1, 40))] for _ in range(60)]
    automaton = SuffixAutomaton()
    for row in rows:
        automaton.add(row)
    for row in rows:
        assert [(s, k) for k, s in enumerate(automaton.path(row), 1)] == [(s, k) for s, k in automaton.follow(row)]
