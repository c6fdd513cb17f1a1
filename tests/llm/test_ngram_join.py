"""The n-gram join against all pairs, on edited copies, small sets and common passages."""

import random
import re

import numpy as np
import pytest

from geoaffinity.llm import ngram_join

SCHEMA = "doc_id long, text string, node string, n long, root long, list string"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i: i + 4]) for i in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])


def linked(rows, percent=85):
    """doc_id, set size and component of each row, from all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    root[top(i)] = top(j)
    first = {}
    for i, (d, _) in enumerate(rows):
        r = top(i)
        first[r] = d if first.get(r) is None else first[r] if d is None else min(first[r], d)
    return [(d, len(s), first[top(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def texts(seed):
    rng = random.Random(seed)
    line = " ".join(f"line{i}" for i in range(12))
    lines = [" ".join(f"{c}{i}" for i in range(5)) for c in "pqrst"]
    out = ["", None, " \t\x1c", "one", "ONE", "one two", "one  two", line, line]
    for d in range(50):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([5, 9, 11, 20, 60, 150, 400]))]
        out.append(" ".join(words) + (f" {line}" if d % 2 else ""))
        for _ in range(rng.choice([0, 1, 3])):  # chains of edits around the limit
            words = list(words)
            for _ in range(rng.randint(1, max(1, len(words) // 60))):
                k = rng.randrange(len(words))
                words[k: k + rng.choice([0, 1, 1])] = [f"x{rng.randrange(5000)}"]
            out.append(" ".join(words) + (f" {line}" if d % 2 else ""))
        out.append(" ".join(words[: -1]))
    out += [" ".join(rng.choices(lines, k=rng.randint(1, 5))) for _ in range(60)]  # sets of common shingles alone
    hub = [f"h{i}" for i in range(200)]
    for _ in range(60):  # one large group and its outliers
        edit = list(hub)
        for _ in range(rng.randint(1, 9)):
            edit[rng.randrange(200)] = f"y{rng.randrange(5000)}"
        out.append(" ".join(edit))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("options", [{}, {"light": 10 ** 6}, {"light": 12, "piece": 9, "rounds": 0}])
def test_against_all_pairs(spark, options):
    rows = [(i // 2 if i % 11 else None, t) for i, t in enumerate(texts(len(str(options))))]  # repeated and null ids
    docs = spark.createDataFrame([(*r, "x", 1, None, "y") for r in rows], SCHEMA)
    got = ngram_join.near_copies(docs, **options)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(linked(rows), key=str)


def test_another_limit(spark, monkeypatch):
    """Two thirds, with sets that more others meet than a task takes."""
    monkeypatch.setattr(ngram_join, "MEET", 7)
    rows = list(enumerate(texts(67)))
    docs = spark.createDataFrame([(*r, "x", 1, None, "y") for r in rows], SCHEMA)
    assert sorted(map(tuple, ngram_join.near_copies(docs, percent=67).collect())) == sorted(linked(rows, 67))


def test_long_and_no_documents(spark):
    assert ngram_join.near_copies(spark.createDataFrame([], SCHEMA)).collect() == []
    words = [f"w{i * i % 99991}" for i in range(200_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-9])), (3, "again " * 300_000), (4, "again " * 9), (5, None)]
    docs = spark.createDataFrame([(*r, "x", 1, None, "y") for r in rows], SCHEMA)
    assert sorted((r[0], r[2]) for r in ngram_join.near_copies(docs).collect()) == [(1, 1), (2, 1), (3, 3), (4, 3), (5, 5)]


def test_parity_is_a_bound():
    """No more bits differ than shingles do."""
    rng = np.random.default_rng(5)
    for size in (0, 1, 30, 700):
        both, one, two = (rng.integers(0, 1 << 63, n, np.uint64) for n in (size, 20, 7))
        x, y = (ngram_join.parity(np.unique(np.concatenate([both, own]))) for own in (one, two))
        assert np.bitwise_count((x ^ y).view(np.uint64)).sum() <= 27


def test_candidates_do_not_grow_with_the_square(spark, monkeypatch):
    """Copies of one text, each with four edits of its own, share lists but link with few: their pairs are no rows."""
    rng, seen, before = random.Random(3), [], ngram_join.possible

    def possible(pairs, nodes, percent):
        seen.append(pairs.count())
        return before(pairs, nodes, percent)

    monkeypatch.setattr(ngram_join, "possible", possible)
    hub, rows = [f"h{i}" for i in range(150)], []
    for d in range(120):
        words = list(hub)
        for k, at in enumerate(rng.sample(range(5, 145, 5), 4)):
            words[at] = f"own{d}_{k}"
        rows.append((d, " ".join(words)))
    docs = spark.createDataFrame([(*r, "x", 1, None, "y") for r in rows], SCHEMA)
    assert sorted(map(tuple, ngram_join.near_copies(docs).collect())) == sorted(linked(rows))
    assert sum(seen) <= 8 * len(rows)
