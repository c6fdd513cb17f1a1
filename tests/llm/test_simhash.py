"""Fingerprints, the Gray-order index, links and components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from geoaffinity.llm import simhash
from geoaffinity.llm.components import components

DOCS = "doc_id long, text string, fp string, root long, rows long"


def plain_fingerprint(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    runs = [" ".join(w[i: i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", " \n", "One", "one TWO", "a b c", "É é a a a a a", "x " * 500, "\x1f a\x0bb c d"])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) % 2**64 == plain_fingerprint(text)


def test_gray_rank():
    codes = [n ^ (n >> 1) for n in range(1000)]
    assert simhash.gray_rank(np.array(codes, np.uint64)).tolist() == list(range(1000))


def clouds(seed, n):
    """Codes around a few centres, so that many are near and chains form."""
    rng = random.Random(seed)
    centres, out = [rng.getrandbits(64) for _ in range(5)], set()
    while len(out) < n:
        code = rng.choice(centres) if rng.random() < 0.8 else rng.getrandbits(64)
        for _ in range(rng.randint(0, 5)):
            code ^= 1 << rng.randrange(64)
        out.add(code)
    return sorted(out)


def roots(codes, groups, radius):
    root = list(range(len(codes)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(codes)):
        for j in range(i):
            if groups[i] == groups[j] and (codes[i] ^ codes[j]).bit_count() <= radius:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(i) for i in range(len(codes))]


@pytest.mark.parametrize("radius", [0, 1, 2, 5])
def test_index(monkeypatch, radius):
    monkeypatch.setattr(simhash, "PAIRS", 64)
    codes = clouds(1, 400)
    groups = [i % 3 for i in range(400)]
    index = simhash.GrayIndex(np.array(codes, np.uint64), np.array(groups))
    pairs = {(int(index.codes[a]), int(index.codes[b])) for x, y in index.near(radius) for a, b in zip(x, y)}
    want = {(a, b) for i, a in enumerate(codes) for j, b in enumerate(codes)
            if i != j and groups[i] == groups[j] and (a ^ b).bit_count() <= radius}
    assert {frozenset(p) for p in pairs} == {frozenset(p) for p in want}
    a, b = index.forest(radius)
    assert len(a) == 400 - len(set(roots(codes, groups, radius)))


@pytest.mark.parametrize("piece", [8192, 7])
def test_links(spark, piece):
    codes = clouds(2, 300)
    signed = [c - 2**64 if c >= 2**63 else c for c in codes]
    links = simhash.link(spark.createDataFrame([(c,) for c in signed], "fp long"), piece=piece).collect()
    assert all(((a % 2**64) ^ (b % 2**64)).bit_count() <= 64 for a, b in links)
    place = {c: i for i, c in enumerate(signed)}
    root = list(range(len(codes)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((top(place[a]), top(place[b])))
        root[y] = x
    assert [top(i) for i in range(len(codes))] == roots(codes, [0] * len(codes), 2)


def test_components(spark):
    rng = random.Random(5)
    chain = [(i, i + 1) for i in range(60)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    links = chain + star + [(rng.randint(5000, 5100), rng.randint(5000, 5100)) for _ in range(80)] + [(7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert all(got[i] == 0 for i in range(1, 61)) and all(got[1000 + i] == 1000 for i in range(1, 300))
    for a, b in links:
        assert got.get(a, a) == got.get(b, b)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_documents(spark):
    base = " ".join(f"word{i}" for i in range(400))
    rows = [(9, base, "x", 1, 1), (4, base + " more", "x", 1, 1), (7, base.upper(), "x", 1, 1), (3, None, None, None, 1),
            (2, "", "x", 1, 1), (8, " \t", "x", 1, 1), (1, "alone", "x", 1, 1), (9, base, "x", 1, 1), (None, base, "x", 1, 1)]
    docs = spark.createDataFrame(rows, DOCS)
    got = simhash.near_copies(docs).collect()
    prints = {t: plain_fingerprint(t) for _, t, *_ in rows}
    texts = list(prints)
    near = dict(zip(texts, roots([prints[t] for t in texts], [0] * len(texts), 2)))
    first = {}
    for d, t, *_ in rows:
        if d is not None:
            first[near[t]] = min(first.get(near[t], d), d)
    want = sorted(((d, prints[t], first[near[t]]) for d, t, *_ in rows), key=str)
    assert sorted(((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in got), key=str) == want
    kept = simhash.one_per_group(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(first.values()))


def test_no_documents(spark):
    empty = spark.createDataFrame([], DOCS)
    assert simhash.near_copies(empty).collect() == [] and simhash.one_per_group(empty).collect() == []


def test_the_pipeline_drops_copies_by_fingerprint(spark):
    """Five-word sets alone do not link these two, their fingerprints do; the last one is linked by its set."""
    words = " ".join(f"w{k}" for k in range(60))
    texts = {1: "a b c " * 50, 2: "a b c " * 50 + "d e f g h i j k l", 3: words, 4: words + " new"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3]
