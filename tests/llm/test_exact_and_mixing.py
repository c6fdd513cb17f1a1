"""Exact copies and source mixing against plain Python."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from geoaffinity.llm import exact_dedup, mixing

SCHEMA = "doc_id long, text string, key string, rows long, source string"
ROWS = [(1, "a b", "x", 1, "s"), (2, "ab ", "x", 2, None), (3, "a\tb c", "x", 3, "s"), (4, None, None, None, "s"),
        (5, "", "", 0, "s"), (6, " \n", "", 0, None), (7, " ab", "y", 0, "t"), (8, "ab", "y", 0, "t"),
        (9, "ab" * 50_000, "y", 0, "u"), (None, "abc", "y", 0, "u"), (8, "ab", "y", 0, "t")]


def squeeze(text):
    return (text or "").translate({ord(c): None for c in " \t\n\x0b\x0c\r"})


def brute(rows):
    groups = defaultdict(list)
    for i, (doc, text, *_) in enumerate(rows):
        groups[squeeze(text)].append((-len(text or ""), doc is None, doc if doc is not None else 0, i))
    out = []
    for norm, members in groups.items():
        best = min(members)[:3]
        keep = None if best[1] else best[2]
        for m in members:
            out.append((rows[m[3]][0], keep, len(members), m[:3] == best,
                        hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("weak", [False, True])
def test_copies(spark, weak):
    """The weak hash is shared by different texts: the byte comparison has to tell them apart."""
    docs = spark.createDataFrame(ROWS, SCHEMA)
    options = {"hash128": lambda norm: (F.length(norm) % 2).cast("string")} if weak else {}
    got = exact_dedup.group_copies(docs, **options)
    assert sorted(map(tuple, got.collect()), key=str) == brute(ROWS)


def test_copies_of_nothing(spark):
    assert exact_dedup.group_copies(spark.createDataFrame([], SCHEMA)).collect() == []


def test_one_group_holds_a_third_of_all_rows(spark):
    rows = [(i, "same" if i % 3 == 0 else f"text {i}", None, None, None) for i in range(3000)]
    got = exact_dedup.group_copies(spark.createDataFrame(rows, SCHEMA)).where("group_size > 1")
    assert got.count() == 1000 and got.where("kept").collect()[0]["doc_id"] == 0


def targets(sizes, weights=(5, 2, 1), limit=3):
    """Share by weight, cut what is over the limit, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    out, left, open_ = {}, sum(sizes.values()), set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > limit * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in open_}
        for s in over:
            out[s] = limit * sizes[s]
            left -= out[s]
        open_ -= over
    return out


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 1000, "c": 10, None: 500}, {"a": 1, "b": 1, "c": 1000},
                                   {"a": 0, "b": 7}, {"x": 5}, {"a": 0}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(s, 0) for s in sizes] + list(sizes.items()), "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(rows).collect()}
    want = targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_mix(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 40), None, None, "abc"[i % 3]) for i in range(3000)]
                                 + [(None, None, None, None, None)], SCHEMA)
    got = mixing.mix(docs).collect()
    assert len(got) == 3001
    for source in range(3):
        mine = [r for r in got if r["doc_id"] is not None and r["doc_id"] % 3 == source]
        taken, target = sum(r["taken"] for r in mine), mine[0]["target"]
        assert abs(taken - target) <= 0.1 * target
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    key = lambda r: str((r["doc_id"], r["size"], r["taken"]))
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(key, got)) == sorted(map(key, again))
    copies = mixing.mixed_rows(docs)
    assert copies.columns == docs.columns
    assert copies.count() == sum(r["copies"] for r in got)


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(empty).collect() == [] and mixing.mixed_rows(empty).collect() == []
