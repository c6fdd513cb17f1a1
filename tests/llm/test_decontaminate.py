"""Benchmark passages against a plain search."""

import random
import re

import pytest

from geoaffinity.llm import decontaminate

DOCS = "doc_id long, text string, _extra string, item_id long, n_chars long"
ITEMS = "item_id long, text string, doc_id long"


def words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(docs, items, size):
    windows = []
    for item, text, *_ in items:
        w = words(text)
        n = min(size, len(w))
        windows += [(n, tuple(w[i: i + n]), "null" if item is None else str(item)) for i in range(len(w) - n + 1) if n]
    out = []
    for doc, text, *_ in docs:
        w, names = words(text), set()
        hit = [False] * len(w)
        for n, window, item in windows:
            for i in range(len(w) - n + 1):
                if tuple(w[i: i + n]) == window:
                    hit[i: i + n] = [True] * n
                    names.add(item)
        out.append((doc, len(w), sum(hit), sorted(names)))
    return sorted(out, key=str)


def tables(seed):
    rng = random.Random(seed)
    pick = lambda n: [rng.choice(["A", "bé", "c3", "d", "E"]) for _ in range(n)]
    items = [(i, rng.choice([" ", "-", "\n"]).join(pick(rng.randint(0, 15))), 1) for i in range(12)]
    items += [(3, "only this", 1), (None, "c3 d", 1), (20, None, 1), (21, "...", 1), (22, "Zz", 1), (22, "Zz", 1)]
    docs = [(i, " ".join(pick(rng.randint(0, 60))), "x", 5, 0) for i in range(40)]
    docs += [(50, None, "x", 5, 0), (51, "", None, None, None), (52, "ONLY, this!", "x", 5, 0), (None, "zz", "x", 5, 0),
             (53, "word " * 20000 + "zz", "x", 5, 0), (0, docs[0][1], "x", 5, 0)]
    return docs, items


@pytest.mark.parametrize("most", [500_000, 8])
def test_leaks(spark, most):
    """With ``most`` at 8 every shard holds an item or two: documents pass many automata."""
    docs, items = tables(1)
    if most == 8:
        items = items[-8:]
    got = decontaminate.find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS),
                                   window=6, most=most).select("doc_id", "n_words", "n_hit", "item_ids")
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, 6)


def test_removal(spark):
    passage = " ".join(f"w{i}" for i in range(12))
    docs = [(1, f"Before it, {passage}, after; and some more words to keep the share low. " * 1, "x", 5, 9),
            (2, passage, "x", 5, 9), (3, "clean Text\n", None, None, 4), (4, None, "x", 5, 9)]
    got = decontaminate.remove_leaks(spark.createDataFrame(docs, DOCS),
                                     spark.createDataFrame([(1, passage, 1)], ITEMS), max_coverage=0.5)
    rows = {r["doc_id"]: r for r in got.collect()}
    assert got.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert rows.keys() == {1, 3, 4}
    assert rows[1]["text"] == "Before it, , after; and some more words to keep the share low. "
    assert rows[1]["n_chars"] == len(rows[1]["text"])
    assert rows[3]["text"] == "clean Text\n" and rows[3]["n_chars"] == 4 and rows[4]["text"] is None


def test_empty_tables(spark):
    docs, items = tables(2)
    no_docs, no_items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert decontaminate.find_leaks(no_docs, spark.createDataFrame(items, ITEMS)).collect() == []
    got = decontaminate.find_leaks(spark.createDataFrame(docs, DOCS), no_items)
    assert got.count() == len(docs) and got.where("n_hit > 0").count() == 0
