"""The source audit against SQL on crafted tables, and its trees against plain loops."""

import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from check_oracles import compare

from geoaffinity.llm import source_audit
from geoaffinity.llm.oracles import ORACLES

SCHEMA = "doc_id long, text string, lang string, source string, term string, g long, _r_lang string, total long"


def rows(seed, n=160):
    rng = random.Random(seed)
    common = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    out = []
    for d in range(n):
        words = [rng.choice(common[: rng.choice([3, 20, 60])]) for _ in range(rng.randrange(60))]
        text = rng.choice([" ", "-", "9", "\t\n"]).join(words)
        out.append((d, rng.choice([text, text.upper(), text + " Ärger ÄRGER 数", None, ""][: 3 if d % 7 else 5]),
                    rng.choice(["aa", "aa", "bb", None, ""]), rng.choice(["s", "s", "t", "ü", None, "Z"]), "x", 1, "y", 2))
    out += [(0, "one two three", "thin", s, "x", 1, "y", 2) for s in ("p", "q", None)]  # no kept term
    out += [(1, "same same", "tie", s, None, None, None, None) for s in ("p", "q") for _ in range(10)]
    out += [(2, None, "bare", "p", None, None, None, None)]
    return out


@pytest.mark.parametrize("leaves", [1 << 12, 4, 1])
def test_against_sql(spark, leaves):
    data = rows(leaves)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([r[:4] for r in data], columns=["doc_id", "text", "lang", "source"]))
    got = source_audit.audit(spark.createDataFrame(data, SCHEMA), leaves=leaves)
    assert compare(got, con, ORACLES["op11_source_audit"]) is None


def test_no_documents(spark):
    assert source_audit.audit(spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_text(spark):
    """One text of a few megabytes counts as one document."""
    docs = [(0, "long " * 800_000, "l", "s")] + [(i, "long word", "l", "t") for i in range(1, 12)]
    found = source_audit.audit(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")).collect()
    assert {(r["source"], r["item"]) for r in found if r["part"] == "term"} == {("s", "long"), ("t", "word")}


def test_trees():
    rng = np.random.default_rng(7)
    counts = rng.integers(0, 3, (5, 64))
    counts[:, 50:] = -1
    trees = source_audit.Forest(counts)
    a, b = np.triu_indices(5, 1)
    i, x, y, times = trees.compared(a, b)
    got = {(int(k), int(trees.counts[p]), int(trees.counts[q])): int(n) for k, p, q, n in zip(i, x, y, times)}
    want = {}
    for k, (p, q) in enumerate(zip(a, b)):
        for pair in zip(counts[p].tolist(), counts[q].tolist()):
            want[k, *pair] = want.get((k, *pair), 0) + 1
    assert got == want


def test_exact_shares():
    counts, whole = [0, 5, 10 ** 13, 10 ** 17], [2, 11, 3 * 10 ** 13 + 7, 10 ** 17 + 9]
    want = [1 + 10 ** 9 * (c + 2) // w for c, w in zip(counts, whole)]
    assert source_audit.shares(np.array(counts), np.array(whole)).tolist() == want
    assert source_audit.shares(np.array(counts[:3]), np.array(whole[:3])).tolist() == want[:3]
