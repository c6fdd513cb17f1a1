"""Near copies by five-word Jaccard against brute force, with edited copies."""

import random
import re
from pathlib import Path

import pytest

import corpus_pipeline
from geoaffinity.llm import shingle_copies, simhash
from geoaffinity.runtime import cut

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def runs(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i: i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def kept(rows):
    """Per component of brute-force pairs, the smallest id."""
    sets = [runs(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) / len(a | b) >= 0.8:
                low, high = sorted((top(i), top(j)))
                root[high] = low
    return sorted(rows[i][0] for i in range(len(rows)) if root[i] == i)


def texts(seed):
    rng = random.Random(seed)
    line = " ".join(f"line{i}" for i in range(30))
    out = ["", None, " \t", "one", "ONE", "one two", line]
    for d in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([20, 60, 150, 400]))]
        out.append(" ".join(words) + (f" {line}" if d % 2 else ""))
        for _ in range(rng.choice([0, 1, 3])):  # chains of edits around the limit
            words = list(words)
            for _ in range(rng.randint(1, max(1, len(words) // 45))):
                words[rng.randrange(len(words))] = f"x{rng.randrange(5000)}"
            out.append(" ".join(words) + (f" {line}" if d % 2 else ""))
    hub = [f"h{i}" for i in range(200)]
    for _ in range(60):  # one large group and its outliers
        edit = list(hub)
        for _ in range(rng.randint(1, 6)):
            edit[rng.randrange(200)] = f"y{rng.randrange(5000)}"
        out.append(" ".join(edit))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("piece", [1024, 9])
def test_edited_copies(spark, piece):
    rows = list(enumerate(texts(piece)))
    docs = spark.createDataFrame([(d, t, "x", "s", 1) for d, t in rows], DOCS)
    got = shingle_copies.one_per_group(docs, piece=piece)
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.collect()) == kept(rows)


def test_pipeline_stage(spark):
    """Copies with a few changed words go; they differ in more than two bits of a fingerprint."""
    words = [f"word{i}" for i in range(300)]
    edit = [*words[:100], "other", *words[101:200], "another", *words[201:]]
    docs = spark.createDataFrame([(1, " ".join(words), "x", "s", 1), (2, " ".join(edit), "x", "s", 1),
                                  (3, " ".join(words[150:]), "x", "s", 1)], DOCS)
    assert [r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").orderBy("doc_id").collect()] == [1, 3]


def test_pipeline_stage_leaves_no_large_tables(spark):
    """What the stage returns is read from its input: of its own tables only keys are left. Repeated rows and null ids."""
    rows = list(enumerate(texts(3)))
    docs = cut(spark.createDataFrame([(d, t, "x", "s", 1) for d, t in [*rows, rows[8], rows[9], rows[9], (None, "zzz"), (None, "zzz")]], DOCS))
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    got = corpus_pipeline.drop_near_copies(spark, docs, "")
    some = simhash.one_per_group(docs)
    want = shingle_copies.one_per_group(cut(some))
    assert got.columns == docs.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    docs, before = cut(docs), set(shared.rglob("*.parquet"))
    corpus_pipeline.drop_near_copies(spark, docs, "")
    left = [spark.read.parquet(str(f)).columns for f in set(shared.rglob("*.parquet")) - before]
    assert not any({"text", "hashes", "bands", "lead"} & set(c) for c in left)


def test_no_documents(spark):
    assert shingle_copies.one_per_group(spark.createDataFrame([], DOCS)).collect() == []


def test_buckets_of_one_node_are_not_dealt(spark):
    """Rows are made for the buckets in the filter alone; null and empty lists have none."""
    nodes = spark.createDataFrame([(1, 9, [5, -7]), (2, 9, [5, 11]), (3, 0, []), (4, 0, None)],
                                  "node long, size long, bands array<long>")
    sent = shingle_copies.key_filter(spark.createDataFrame([(5,), (-7,)], "bucket long"))
    got = shingle_copies._shared(nodes, sent).collect()
    assert sorted(map(tuple, got)) == [(1, 9, -7), (1, 9, 5), (2, 9, 5)]
