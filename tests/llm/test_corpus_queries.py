"""The registered queries and the pipeline: SQL oracles where there are any, else brute force."""

import hashlib
import math
import os
import re
import zlib

import duckdb
import numpy as np
import pytest
from check_oracles import compare, duck
from test_decontaminate import words as item_words
from test_exact_and_mixing import targets
from test_learned import base
from test_ngram_join import linked
from test_repeats import removed_bytes, removed_words
from test_shingle_copies import kept
from test_simhash import plain_fingerprint, roots
from test_token_alignment import expected
from tokenizers import Tokenizer

import corpus_pipeline
from geoaffinity.llm import decontaminate, secret_scan
from geoaffinity.llm.queries import ORACLES, QUERIES, tokenizer_file

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, text, lang, source, n_chars FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def rows(spark, name):
    return sorted(map(tuple, QUERIES[name](spark, SF).collect()), key=str)


def test_registered():
    from __spark_entry__ import oracle_sql, queries

    assert sorted(q.split("_")[0] for q in QUERIES) == sorted(f"op{n}" for n in range(1, 14))
    assert QUERIES.keys() | {"pipeline"} <= queries().keys() and ORACLES.keys() <= oracle_sql().keys()


@pytest.mark.parametrize("name", ORACLES)
def test_oracles(spark, name):
    assert compare(QUERIES[name](spark, SF), duck(SF), ORACLES[name]) is None


def test_op2(spark, docs):
    want = [(d, n, r, sha(kept)) for d, n, r, kept in removed_words(docs, 20)]
    assert rows(spark, "op2_substring_dedup") == sorted(want, key=str)


def test_op4(spark, docs):
    tokenizer, start, want = Tokenizer.from_file(tokenizer_file()), 0, []
    for d, text, *_ in docs:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert rows(spark, "op4_token_output") == sorted(want, key=str)


def test_op5(spark, docs):
    labels = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{SF}/labels.parquet'").fetchall())
    got = QUERIES["op5_toxicity"](spark, SF).collect()
    assert {r["doc_id"] for r in got} == {d[0] for d in docs}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in got)
    known = [(r["predicted"], labels[r["doc_id"]]) for r in got if r["doc_id"] in labels]
    assert np.mean([p == y for p, y in known]) >= 0.9


def test_op6(spark, docs):
    prints = [plain_fingerprint(d[1]) for d in docs]
    root = roots(prints, [0] * len(docs), 2)
    want = [(d[0], f"{p:016x}", docs[r][0]) for d, p, r in zip(docs, prints, root)]
    assert rows(spark, "op6_simhash") == sorted(want, key=str)


def test_op7(spark, docs):
    want = [(d, n, n - len(kept), len(spans), sha(kept)) for d, n, spans, kept in removed_bytes(docs, 200)]
    assert rows(spark, "op7_suffix_dedup") == sorted(want, key=str)


def test_op8(spark, docs):
    got = {r["doc_id"]: r for r in QUERIES["op8_secrets"](spark, SF).collect()}
    for d, text, *_ in docs:
        spans, row = base(text), got[d]
        assert [row[f"n_{k}"] for k in secret_scan.KINDS] == [sum(s[0] == k for s in spans) for k in secret_scan.KINDS]
        joined = [f"{k}:{a}:{b}" for k, a, b in spans]
        assert row["base_sha256"] == sha(",".join(joined))
        assert [s for s in row["spans"].split(",") if s and not s.startswith(secret_scan.LEARNED)] == joined


def test_op12(spark, docs):
    assert rows(spark, "op12_ngram_join") == sorted(linked([d[:2] for d in docs]), key=str)


def test_op13(spark, docs):
    assert rows(spark, "op13_token_alignment") == sorted(expected([d[:2] for d in docs]), key=str)


def test_pipeline(spark, docs):
    """Each stage on what the one before kept, against plain Python."""
    columns = "doc_id, text, lang, source, n_chars".split(", ")
    frames, now = [], spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        frames.append([tuple(r) for r in stage(spark, now, SF).collect()])
        if name != "token_output":
            now = spark.createDataFrame(frames[-1], now.schema)
            assert now.columns == columns
    clean, single, cleaned, mixed, tokens = frames

    assert set(clean) <= set(docs) and len(clean) < len(docs)
    toxic = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{SF}/labels.parquet'").fetchall())
    assert sum(toxic.get(d[0]) == 0 for d in clean) >= 0.95 * sum(y == 0 for y in toxic.values())
    assert sum(toxic.get(d[0]) == 1 for d in clean) <= 0.4 * sum(toxic.values())

    clean.sort()
    stay = set(kept([d[:2] for d in clean]))
    assert sorted(single) == [d for d in clean if d[0] in stay]

    items = [item_words(t) for (t,) in duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]
    windows = {tuple(w[i: i + 10]) for w in items for i in range(len(w) - 9)}
    want = []
    for d in single:
        raw = d[1].encode()
        spans = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(decontaminate.KEEP))]
        w = item_words(d[1])
        hit = [False] * len(w)
        for i in range(len(w) - 9):
            if tuple(w[i: i + 10]) in windows:
                hit[i: i + 10] = [True] * 10
        if sum(hit) > 0.5 * len(w):
            continue
        for i in range(len(w) - 1, -1, -1):
            if hit[i] and i + 1 < len(w) and hit[i + 1]:
                spans[i] = (spans[i][0], spans.pop(i + 1)[1])
                hit.pop(i + 1)
        for (a, b), h in list(zip(spans, hit))[::-1]:
            raw = raw[:a] + raw[b:] if h else raw
        text = raw.decode()
        want.append((d[0], text, d[2], d[3], d[4] if text == d[1] else len(text)))
    assert sorted(cleaned) == sorted(want)

    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", d[1])) for d in cleaned}
    per = {s: sum(n for d, n in size.items() if d[3] == s) for s in {d[3] for d in cleaned}}
    target = targets(per)
    want = []
    for d in cleaned:
        rate = target[d[3]] / per[d[3]] if per[d[3]] else 0
        draw = int(hashlib.md5(f"42:{d[0]}".encode()).hexdigest()[:13], 16) / 2**52
        want += [d] * (math.floor(rate) + (draw < rate - math.floor(rate)))
    assert sorted(mixed) == sorted(want)

    tokenizer, start, want = Tokenizer.from_file(tokenizer_file()), 0, []
    for d in sorted(mixed):
        ids = [*tokenizer.encode(d[1], add_special_tokens=False).ids, 2]
        want.append((d[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tokens, key=lambda r: r[1]) == want
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(tokens)
