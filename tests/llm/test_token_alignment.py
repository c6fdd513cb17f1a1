"""Token alignment against plain loops over both tokenizers."""

import hashlib
import random
import sys
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from geoaffinity.llm import token_alignment
from geoaffinity.llm.queries import tokenizer_file

A, B = tokenizer_file(), tokenizer_file("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, pair long, n long, row string, a binary"


def plain(texts):
    """Per text: a ids, b ids, groups, links."""
    one, two = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    one.encode_special_tokens = True
    vocab = {i: t for t, i in one.get_vocab().items()}
    byte = token_alignment.byte_alphabet()
    for text in texts:
        want = (" " + (text or "")).encode()
        a = one.encode(" " + text, add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        ra = [bytes(byte[c] for c in vocab[i]) for i in a]
        rb = [bytes([int(p[3:-1], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode()
              for i in b for p in [two.id_to_piece(i)]]
        if b"".join(ra) != want or b"".join(rb) != want:
            yield [], [], [], []
            continue
        ea, eb = ([0], [0])
        for r in ra:
            ea.append(ea[-1] + len(r))
        for r in rb:
            eb.append(eb[-1] + len(r))
        groups, x, y = [], 0, 0
        for end in sorted(set(ea[1:]) & set(eb[1:])):
            i, j = ea.index(end), eb.index(end)
            groups.append((a[x:i], b[y:j]))
            x, y = i, j
        links = [(p, q) for i, p in enumerate(a) for j, q in enumerate(b)
                 if max(ea[i], eb[j]) < min(ea[i + 1], eb[j + 1])]
        yield a, b, groups, links


def expected(rows):
    found = list(plain([t for _, t in rows]))
    count = Counter(link for *_, links in found for link in links)
    best = Counter()
    for (_, q), n in count.items():
        best[q] = max(best[q], n)
    for (d, _), (a, b, groups, links) in zip(rows, found):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        yield (d, len(a), len(b), len(groups), len(links), sum(count[x] == best[x[1]] for x in links),
               sum(count[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if text else "")


TEXTS = ["", None, " ", "\n", "a", "A plain line.", "A plain line.", "two  spaces\tand\n\nlines ", "▁ is its own sign",
         "<0x41> <s> </s> <unk> <|endoftext|>", "naïve façade 数字 😀👩‍👩‍👧 ü", "ﬁ ligature Ⅷ １２３    ", "\u0000\u0001 end",
         "x" * 300, "  leading", "don't we'll I'VE", "\r\n\r\n", "ａｂｃ", "é ‍﻿"]


@pytest.mark.parametrize("shard", [token_alignment.SHARD, 97])
def test_against_loops(spark, shard):
    rng = random.Random(shard)
    chars = "abc éß数😀 \n\t.,'0"
    texts = TEXTS + ["".join(rng.choices(chars, k=rng.randrange(80))) for _ in range(60)]
    rows = [(i // 2 if i % 9 else None, t) for i, t in enumerate(texts)]  # repeated and null ids
    docs = spark.createDataFrame([(*r, 1, 2, "x", None) for r in rows], SCHEMA)
    got = token_alignment.aligned(docs, A, B, shard=shard)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected(rows), key=str)


def test_long_texts(spark):
    """Runs of spaces that one library gives up on, and long texts with and without spaces."""
    one, blank = token_alignment.ByteBpe(A), token_alignment.BLANK
    for n in (blank - 1, blank, 30 * blank):
        text = "a" + " " * n + "x"
        assert one.encode(text) == one.slow.encode(text, add_special_tokens=False).ids
    rows = [(1, " " * 2 * blank + "x"), (2, "word and " * 300_000), (3, "ab" * 200_000), (4, "\n" * 100_000)]
    docs = spark.createDataFrame([(*r, 1, 2, "x", None) for r in rows], SCHEMA)
    got = {r["doc_id"]: r for r in token_alignment.aligned(docs, A, B).collect()}
    for d, text in rows:
        assert got[d]["n_a"] == len(one.encode(" " + text)) and got[d]["n_groups"] > 0


def test_windows_are_forgotten(spark):
    """A memory of windows that is often full gives the same rows."""
    rows = [(i, f"{t} number{i} of many words {i * i}") for i, t in enumerate(TEXTS * 4)]
    docs = spark.createDataFrame([(*r, 1, 2, "x", None) for r in rows], SCHEMA)
    got = token_alignment.aligned(docs, A, B, remembered=3)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected(rows), key=str)


def test_no_documents(spark):
    for texts in ([], [(1, None)], [(1, "")]):
        docs = spark.createDataFrame([(*r, 1, 2, "x", None) for r in texts], SCHEMA)
        assert [tuple(r) for r in token_alignment.aligned(docs, A, B).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")] * len(texts)


def test_every_character():
    """Both libraries split words at the same characters."""
    one = token_alignment.ByteBpe(A)
    for first in range(0, sys.maxunicode + 1, 4096):
        text = "".join(f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}\n" for c in range(first, first + 4096)
                       if not 0xD800 <= c < 0xE000)
        assert one.encode(text) == one.slow.encode(text, add_special_tokens=False).ids, hex(first)
