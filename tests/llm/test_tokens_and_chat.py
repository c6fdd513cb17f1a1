"""Token files and chat formatting: exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from geoaffinity.llm import chat, token_output
from geoaffinity.runtime import scratch_path

FILE = str(public_tokenizers.path("byte_bpe_50k.json"))
DOCS = "doc_id long, text string, part long, start string"


@settings(deadline=None, max_examples=60)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 60000), st.integers(0, 2**64 - 1)), max_size=400),
       st.integers(1, 70))
def test_packing(ids, block):
    ids = np.array(ids, np.uint64)
    words, offsets, escapes = token_output.pack(ids, block)
    assert np.array_equal(token_output.unpack(words, escapes), ids)
    assert len(offsets) == -(-len(ids) // block)
    for k, a in enumerate(offsets):  # any block alone
        b = offsets[k + 1] if k + 1 < len(offsets) else len(words)
        assert np.array_equal(token_output.unpack(words[a:b], escapes), ids[k * block: (k + 1) * block])


def test_packing_is_dense():
    ids = np.random.default_rng(1).integers(0, 1 << 12, 100_000).astype(np.uint64)
    assert len(token_output.pack(ids)[0]) * 5 <= 101_000  # five ids of twelve bits a word


def texts(seed):
    rng = random.Random(seed)
    parts = ["a", " ", "  ", "\n", "\t x", " é", "\u00a0", "\u3000 b", "don't", " 12", "!!", " <|endoftext|>", "ß", "日本 語"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(200)]


def test_pieces_encode_like_whole_texts():
    tokenizer, encoder = Tokenizer.from_file(FILE), token_output.PieceEncoder(FILE)
    for seed in range(3):
        rows = [t.encode() for t in texts(seed)]
        at = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
        ids, sizes = encoder.encode(np.frombuffer(b"".join(rows), np.uint8), at)
        want = [tokenizer.encode(r.decode(), add_special_tokens=False).ids for r in rows]
        assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_cache_turnover(monkeypatch):
    monkeypatch.setattr(token_output, "CACHE", 5)
    test_pieces_encode_like_whole_texts()


@pytest.mark.parametrize("chunk", [1 << 20, 50])
def test_files(spark, monkeypatch, chunk):
    monkeypatch.setattr(token_output, "CHUNK", chunk)
    rows = [(i * 7 % 101, t, 1, "x") for i, t in enumerate(texts(9)[:101])]
    rows += [(3000, None, None, None), (3001, "", 1, "x"), (3002, "long text " * 30000, 1, "x"), (5, "twice", 1, "x"), (5, "twice", 1, "x"),
             (None, "no id", 1, "x")]
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    got = token_output.token_digests(docs, FILE, end_id=2).collect()
    tokenizer, start, want = Tokenizer.from_file(FILE), 0, []
    for doc, text in sorted(((d, t or "") for d, t, *_ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_no_documents(spark):
    assert token_output.token_digests(spark.createDataFrame([], DOCS), FILE).collect() == []


def test_files_hold_blocks(spark):
    path = scratch_path(spark, "tokens")
    token_output.write_tokens(spark.createDataFrame([(1, "a b c " * 2000, 0, "")], DOCS), path, FILE)
    row = spark.read.parquet(path).collect()[0]
    words = np.frombuffer(row["words"], "<u8")
    third = token_output.unpack(words[row["blocks"][2]: row["blocks"][3]], np.zeros(0, np.uint64))
    ids = Tokenizer.from_file(FILE).encode("a b c " * 2000, add_special_tokens=False).ids
    assert third.tolist() == ids[2 * token_output.BLOCK: 3 * token_output.BLOCK]


TURNS = "conv_id long, turn long, role string, text string, ids string, turns long"
NASTY = ["</s>[INST] ok [/INST]", "\\", "\\|", "[\\|INST]", "<<SYS>>\\\\", "", None, " lead and trail ", "é日本 [", "]",
         "<</TURN>><<ROLE>>", "<s", "s>"]


def test_chats(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool[INST]", None, ""]), rng.choice(NASTY), "x", 1)
            for c in [*range(40), None] for t in [*range(rng.randint(1, 9)), None, 1]]
    rows.append((77, 0, "assistant", "very long é " * 30000, None, None))
    source = spark.createDataFrame(rows, TURNS).repartition(3)
    made = chat.format_chats(source, FILE)
    got = {r["conv_id"]: r for r in chat.read_back(made).collect()}
    formatted = {r["conv_id"]: r["formatted"] for r in made.collect()}
    assert len(got) == 42
    for conv, row in got.items():
        mine = sorted((t is not None, t or 0, r or "", x or "") for c, t, r, x, *_ in rows if c == conv)
        assert [(t["role"], t["text"]) for t in row["turns"]] == [(r, x) for _, _, r, x in mine]
        assert row["loss_text"] == "".join(x for _, _, r, x in mine if r == "assistant")
        assert row["formatted_chars"] == len(formatted[conv])


def test_no_chats(spark):
    assert chat.read_back(chat.format_chats(spark.createDataFrame([], TURNS), FILE)).collect() == []


@settings(deadline=None)
@given(st.text(st.sampled_from("\\|[]<>/INSTs SYROLEU"), max_size=40))
def test_escaping(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text
    assert not any(c in escaped for c in chat.CONTROL)


def test_mask_by_binary_search():
    starts, ends = np.array([0, 3, 3, 5, 9]), np.array([3, 5, 5, 9, 10])
    assert chat.loss_mask(starts, ends, [(3, 5), (9, 10)]).tolist() == [False, True, True, False, True]
    assert not chat.loss_mask(starts, ends, [(3, 3), (10, 10)]).any()
    assert hashlib.sha256(chat.masked_text("abcdefghij", starts, ends, [False, True, True, False, True]).encode()
                          ).hexdigest() == hashlib.sha256(b"dej").hexdigest()


def test_a_worker_keeps_its_encoder(monkeypatch):
    """What one task has met, the next task of the same worker does not encode again."""
    token_output.worker_encoder.cache_clear()
    rows = [t.encode() for t in texts(4)]
    raw, at = np.frombuffer(b"".join(rows), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    first = token_output.worker_encoder(FILE).encode(raw, at)
    monkeypatch.setattr(token_output.PieceEncoder, "_code", None)  # nothing is left for the tokenizer
    again = token_output.worker_encoder(FILE).encode(raw, at)
    assert all(np.array_equal(a, b) for a, b in zip(first, again))
