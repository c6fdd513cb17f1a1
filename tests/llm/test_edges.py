"""Names that clash with the operators' own, repeated ids, and words built to collide."""

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from geoaffinity.llm import ngram_join, shingle_copies, substring_dedup, token_output, toxicity
from geoaffinity.llm.queries import tokenizer_file
from geoaffinity.llm.text import SpanHash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text string, _score double, _text_key long, _row string"


def regular(n=1024):
    """A Thue-Morse word and its complement: every polynomial hash modulo 2**64 with an odd base is the same for both."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_the_words_collide():
    raw = np.frombuffer("".join(regular()).encode(), np.uint8)
    h = SpanHash(3).bytes(raw, np.array([0, 1024]), np.array([1024, 2048]))
    assert h[0] == h[1]


def test_long_regular_words_are_not_repeats(spark):
    one, other = regular()
    rows = [(i, " ".join(f"w{k}" if k % 5 else word for k in range(25))) for i, word in enumerate((one, other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring_dedup.dedup_passages(docs, finish=substring_dedup.digest, finished=substring_dedup.DIGEST)
    assert sorted((r["doc_id"], r["n_removed"]) for r in got.collect()) == [(0, 0), (1, 0)]


@pytest.mark.parametrize("around", ["", "prefix12"])
def test_long_regular_pieces_keep_their_ids(around):
    words = [around + w + around for w in regular()]
    text = " ".join(words * 2)
    encoder, plain = token_output.PieceEncoder(tokenizer_file()), Tokenizer.from_file(tokenizer_file())
    raw = np.frombuffer(text.encode(), np.uint8)
    ids, sizes = encoder.encode(raw, np.array([0, len(raw)]))
    assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids and sizes.tolist() == [len(ids)]


@pytest.fixture(scope="module")
def clashing(spark):
    word = " ".join(f"word{i}" for i in range(60))
    rows = [(1, word, "a", "s", 1, "x", 0.1, 5, "r"), (2, word + " more", "a", "s", 1, None, None, None, None),
            (None, word, None, None, None, "x", 0.2, 5, "r"), (3, None, "a", "s", 1, "y", 0.3, 6, "q"),
            (3, None, "a", "s", 1, "y", 0.3, 6, "q"), (4, "", "b", "s", 1, "y", 0.3, 6, "q"), (5, "other words here", "b", None, 1, "", 0.0, 0, "")]
    return spark.createDataFrame(rows, SCHEMA)


def test_names_of_columns(spark, clashing):
    model = toxicity.train([b"good day", b"bad day"], np.array([0, 1]))
    assert toxicity.below(clashing, model, 2.0).columns == clashing.columns
    kept = sorted(map(str, toxicity.below(clashing, model, 2.0).collect()))
    assert kept == sorted(map(str, clashing.collect()))
    scored = toxicity.score(clashing, model)
    assert scored.columns == [c for c in clashing.columns if c != "_score"] + ["_score"] and scored.count() == 7
    one = shingle_copies.one_per_group(clashing).collect()
    assert sorted((r["doc_id"], r["_text_key"]) for r in one) == [(1, 5), (3, 6), (5, 0)]
    assert sorted(map(str, ngram_join.near_copies(clashing).collect())) == sorted(map(str, [
        r for r in ngram_join.near_copies(clashing.select("doc_id", "text")).collect()]))


def test_stages_keep_columns(spark, clashing, tmp_path):
    for name, rows in (("labels", [(1, 0, 0), (2, 0, 1)]), ("benchmark", [(1, "one two three four five six seven eight nine ten")])):
        schema = "doc_id long, quality int, toxic int" if name == "labels" else "item_id long, text string"
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    for docs in (clashing, clashing.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, str(tmp_path)).columns == docs.columns
            stage(spark, docs, str(tmp_path)).collect()
        corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()


def test_labels_of_repeated_ids(spark):
    """Which of two texts of an id is learned from does not depend on partitioning."""
    docs = [(i % 40, f"text {i} {'bad' if i % 2 else 'good'} words") for i in range(80)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    one = [sorted(map(tuple, toxicity.score(frame, toxicity.fit(frame.repartition(n), labels)).collect())) for n in (1, 6)]
    assert one[0] == one[1]
