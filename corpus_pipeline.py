"""From raw documents to token files, in stages that each keep, change or repeat documents.

Every stage reads all that the one before kept; between two stages the documents are a table in the
shared folder, so a lost executor repeats tasks of one stage at most. No stage minds further columns, whatever their names,
or an empty table; a text has to fit into a task.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from geoaffinity.llm import decontaminate, mixing, shingle_copies, simhash, token_output, toxicity
from geoaffinity.llm.queries import table, tokenizer_file
from geoaffinity.runtime import cut, discard

BATCH = "1000"  # rows that a Python worker and the JVM hold at a time: texts are long


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; the model learns from labelled ones among ``docs``. Null text is empty
    and scored like any other; repeated rows and null ids stay or go each by its own text."""
    _small_batches(spark)
    return toxicity.below(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies by fingerprint (two bits), then one of each group that is left with a
    five-word Jaccard of 0.8 or more: the one with the smallest id; a null id comes last, of repeated rows one stays.
    Documents without words, null text too, are copies of each other."""
    _small_batches(spark)
    some = cut(simhash.one_per_group(docs))
    found = shingle_copies.near_copies(some)
    discard(some)
    # The rows are read from ``docs`` again, as often as they stand there, so that no copy of all texts is left behind.
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"))
    again = rows.join(found, rows["doc_id"].eqNullSafe(found["doc_id"]) & (rows["text_key"] == found["text_key"])).select(
        rows["doc_id"], rows["text_key"], "root")
    return simhash.first_rows(docs, again, "doc_id", "text")


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that are mostly benchmark go. Null text has no passages."""
    _small_batches(spark)
    return decontaminate.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks, none to three times. Documents without a source are one
    source; null text has size 0; rows that share an id share their draw."""
    return mixing.mixed_rows(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in ascending id order (null first); returns what reading them back gives per row. Null text
    is the end id alone."""
    _small_batches(spark)
    return token_output.token_digests(docs, tokenizer_file(), end_id=2)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", cut_benchmark),
    ("source_mix", mix_sources),
    ("token_output", write_tokens),
]

#: Two stages are a trained model and a search that SQL cannot express; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
