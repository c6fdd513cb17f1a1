"""What joins and groups carry, read from their plans."""

import re

import pytest
from pyspark.sql import functions as F

from geoaffinity.operators import factor, geograph, sampling, splits
from geoaffinity.runtime import spread

LIMIT = "spark.sql.autoBroadcastJoinThreshold"


@pytest.fixture
def plan(spark, capsys):
    """The plan of a table under a limit for broadcasts."""
    old = spark.conf.get(LIMIT)

    def text(df, limit):
        spark.conf.set(LIMIT, limit)
        capsys.readouterr()
        df.explain()
        return capsys.readouterr().out

    yield text
    spark.conf.set(LIMIT, old)


def test_samples_meet_users_before_items(spark, plan):
    def vectors(n, key):
        return spark.range(n).select(F.lit(0).alias("fold"), F.col("id").alias(key), F.array(F.lit(0.5), F.lit(2.0)).alias("f"))

    samples = spark.range(100_000).select(F.lit(0).alias("fold"), F.col("id").alias("u"), (F.col("id") % 7).alias("d"), F.lit(1).alias("x"))
    scores = factor.predict_scores(samples, vectors(90_000, "u"), vectors(5, "d"), 2)
    text = plan(scores, "10k")
    assert text.index("BroadcastHashJoin") < text.index("SortMergeJoin")  # outermost first: samples are shuffled without q
    assert scores.count() == sum(1 for u in range(90_000) if u % 7 < 5)
    assert {r.z for r in scores.select("z").distinct().collect()} == {4.25}


def test_split_does_not_shuffle_folds_of_users_together(spark, plan):
    rows = [(u, d) for u in range(40) for d in range(1 + u % 5)] + [(None, 1), (None, 2)]
    users = spread(spark.createDataFrame(rows, "u long, d long"), "u")
    data = splits.with_folds(users, 3)
    split = splits.stratified_split(data)
    assert not re.search(r"hashpartitioning\(fold#\d+L?, u#", plan(split, "-1"))
    got = split.collect()
    assert len(got) == 3 * (len(rows) - 2) and all(r.part == "train" for r in got if r.u % 5 == 0)
    # The two rows without a user are counted: 0.2 N / N1 with N1 = N - 8 users of one row.
    share = len(rows) * 0.2 / (len(rows) - 8)
    draw = spark.createDataFrame(got).withColumn("draw", splits.hash_uniform(F.col("fold") + splits.SEED, F.col("u"), F.col("d")))
    assert all((r.part == "valid") == (r.draw < share) for r in draw.collect() if r.u % 5)


def test_overlap_does_not_multiply_edges(spark, plan):
    edges = spark.createDataFrame([(1, 2, 1), (1, 3, 2), (1, 3, 3), (2, 1, 1), (3, 9, 1), (9, 3, 1)], "src long, dst long, rank int")
    used = spark.createDataFrame([(1, 1), (1, 2), (1, None), (2, 2), (3, 1), (3, 2), (3, None)], "u long, d long")
    ratio = geograph.edge_overlap(edges, used, "ratio")
    assert not re.search(r"hashpartitioning\([^)]*\bd#", plan(ratio, "-1"))  # no row for each device of each edge
    got = {(r.src, r.dst, r["rank"]): r.cover for r in ratio.collect()}
    assert got == {(1, 2, 1): 1 / 3, (1, 3, 2): 4 / 3, (1, 3, 3): 4 / 3, (2, 1, 1): 1.0}  # a null device is shared with none
    any_ = {(r.src, r.dst): r.cover for r in geograph.edge_overlap(edges, used).collect()}
    assert any_ == {(1, 2): 1.0, (1, 3): 1.0, (2, 1): 1.0}


def test_tasks_of_triples_follow_the_samples(spark, monkeypatch):
    monkeypatch.setattr(sampling, "TASK", 10, raising=False)
    samples = spark.createDataFrame([(0, u, d, d % 2) for u in range(50) for d in range(8)], "fold int, u long, d long, x int")
    counts = sampling.rank_sample_counts(samples)
    assert counts.rdd.getNumPartitions() == 40
    assert {tuple(r) for r in counts.collect()} == {(0, u, d, 4, 12) for u in range(50) for d in (1, 3, 5, 7)}
