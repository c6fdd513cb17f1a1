"""Independent draws by geometric gaps."""

import statistics

import pytest
from pyspark.sql import functions as F

from geoaffinity.operators import sampling


@pytest.mark.parametrize("n,c,times", [(400, 20, 1), (400, 60, 3), (50, 1, 1)])
def test_counts_vary_like_independent_draws(spark, n, c, times):
    users = spark.range(3000).select(F.lit(0).alias("fold"), F.col("id").alias("u"), F.lit(c).cast("bigint").alias("c"))
    drawn = sampling.bernoulli_draws(users, n, times)
    many = {r["u"]: r["m"] for r in drawn.groupBy("u").agg(F.count_distinct("idx").alias("m")).collect()}
    counts = [many.get(u, 0) for u in range(3000)]
    p = times * c / (n - c)
    assert statistics.mean(counts) == pytest.approx(n * p, rel=0.1, abs=0.05)
    assert statistics.variance(counts) == pytest.approx(n * p * (1 - p), rel=0.12)
    places = [r["m"] for r in drawn.groupBy("idx").agg(F.count(F.lit(1)).alias("m")).collect()]
    assert len(places) == n and statistics.mean(places) == pytest.approx(3000 * p, rel=0.1)


def test_cut_and_certain_draws(spark):
    """Never more than asked for, first ones first; with few items left all are drawn."""
    rows = [(0, u, d) for u in range(40) for d in range(u % 9 + 1)]
    positives = spark.createDataFrame(rows, "fold int, u bigint, d bigint")
    items = spark.range(10).select(F.col("id").alias("d"))
    got = sampling.add_negatives(positives, items, 1, "bernoulli").where("x = 0").collect()
    of = {u: sorted(r["d"] for r in got if r["u"] == u) for u in range(40)}
    for u, drawn in of.items():
        c = u % 9 + 1
        assert len(drawn) <= c and all(d >= c for d in drawn)
        if c >= 5:
            assert drawn == list(range(c, 10))[:c]
    same = sampling.add_negatives(positives.repartition(7), items, 1, "bernoulli").where("x = 0").collect()
    assert sorted(map(tuple, same)) == sorted(map(tuple, got))
