"""Sampling, recommenders and metrics on small frames."""

import pytest
from pyspark.sql import functions as F

from geoaffinity.operators import evaluate, itemcf, sampling, splits

PAIRS = [(0, u, d) for u in range(12) for d in range(30) if (u * 7 + d * 3) % 5 < 1 + u % 3]


def frame(spark, rows=PAIRS):
    return spark.createDataFrame(rows, "fold int, u long, d long")


def items(spark, n=30):
    return spark.range(n).select(F.col("id").alias("d"))


@pytest.mark.parametrize("mode", ["exact", "bernoulli"])
@pytest.mark.parametrize("stride", [4096, 4])
def test_negatives(spark, monkeypatch, mode, stride):
    monkeypatch.setattr(sampling, "STRIDE", stride)
    used = {}
    for _, u, d in PAIRS:
        used.setdefault(u, set()).add(d)
    rows = sampling.add_negatives(frame(spark), items(spark), 2, mode).collect()
    negatives = {u: [r.d for r in rows if r.u == u and r.x == 0] for u in used}
    for u, ds in negatives.items():
        assert len(ds) == len(set(ds)) and not used[u] & set(ds)
        if mode == "exact":
            assert len(ds) == min(2 * len(used[u]), 30 - len(used[u]))
        else:
            assert len(ds) <= 2 * len(used[u])
    assert sum(r.x for r in rows) == len(PAIRS)


def test_negatives_do_not_depend_on_pieces(spark, monkeypatch):
    whole = sampling.add_negatives(frame(spark), items(spark), 2).collect()
    monkeypatch.setattr(sampling, "STRIDE", 3)
    pieces = sampling.add_negatives(frame(spark), items(spark), 2).collect()
    assert sorted(whole) == sorted(pieces)


def test_negatives_borders(spark):
    data = frame(spark, [(0, 1, 0), (0, 1, 20), (0, 2, 7)])
    sparse = spark.createDataFrame([(d,) for d in (0, 7, 20, 90)], "d long")
    assert sampling.add_negatives(data, sparse, 0).count() == 3
    every = sampling.add_negatives(data, sparse, -1).collect()
    assert {(r.u, r.d) for r in every if r.x == 0} == {(1, 7), (1, 90), (2, 0), (2, 20), (2, 90)}


def test_one_row_users_stay_in_train(spark):
    rows = PAIRS + [(0, 100 + u, 1) for u in range(50)]
    split = splits.stratified_split(frame(spark, rows)).collect()
    assert len(split) == len(rows) == len({(r.u, r.d) for r in split})
    assert {r.part for r in split if r.u >= 100} == {"train"}
    assert {r.part for r in split if r.u < 100} == {"train", "valid"}


def test_rank_lists_are_complete(spark):
    samples = sampling.add_negatives(frame(spark), items(spark), 1)
    want = {(a.u, a.d, b.d) for a in samples.collect() for b in samples.collect()
            if a.u == b.u and a.x == 1 and b.x == 0}
    for chunk in (256, 2):
        rows = sampling.rank_chunks(samples, chunk).select(
            "u", F.explode("pos.d").alias("i"), "neg").select("u", "i", F.explode("neg.d").alias("j"))
        got = [tuple(r) for r in rows.collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_pair_similarity_with_split_users(spark):
    def sim(chunk):
        return {(r.i, r.j): r.sim for r in itemcf.item_pair_sim(frame(spark), chunk).collect()}

    whole, split = sim(256), sim(2)
    assert whole.keys() == split.keys() and all(i != j for i, j in whole)
    assert all(abs(whole[k] - split[k]) < 1e-12 and whole[k] == whole[k[::-1]] for k in whole)


def test_popular_fill(spark):
    data = frame(spark, [(0, 1, 1), (0, 1, 2), (0, 2, 1), (0, 2, 2), (0, 2, 3), (0, 3, 9), (0, 4, 1)])
    rows = itemcf.itemcf_topn(data, n=3).orderBy("u", "rank").collect()
    lists = {}
    for r in rows:
        lists.setdefault(r.u, []).append(r.d)
    assert lists[1] == [3, 9]           # similar item first, then popular, nothing used
    assert lists[3] == [1, 2, 3]        # no similar items at all: popular only
    assert all(len(v) == len(set(v)) for v in lists.values())
    assert [r.rank for r in rows if r.u == 3] == [1, 2, 3]


def test_popular_fill_reads_down_the_order(spark):
    """A user has used 15 of the 20 most popular items; the list is full all the same."""
    popular = [(0, 100 + u, d) for d in range(30) for u in range(60 - d)]
    data = frame(spark, popular + [(0, 1, d) for d in range(15)])
    rows = itemcf.itemcf_topn(data, n=20, neighbors=1).where("u = 1").orderBy("rank").collect()
    assert [r.rank for r in rows] == list(range(1, 16)) and {r.d for r in rows} == set(range(15, 30))


def test_unused_counts(spark):
    data = frame(spark)
    used = {u: {r.d for r in data.where(F.col("u") == u).collect()} for u in (r.u for r in data.select("u").distinct().collect())}
    got = {r.u: (r.unused, r.unused_sum) for r in sampling.unused_counts(data, items(spark)).collect()}
    every = {r.d for r in items(spark).collect()}
    assert got == {u: (len(every - ds), sum(every - ds)) for u, ds in used.items()}


def test_scores_must_be_finite(spark):
    users = spark.createDataFrame([(0, 1, [float("nan"), 1.0])], "fold int, u long, f array<double>")
    things = spark.createDataFrame([(0, 1, [1.0, 1.0])], "fold int, d long, f array<double>")
    with pytest.raises(Exception, match="not finite"):
        evaluate.topn_by_factor(users, things, frame(spark).where("u = 1"), 2).collect()


def test_precision_recall(spark):
    truth = frame(spark, [(0, 1, 5), (0, 1, 6), (0, 2, 7), (0, 3, 8)])
    lists = spark.createDataFrame([(0, 1, 5, 1), (0, 1, 9, 2), (0, 2, 1, 1), (0, 2, 7, 2)],
                                  "fold int, u long, d long, rank int")
    got = {r.k: r for r in evaluate.precision_recall_at_k(truth, lists, 3).collect()}
    assert got[1].users == 2            # user 3 has no list
    assert got[1].precision == pytest.approx(0.5) and got[1].recall == pytest.approx(0.25)
    assert got[2].precision == pytest.approx(0.5) and got[2].recall == pytest.approx(0.75)
    assert got[3].precision == pytest.approx(1 / 3) and got[3].f1 == pytest.approx(
        2 * (1 / 3) * 0.75 / (1 / 3 + 0.75))


@pytest.mark.parametrize("block", [2048, 4])
def test_topn_blocks(spark, block):
    def vec(key):
        return F.array(F.sin(F.col(key) * 1.7), F.cos(F.col(key) * 0.9), F.sin(F.col(key) * 0.3))

    users = spark.range(10).select(F.lit(0).alias("fold"), F.col("id").alias("u"), vec("id").alias("f"))
    things = spark.range(25).select(F.lit(0).alias("fold"), F.col("id").alias("d"),
                                    vec("id").alias("f"))
    used = frame(spark).where("u < 10 and d < 25")
    gone = {(r.u, r.d) for r in used.collect()}
    p = {r.u: r.f for r in users.collect()}
    q = {r.d: r.f for r in things.collect()}
    got = {(r.u, r.rank): r.d
           for r in evaluate.topn_by_factor(users, things, used, 4, block).collect()}
    for u in p:
        best = sorted((-sum(a * b for a, b in zip(p[u], q[d])), d) for d in q if (u, d) not in gone)
        assert [got[(u, k + 1)] for k in range(4)] == [d for _, d in best[:4]]
