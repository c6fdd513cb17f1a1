"""Gradients, line search and training on a small sample table."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoaffinity.operators import factor
from geoaffinity.runtime import cut

RANK = 3
ROWS = [(0, u, d, (u * 3 + d * 5) % 3 % 2) for u in range(5) for d in range(5)]
OPTIONS = factor.FitOptions(rank=RANK, lp=0.0, lq=0.0, max_iter=4)


@pytest.fixture(scope="module")
def samples(spark):
    return cut(spark.createDataFrame(ROWS, "fold int, u long, d long, x int"))


@pytest.fixture(scope="module")
def start(samples):
    return cut(factor.factor_init(samples, "u", RANK)), cut(factor.factor_init(samples, "d", RANK))


def arrays(users, items, cols=("f", "f")):
    return ({r.u: np.array(r[cols[0]]) for r in users.collect()},
            {r.d: np.array(r[cols[1]]) for r in items.collect()})


def point_loss(p, q):
    return sum(math.log1p(math.exp(p[u] @ q[d])) - x * (p[u] @ q[d]) for _, u, d, x in ROWS)


def rank_loss(p, q):
    total = 0.0
    for _, u, i, x in ROWS:
        for _, v, j, y in ROWS:
            if u == v and x == 1 and y == 0:
                total += math.log1p(math.exp(p[u] @ q[j] - p[u] @ q[i]))
    return total


@pytest.mark.parametrize("pairwise,loss", [(False, point_loss), (True, rank_loss)])
def test_gradient_is_the_derivative(samples, start, pairwise, loss):
    ug, ig = factor.step_gradients(samples, *start, OPTIONS, pairwise=pairwise)
    p, q = arrays(*start)
    g, h = arrays(ug, ig, ("g", "h"))
    for table, grad in ((p, g), (q, h)):
        for key in grad:
            for i in range(RANK):
                table[key][i] += 1e-6
                up = loss(p, q)
                table[key][i] -= 2e-6
                down = loss(p, q)
                table[key][i] += 1e-6
                assert grad[key][i] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def test_initial_vectors_have_length_one(start):
    for table in arrays(*start):
        assert all(np.linalg.norm(v) == pytest.approx(1.0) for v in table.values())


@pytest.mark.parametrize("pairwise,loss", [(False, point_loss), (True, rank_loss)])
def test_line_search_loss_is_the_loss_there(samples, start, pairwise, loss):
    step = factor.one_step(samples, *start, OPTIONS, pairwise=pairwise)
    report = step.report[0]
    p, q = arrays(step.users, step.items)
    p0, q0 = arrays(*start)
    n = len(ROWS) if not pairwise else sum(
        1 for _, u, i, x in ROWS for _, v, j, y in ROWS if u == v and x == 1 and y == 0)
    assert report["loss"] == pytest.approx(loss(p0, q0) / n)
    assert report["loss_after"] == pytest.approx(loss(p, q) / n)
    assert report["loss_after"] <= report["loss"] - report["width"] * report["slope"]


def test_loss_never_rises(samples):
    for pairwise in (False, True):
        model = factor.fit(samples, OPTIONS, pairwise=pairwise)
        losses = [h["loss"] for h in model.history] + [model.history[-1]["loss_after"]]
        assert len(model.history) == 4 and losses == sorted(losses, reverse=True)


def same(a, b):
    for x, y in zip(arrays(a.users, a.items), arrays(b.users, b.items)):
        assert x.keys() == y.keys()
        assert all(np.allclose(x[k], y[k], atol=1e-12) for k in x)


def test_graph_weight_zero_and_unit_weights_change_nothing(spark, samples):
    edges = spark.createDataFrame([(0, 1, 0.6), (0, 2, 0.4), (3, 0, 1.0)],
                                  "src long, dst long, score double")
    plain = factor.fit(samples, OPTIONS)
    off = factor.FitOptions(rank=RANK, lp=0.0, lq=0.0, lg=0.0, max_iter=4)
    same(plain, factor.fit(samples, off, edges=edges))
    same(plain, factor.fit(samples.withColumn("w", F.lit(1.0)), OPTIONS))


def test_graph_term(spark, start):
    edges = spark.createDataFrame([(0, 1, 0.6), (0, 99, 0.4)], "src long, dst long, score double")
    p, _ = arrays(*start)
    row = factor.graph_term(edges, start[0], RANK).collect()
    assert [r.u for r in row] == [0]
    assert np.allclose(row[0].m, (0.6 - p[0] @ p[1]) * p[1])


def test_folds_do_not_mix(spark, samples):
    two = samples.unionByName(samples.withColumn("fold", F.lit(1)).where("u < 4"))
    alone, both = factor.fit(samples, OPTIONS), factor.fit(two, OPTIONS)
    only = factor.FactorModel(both.users.where("fold = 0"), both.items.where("fold = 0"))
    same(alone, only)


def test_popularity_weight(spark):
    data = spark.createDataFrame([(0, 1, 1), (0, 2, 1), (0, 3, 1), (0, 1, 2)],
                                 "fold int, u long, d long")
    got = {r.d: r.w for r in factor.popularity_weight(data, 2.0, 0.5).collect()}
    assert got == pytest.approx({1: 2 * (3 / 4) ** 0.5, 2: 2 * (1 / 4) ** 0.5})
