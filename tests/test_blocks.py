"""Training on packed blocks: the same steps as training by joins, the same bits in any partitioning."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoaffinity.operators import blocks, factor, pairwise as pairwise_sums
from geoaffinity.runtime import cut

OPTIONS = factor.FitOptions(rank=3, max_iter=3)


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(5)
    rows = [(f, int(u), int(d) * 7 + 1, int(rng.integers(2)), float(rng.integers(1, 4)) / 2)
            for f in (0, 1) for u in range(30) for d in rng.choice(25, rng.integers(2, 20), replace=False)]
    both = {(f, u) for f, u, _, x, _ in rows if x} & {(f, u) for f, u, _, x, _ in rows if not x}
    return cut(spark.createDataFrame([r for r in rows if r[:2] in both], "fold int, u long, d long, x int, w double"))


@pytest.fixture(scope="module")
def edges(spark):
    return cut(spark.createDataFrame([(a, (a * 7 + k) % 40, 0.5 / k) for a in range(35) for k in (1, 2)],
                                     "src long, dst long, score double"))


def arrays(model):
    return {(r.fold, r.u): np.array(r.f) for r in model.users.collect()} | {
        (r.fold, "d", r.d): np.array(r.f) for r in model.items.collect()}


def close(a, b):
    a, b = arrays(a), arrays(b)
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k], atol=1e-9) for k in a)


@pytest.mark.parametrize("kind", ["plain", "weighted", "pairwise", "graph"])
def test_as_by_joins(samples, edges, kind):
    rows = samples if kind == "weighted" else samples.drop("w")
    train, valid = rows.where("pmod(u + d, 5) > 0"), rows.where("pmod(u + d, 5) = 0")
    given = {"pairwise": kind == "pairwise", "edges": edges if kind == "graph" else None, "watch": valid}
    got, want = factor.fit(train, OPTIONS, **given), factor.fit_joined(train, OPTIONS, **given)
    if kind == "pairwise":  # joins drop vectors that take part in no comparison
        ids = want.users.select("fold", "u"), want.items.select("fold", "d")
        got = factor.FactorModel(got.users.join(ids[0], ["fold", "u"]), got.items.join(ids[1], ["fold", "d"]), got.history)
    close(got, want)
    for a, b in zip(got.history, want.history):
        assert a == pytest.approx(b, abs=1e-9)


@pytest.mark.parametrize("pairwise", [False, True])
def test_partitioning_changes_no_bit(samples, monkeypatch, pairwise):
    models = [factor.fit(samples.repartition(n, "d"), OPTIONS, pairwise=pairwise) for n in (1, 7)]
    a, b = map(arrays, models)
    assert all((a[k] == b[k]).all() for k in a) and models[0].history == models[1].history


@pytest.mark.parametrize("pairwise", [False, True])
def test_small_blocks(samples, edges, monkeypatch, pairwise):
    """Users in several blocks, blocks in several cells, comparisons and samples in several slabs."""
    whole = factor.fit(samples, OPTIONS, pairwise=pairwise, edges=edges)
    pack = blocks.pack
    monkeypatch.setattr(factor.blocks, "pack", lambda *a, **k: pack(*a, **k, cell=16, block=8))
    monkeypatch.setattr(blocks, "SHARED", 0)
    close(whole, factor.fit(samples, OPTIONS, pairwise=pairwise, edges=edges))


@pytest.mark.parametrize("sent", [1 << 15, 2])
def test_friends_of_many_blocks(samples, edges, monkeypatch, sent):
    """More blocks of users than meet block against block: vectors are sent along the edges, nothing is trained by joins."""
    want = factor.fit_joined(samples, OPTIONS, edges)
    pack = blocks.pack
    monkeypatch.setattr(factor.blocks, "pack", lambda *a, **k: pack(*a, **k, cell=16, block=3))
    monkeypatch.setattr(blocks, "GRID", 2)
    monkeypatch.setattr(blocks, "EDGES", sent, raising=False)
    monkeypatch.setattr(factor, "fit_joined", None)
    got = factor.fit(samples, OPTIONS, edges=edges)
    close(got, want)
    none = edges.selectExpr("src", "cast(null as long) as dst", "score")
    close(factor.fit(samples, OPTIONS, edges=edges.unionByName(none).unionByName(none.selectExpr("dst as src", "src as dst", "score"))), want)


def test_products_of_short_and_long_runs():
    """Sums by run and by item against plain products, on both sides of the limit for runs."""
    rng = np.random.default_rng(11)
    for size in (3, blocks.LONG):
        e, table, row = rng.normal(size=6 * size), rng.normal(size=(9, 4)), rng.integers(0, 9, 6 * size)
        start, item = np.arange(0, 6 * size, size), rng.integers(0, 5, 6 * size)
        assert np.allclose(blocks.run_products(e, table, row, start), [e[a: a + size] @ table[row[a: a + size]] for a in start])
        assert np.allclose(blocks.item_products(e, table, row, item, 7), [e[item == d] @ table[row[item == d]] for d in range(7)])


def test_a_catalogue_too_large_is_trained_by_joins(samples, monkeypatch):
    whole = factor.fit(samples, OPTIONS)
    monkeypatch.setattr(blocks, "ITEMS", 5)
    assert blocks.catalogue(samples) is None
    close(whole, factor.fit(samples, OPTIONS))


def test_kernels():
    """Slopes and losses of a cell against plain loops, in small slabs and with large scores."""
    rng = np.random.default_rng(3)
    cell = object.__new__(blocks.Cell)
    cell.sizes = np.array([5, 2, 6])
    cell.off, cell.used = np.append(0, np.cumsum(cell.sizes)), np.array([2, 1, 3])
    pairs = [(o + i, o + j) for o, n, s in zip(cell.off, cell.used, cell.sizes) for i in range(n) for j in range(n, s)]
    for size, spread in ((4, 1.0), (1 << 18, 1.0), (4, 300.0)):
        pairwise_sums.PAIRS, kept = size, pairwise_sums.PAIRS
        z = rng.normal(size=13) * spread
        e, n, own = blocks.rank_slopes(cell, z)
        want, many = np.zeros(13), np.zeros(13)
        for i, j in pairs:
            s = 1 / (1 + np.exp(z[j] - z[i])) - 1
            want[i] += s
            want[j] -= s
            many[[i, j]] += 1
        assert np.allclose(e, want) and (n == many).all() and own.tolist() == [6, 1, 9]
        count, (loss,) = blocks.rank_losses(cell, [z])
        assert count == len(pairs) and loss == pytest.approx(sum(np.logaddexp(0, z[j] - z[i]) for i, j in pairs))
        pairwise_sums.PAIRS = kept


def test_one_job_more_when_no_width_will_do(samples):
    """A start at a minimum: no width helps and training ends."""
    flat = samples.withColumn("w", F.lit(0.0))
    model = factor.fit(flat, factor.FitOptions(rank=3, lp=0.0, lq=0.0, max_iter=3))
    assert [h["step"] for h in model.history] == [0, 0]
