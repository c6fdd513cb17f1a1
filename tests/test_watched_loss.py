"""Models trained by the programs report the loss of their valid part."""

import pytest

from geoaffinity.operators import factor
from geoaffinity.plans import programs


@pytest.mark.parametrize("pairwise", [False, True])
def test_valid_part_is_watched(spark, monkeypatch, pairwise):
    rows = [(0, u, d, (u + d) % 2, "valid" if d > 5 else "train") for u in range(6) for d in range(8)]
    split = spark.createDataFrame(rows, "fold int, u long, d long, x int, part string")
    monkeypatch.setattr(programs, "labelled_samples", lambda *a: split)
    monkeypatch.setattr(programs, "_metrics", lambda *a: None)
    seen = []
    fit = factor.fit
    monkeypatch.setattr(programs.factor, "fit", lambda samples, options, **kind: seen.append(kind) or factor.FactorModel(None, None))
    options = factor.FitOptions(rank=2, max_iter=1)
    (programs.ranking_model if pairwise else programs.logistic_model)(None, options)
    watch = seen[0]["watch"]
    assert watch.columns == ["fold", "u", "d", "x"] and watch.count() == 12
    known = spark.createDataFrame([(0, u, d, (u + d) % 2) for u in range(6) for d in range(8)], "fold int, u long, d long, x int")
    history = fit(known, options, pairwise=pairwise, watch=watch).history
    assert [h["watched_loss"] > 0 for h in history] == [True]
