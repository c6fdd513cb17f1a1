"""The model queries train to the end, and their facts tell when a model is not trained."""

import pytest

from geoaffinity import queries
from geoaffinity.operators import factor


@pytest.mark.parametrize("name,program", [
    ("train_logistic_mf", "logistic_model"), ("train_logistic_mf_neg", "logistic_model"),
    ("train_weighted_mf", "weighted_model"), ("train_bpr", "ranking_model"), ("train_graph_mf", "weighted_model")])
def test_options(monkeypatch, name, program):
    seen = []
    monkeypatch.setattr(queries.fx, "interactions", lambda *a: None)
    monkeypatch.setattr(queries, "_friends", lambda *a: None)
    monkeypatch.setattr(queries, "_trained", lambda spark, trained: trained)
    monkeypatch.setattr(queries.programs, program, lambda data, options, **kind: seen.append(options))
    queries.QUERIES[name](None, "")
    assert seen == [factor.FitOptions()]


def step(number, loss, after, width=1.0, slope=0.01):
    return {"fold": 0, "step": number, "width": width, "slope": slope, "loss": loss, "loss_after": after}


def test_untrained_is_broken():
    three = [step(k, 0.7 - 0.1 * k, 0.6 - 0.1 * k) for k in range(3)]
    assert queries._broken_steps(three) == {0: 1}
    assert queries._broken_steps(three + [step(3, 0.4, 0.3999, slope=1e-7)]) == {0: 0}
    assert queries._broken_steps([step(k, 1 - k / 200, 1 - (k + 1) / 200, slope=1e-3) for k in range(100)]) == {0: 0}
    assert queries._broken_steps([step(0, 0.7, 0.7, width=0.0)]) == {0: 1}
