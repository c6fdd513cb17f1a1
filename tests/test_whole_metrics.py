"""Metrics of models that are trained to the end, not of their first steps."""

import pytest

from __spark_entry__ import oracle_sql
from geoaffinity import queries
from geoaffinity.operators import factor


@pytest.mark.parametrize("name,program", [("metrics_bpr", "ranking_model"), ("metrics_logistic_mf", "logistic_model"), ("metrics_logistic_mf_neg", "logistic_model")])
def test_whole_training(monkeypatch, name, program):
    seen = []
    monkeypatch.setattr(queries.fx, "interactions", lambda *a: None)
    monkeypatch.setattr(queries, "_means", lambda trained: trained)
    monkeypatch.setattr(queries.programs, program, lambda data, options, **kind: seen.append(options))
    queries.QUERIES[name](None, "")
    assert seen == [factor.FitOptions()]
    assert "step < 100" in oracle_sql()[name]
