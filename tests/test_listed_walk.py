"""Negatives of a user's list against those of walks as rows, and lists that are made once."""

import pytest

from geoaffinity.operators import evaluate, sampling
from geoaffinity.plans import programs

ROWS = [(f, u, d) for f in (0, 1) for u in range(15) for d in range(0, 40, 1 + u % 7)] + [
    (0, 3, 4), (0, 3, 4), (0, None, 5), (0, None, 6), (1, 20, 99), (1, 21, -3), (0, 22, None), (None, 2, 1)]


@pytest.mark.parametrize("times", [1, 2])
@pytest.mark.parametrize("size", [3, 1 << 18])
def test_same_negatives_without_walks_as_rows(spark, monkeypatch, capsys, times, size):
    monkeypatch.setattr(sampling, "WALK", size)
    positives = spark.createDataFrame(ROWS, "fold int, u long, d int")
    items = spark.createDataFrame([(d,) for d in range(40)], "d int")
    listed = sampling.add_negatives(positives, items, times)
    listed.explain()
    plan = capsys.readouterr().out
    assert "Window" not in plan and "Join" not in plan
    monkeypatch.setattr(sampling, "LISTED", 0)
    walked = sampling.add_negatives(positives, items, times)
    assert listed.schema == walked.schema
    assert sorted(map(str, listed.collect())) == sorted(map(str, walked.collect()))


def test_lists_are_made_once(spark, monkeypatch, capsys):
    """What the metrics read several times is a table."""
    seen = []
    monkeypatch.setattr(evaluate, "precision_recall_at_k", lambda truth, lists, n: seen.extend([truth, lists]))
    rows = spark.createDataFrame([(0, u, d) for u in range(20) for d in range(9) if (u + d) % 3], "fold int, u long, d long")
    programs.item_model(rows)
    for table in seen:
        table.explain()
        assert "Join" not in capsys.readouterr().out
