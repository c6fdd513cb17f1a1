"""Logistic link and losses, computed from the raw score so they never overflow."""

from pyspark.sql import Column, functions as F


def logistic(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def softplus(z: Column) -> Column:
    """``ln(1 + e^z)``."""
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def log_loss(label: Column, z: Column) -> Column:
    """Cross entropy of a label in [0, 1] against ``logistic(z)``."""
    return softplus(z) - label * z


def f1_score(precision: Column, recall: Column) -> Column:
    total = precision + recall
    return F.when(total == 0, F.lit(0.0)).otherwise(
        F.lit(2.0) * precision * recall / F.nullif(total, F.lit(0.0))
    )
