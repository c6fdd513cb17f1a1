"""Deterministic pseudo-random numbers keyed by values.

A draw depends only on the seed and the row's own keys, so sampling gives the
same rows under any partitioning and after a lost executor is recomputed.
"""

from pyspark.sql import Column, functions as F


def _as_column(key):
    return key if isinstance(key, Column) else F.lit(key)


def hash_bits(*keys) -> Column:
    """32 hash bits of the keys as a non-negative BIGINT. Columns or literals."""
    text = F.concat_ws("|", *[_as_column(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def hash_uniform(*keys) -> Column:
    """A uniform DOUBLE in [0, 1) decided by the keys."""
    return hash_bits(*keys) / F.lit(4294967296.0)
