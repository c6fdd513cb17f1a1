"""Joins that hold when one key carries a large share of all rows."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

HOT_KEYS = 1000  # a key is hot from this fraction of all rows on: 1 / HOT_KEYS


def _on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"_r_{k}"]) for k in keys])


def join_counted(left: DataFrame, right: DataFrame, keys: Sequence[str], count: str,
                 how: str = "left") -> DataFrame:
    """Join ``left`` with ``right``, which has one row per key and, in ``count``,
    the number of left rows with that key. Null keys meet null keys.

    The counts add up to the left rows, so fewer than ``HOT_KEYS`` keys can hold
    more than 1 / HOT_KEYS of them each. The hashes of these keys split both sides: what has a hot hash on
    the right is broadcast and its left rows stay where they are; all other keys are small and go through the
    planner's own join. Both inputs are read twice and should be tables, keys of one type on
    both sides. ``how`` is left, inner or left_semi.
    """
    total = right.agg(F.sum(count)).first()[0] or 0
    side = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys],
                        *[c for c in right.columns if c not in keys])
    drop = [f"_r_{k}" for k in keys]
    code = F.xxhash64(*drop)
    hot = [r[0] for r in side.where(F.col(count) * HOT_KEYS > F.lit(total)).select(code).collect()]
    if not hot:
        return left.join(side, _on(left, side, keys), how).drop(*drop)
    mine = F.xxhash64(*keys)
    some, heavy = left.where(mine.isin(hot)), F.broadcast(side.where(code.isin(hot)))
    rest, light = left.where(~mine.isin(hot)), side.where(~code.isin(hot))
    return some.join(heavy, _on(some, heavy, keys), how).drop(*drop).unionByName(
        rest.join(light, _on(rest, light, keys), how).drop(*drop))
