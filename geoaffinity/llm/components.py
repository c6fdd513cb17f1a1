"""Connected components of a graph given by its links, in rounds of joins."""

from pyspark.sql import DataFrame, functions as F

from ..runtime import cut, discard
from .skew import join_counted


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Hang each node's larger (or smaller) neighbours on the smallest node around it."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    around = cut(both if large else both.where("b < a"))
    centre = cut(around.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"),
                                         F.count(F.lit(1)).alias("n")))
    hung = join_counted(around, centre, ["a"], "n", "inner")
    if large:
        moved = hung.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            centre.select("a", F.col("m").alias("b")))
    out = cut(moved.where("a != b").distinct())
    discard(around, centre)
    return out


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for every node of ``links(a, b)``.

    Large-star and small-star steps take turns until nothing changes; every step is a table, so a
    lost executor costs tasks of one step. The number of rounds grows with the logarithm of the
    longest chain. A component may hold any share of the nodes: the hubs are the hot keys of ``join_counted``.
    """
    now = cut(links.where("a != b").select("a", "b").distinct())
    seen = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == seen or not state[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = tuple(state)
        wide = _star(now, large=True)
        old, now = now, _star(wide, large=False)
        discard(old, wide)
