"""Top-n lists from factors, and precision / recall / F1 at k."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from geoaffinity.functions import f1_score

BLOCK = 2048  # users or items of one block; bounds the score matrix of a task


def _best(z: np.ndarray, usable: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``n`` best usable scores of each row, ties to the smaller column."""
    z = np.where(usable, z, -np.inf)
    if z.shape[1] > n:  # everything from the n-th best score on
        least = np.partition(z, z.shape[1] - n, axis=1)[:, z.shape[1] - n, None]
        usable = usable & (z >= least)
    row, col = np.nonzero(usable)
    order = np.lexsort((col, -z[row, col], row))
    row, col = row[order], col[order]
    first = np.searchsorted(row, row)
    keep = np.arange(len(row)) - first < n
    return row[keep], col[keep]


def _score_blocks(n: int):
    def unpack(lists: pa.ListArray, i: int, key: str) -> tuple[np.ndarray, np.ndarray, pa.StructArray]:
        rows = lists[i].values
        f = rows.field("f")
        return np.asarray(rows.field(key)), np.asarray(f.flatten()).reshape(len(rows), -1), rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                us, p, rows = unpack(batch.column("users"), i, "u")
                ds, q, _ = unpack(batch.column("items"), i, "d")
                z = p @ q.T
                if not np.isfinite(z).all():
                    raise ValueError("a score is not finite: the factors have diverged")
                usable = np.ones(z.shape, bool)
                used = rows.field("used")
                gone = np.asarray(used.flatten())
                at = np.repeat(np.arange(len(us)), np.diff(np.asarray(used.offsets)))
                col = np.minimum(np.searchsorted(ds, gone), len(ds) - 1)
                real = ds[col] == gone
                usable[at[real], col[real]] = False
                row, col = _best(z, usable, n)
                fold = pa.array(np.full(len(row), batch.column("fold")[i].as_py(), np.int32))
                yield pa.RecordBatch.from_arrays(
                    [fold, pa.array(us[row]), pa.array(ds[col]), pa.array(z[row, col])],
                    names=["fold", "u", "d", "score"])

    return run


def _packed(rows: DataFrame, key: str, block: int, name: str, *extra: str) -> DataFrame:
    """Blocks of about ``block`` rows of a fold, each packed into one row sorted by ``key``."""
    blocks = F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("blocks")
    sizes = rows.groupBy("fold").agg(blocks)  # one row per fold
    own = F.pmod(F.xxhash64(key), F.col("blocks")).cast("int")
    packed = F.sort_array(F.collect_list(F.struct(key, "f", *extra))).alias(name)
    return rows.join(F.broadcast(sizes), "fold").withColumn("block", own).groupBy("fold", "block").agg(packed)


def topn_by_factor(users: DataFrame, items: DataFrame, used: DataFrame, n: int = 10,
                   block: int = BLOCK) -> DataFrame:
    """The ``n`` unused items with the highest score ``p . q`` for each user.

    ``users`` (fold, u, f) should hold only users that are evaluated. Users, with what they have
    used, and items are packed into blocks, a block being one row. Each user block meets each item block
    of its fold as a matrix product; of that only ``n`` items per user leave the task. The planner broadcasts item
    blocks that measure small; otherwise packed user blocks travel to the item blocks. A score that
    is not finite is an error.
    """
    big = [F.col(c).cast("bigint").alias(c) for c in ("u", "d")]
    gone = used.select("fold", *big).groupBy("fold", "u").agg(F.collect_list("d").alias("used"))
    none = F.array().cast("array<bigint>")
    asked = users.select("fold", big[0], "f").join(gone, ["fold", "u"], "left").withColumn(
        "used", F.coalesce("used", none))
    goods = _packed(items.select("fold", big[1], "f"), "d", block, "items").withColumnRenamed("block", "ib")
    many = goods.groupBy("fold").agg(F.collect_list("ib").alias("ibs"))  # one row per fold
    people = _packed(asked, "u", block, "users", "used").join(F.broadcast(many), "fold").select(
        "fold", "users", F.explode("ibs").alias("ib"))
    best = people.join(goods, ["fold", "ib"]).select("fold", "users", "items").mapInArrow(
        _score_blocks(n), "fold int, u bigint, d bigint, score double")
    order = W.partitionBy("fold", "u").orderBy(F.desc("score"), "d")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def precision_recall_at_k(truth: DataFrame, recommended: DataFrame, k: int = 10) -> DataFrame:
    """Mean precision and recall at 1..k per fold, and F1 of the two means.

    ``truth`` (fold, u, d) are the new items, ``recommended`` (fold, u, d, rank)
    the ordered lists. The mean is over truth users that have a list; a hit at
    rank r counts for every k >= r, so hits are counted once by rank.
    """
    keys = ["fold", "u"]
    listed = recommended.select(*keys).distinct()
    sizes = truth.groupBy(*keys).agg(F.count(F.lit(1)).alias("t")).join(listed, keys, "left_semi")
    folds = sizes.groupBy("fold").agg(F.count(F.lit(1)).alias("users"))
    hits = (
        recommended.where(F.col("rank") <= k).select(*keys, "d", "rank")
        .join(truth, [*keys, "d"], "left_semi").join(sizes, keys)
        .groupBy("fold", F.col("rank").alias("k"))
        .agg(F.count(F.lit(1)).alias("h"), F.sum(F.lit(1.0) / F.col("t")).alias("r"))
    )
    up_to = W.partitionBy("fold").orderBy("k").rowsBetween(W.unboundedPreceding, W.currentRow)
    every = folds.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(k))))

    def total(c):
        return F.sum(F.coalesce(F.col(c), F.lit(0))).over(up_to)

    return (
        every.join(hits, ["fold", "k"], "left")
        .select("fold", "k", "users",
                (total("h") / F.col("k") / F.col("users")).alias("precision"),
                (total("r") / F.col("users")).alias("recall"))
        .withColumn("f1", f1_score(F.col("precision"), F.col("recall")))
    )


def cv_metrics(metrics: DataFrame) -> DataFrame:
    """Mean precision and recall over the folds, and F1 of those means."""
    means = metrics.groupBy("k").agg(
        F.avg("precision").alias("precision"), F.avg("recall").alias("recall"))
    return means.withColumn("f1", f1_score(F.col("precision"), F.col("recall")))
