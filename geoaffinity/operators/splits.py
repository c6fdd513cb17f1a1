"""Time split, repeated stratified splits, profiles and truth sets.

Repeats live in a ``fold`` column, so all of them go through one job.
"""

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from geoaffinity.functions import hash_uniform

SEED = 42  # seed of fold 0; fold t uses SEED + t

# Training and test periods, inclusive; the week between is unused.
TRAIN_DAYS = ("20161023", "20170124")
TEST_DAYS = ("20170201", "20170215")


def time_split(usage: DataFrame, train: tuple[str, str] = TRAIN_DAYS,
               test: tuple[str, str] = TEST_DAYS) -> DataFrame:
    """Label rows ``train`` or ``test`` by date; rows outside both are dropped."""
    day = F.col("date")
    part = F.when(day.between(*train), "train").when(day.between(*test), "test")
    return usage.withColumn("part", part).where(F.col("part").isNotNull())


def split_profile(split: DataFrame) -> DataFrame:
    """Records, users, items and days of each part."""
    return split.groupBy("part").agg(
        F.count(F.lit(1)).alias("records"),
        F.countDistinct("u").alias("users"),
        F.countDistinct("d").alias("items"),
        F.countDistinct("date").alias("days"),
    )


def train_interactions(usage: DataFrame) -> DataFrame:
    """Distinct (u, d) pairs as positive samples."""
    return usage.select("u", "d").distinct().withColumn("x", F.lit(1))


def with_folds(data: DataFrame, folds: int = 10) -> DataFrame:
    """Repeat the data once per fold."""
    ids = F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))
    return data.select("*", ids.alias("fold"))


def seed_of(fold):
    return fold + F.lit(SEED)


def stratified_split(data: DataFrame, alpha: float = 0.8, by_label: bool = False) -> DataFrame:
    """Hold out rows of users with several rows; one-row users stay in train.

    Each eligible row is held out with probability
    ``min(1, N (1 - alpha) / N1)``, N rows in all and N1 of them eligible, so
    that a share ``1 - alpha`` of all rows is held out. ``by_label`` does this
    separately for the positive and the negative rows. Needs fold, u, d (and x);
    adds ``part``. Rows without one of fold, u (and x) count, but are in no part.

    A user's rows are counted beside them, so that data which lies by user is not shuffled again for each fold.
    """
    strata = ["fold", "x"] if by_label else ["fold"]
    per_user = data.groupBy(*strata, "u").agg(F.count(F.lit(1)).alias("_c"))
    many = F.sum(F.when(F.col("_c") > 1, F.col("_c")))
    share = F.sum("_c") * F.lit(1.0 - alpha) / many
    beta = per_user.groupBy(*strata).agg(F.least(F.lit(1.0), share).alias("_beta"))
    keys = [seed_of(F.col("fold"))] + ([F.col("x")] if by_label else [])
    draw = hash_uniform(*keys, F.col("u"), F.col("d"))
    held_out = (F.col("_c") > 1) & (draw < F.col("_beta"))
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in (*strata, "u")])
    counted = data.where(known).withColumn("_c", F.count(F.lit(1)).over(W.partitionBy(*strata, "u")))
    return (
        counted.join(F.broadcast(beta), strata)  # a row per fold and label
        .withColumn("part", F.when(held_out, "valid").otherwise("train"))
        .select(*data.columns, "part")
    )


def changed_users(known: DataFrame, hidden: DataFrame) -> DataFrame:
    """Truth rows: hidden (u, d) pairs that are new for a user seen in ``known``.

    Works per fold when both inputs carry ``fold``.
    """
    keys = [c for c in ("fold", "u", "d") if c in known.columns and c in hidden.columns]
    users = [k for k in keys if k != "d"]
    return (
        hidden.select(*keys).distinct()
        .join(known.select(*keys), keys, "left_anti")
        .join(known.select(*users), users, "left_semi")
    )


def sample_profile(samples: DataFrame) -> DataFrame:
    """Records, users, items, positives and negatives of a sample table."""
    return samples.agg(
        F.count(F.lit(1)).alias("records"),
        F.countDistinct("u").alias("users"),
        F.countDistinct("d").alias("items"),
        F.count_if(F.col("x") == 1).alias("positives"),
        F.count_if(F.col("x") == 0).alias("negatives"),
    )
