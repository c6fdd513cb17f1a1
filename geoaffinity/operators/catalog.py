"""Normal users, the devices that cover most usage, and dense ids."""

from pyspark.sql import DataFrame, functions as F

from geoaffinity.functions import day_of
from geoaffinity.runtime import ordered_prefix


def abnormal_users(history: DataFrame, max_runs: int = 5, n: int = 20) -> DataFrame:
    """The ``n`` longest histories among those with at least ``max_runs`` entries."""
    return (
        history.groupBy("user").agg(F.count(F.lit(1)).alias("runs"))
        .where(F.col("runs") >= max_runs)
        .orderBy(F.desc("runs"), "user").limit(n)
    )


def normal_usage(history: DataFrame, max_runs: int = 5) -> DataFrame:
    """History rows of users with fewer than ``max_runs`` entries.

    The history carries its length, so this is a filter and not another shuffle.
    """
    return history.where(F.col("runs") < max_runs)


def device_popularity(usage: DataFrame) -> DataFrame:
    """History entries per device, most used first."""
    return (
        usage.groupBy("device").agg(F.count(F.lit(1)).alias("cnt"))
        .orderBy(F.desc("cnt"), "device")
    )


def coverage_devices(usage: DataFrame, rate: float) -> DataFrame:
    """The most used devices whose running share stays within ``rate``.

    ``d`` is the 0-based popularity rank and ``prefix`` the running count.
    """
    counts = usage.groupBy("device").agg(F.count(F.lit(1)).alias("cnt"))
    ranked = ordered_prefix(counts, ["cnt", "device"], [False, True], value="cnt")
    total = ranked.agg(F.sum("cnt")).scalar()
    return ranked.where(F.col("prefix") <= F.lit(rate) * total).select(
        "device", "cnt", "prefix", F.col("pos").cast("int").alias("d")
    )


def covered_usage(usage: DataFrame, devices: DataFrame) -> DataFrame:
    return usage.join(devices, "device", "left_semi")


def records_per_user_hist(usage: DataFrame) -> DataFrame:
    """How many users keep 1, 2, ... records, most frequent first."""
    sizes = usage.groupBy("user").agg(F.count(F.lit(1)).alias("value"))
    return (
        sizes.groupBy("value").agg(F.count(F.lit(1)).alias("cnt"))
        .orderBy(F.desc("cnt"), "value")
    )


def numbered_users(usage: DataFrame) -> DataFrame:
    """Dense 0-based user ids in user order."""
    users = ordered_prefix(usage.select("user").distinct(), ["user"])
    return users.select("user", F.col("pos").cast("int").alias("u"))


def numbered_usage(usage: DataFrame, users: DataFrame, devices: DataFrame,
                   tz: str = "UTC") -> DataFrame:
    """The usage fact with dense ids: date, u, d."""
    return (
        usage.join(devices.select("device", "d"), "device").join(users, "user")
        .select(day_of(F.col("btime"), tz).alias("date"), "u", "d")
    )
