"""From raw sightings to one device per day and a device-change history."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from geoaffinity.functions import day_of, hour_of, in_days, weekday_of

# The study period of the raw log, inclusive.
STUDY_DAYS = ("20161023", "20170215")

# Night is before / since these hours, office hours are inclusive.
NIGHT, OFFICE = (8, 20), (9, 16)


def valid_sightings(sightings: DataFrame, cells: DataFrame, devices: DataFrame,
                    days: tuple[str, str] = STUDY_DAYS, tz: str = "UTC") -> DataFrame:
    """Sightings inside the day window, at a known cell, from a known device.

    The device number is cut to its 8-character code. Both dimension joins are
    semi-joins without a hint: Spark broadcasts a dimension that is measured to
    be small and shuffles it otherwise. The shard of a sighting is kept if it has one.
    """
    shard = [c for c in sightings.columns if c == "shard"]
    return (
        sightings.where(in_days(F.col("second"), *days, tz))
        .select("second", "user", F.substring("imei", 1, 8).alias("tac"), "cell",
                day_of(F.col("second"), tz).alias("day"), *shard)
        .join(cells, "cell", "left_semi")
        .join(devices, "tac", "left_semi")
        .select("second", "user", "tac", "cell", "day", *shard)
    )


def context_sightings(valid: DataFrame, cells: DataFrame, tz: str = "UTC") -> DataFrame:
    """Attach hour, weekday and the position of the cell."""
    return valid.join(cells, "cell").select(
        "second", "user", "tac",
        hour_of(F.col("second"), tz).alias("hour"),
        weekday_of(F.col("second"), tz).alias("wday"),
        "lat", "lng",
    )


def _home(night: tuple[int, int]) -> Column:
    before, since = night
    return (F.col("hour") < before) | (F.col("hour") >= since)


def _work(office: tuple[int, int]) -> Column:
    return (F.col("wday") < 5) & F.col("hour").between(*office)


def home_sightings(context: DataFrame, before: int = NIGHT[0], since: int = NIGHT[1]) -> DataFrame:
    """Night hours of any day."""
    return context.where(_home((before, since)))


def work_sightings(context: DataFrame, first: int = OFFICE[0], last: int = OFFICE[1]) -> DataFrame:
    """Office hours (both ends included) of Monday to Friday."""
    return context.where(_work((first, last)))


def place_sightings(context: DataFrame, night: tuple[int, int] = NIGHT,
                    office: tuple[int, int] = OFFICE) -> DataFrame:
    """Home and work sightings in one pass, told apart by ``place_type``; a sighting
    that fits both rules counts for both."""
    kinds = F.array_compact(F.array(F.when(_home(night), "home"), F.when(_work(office), "work")))
    return context.withColumn("place_type", F.explode(kinds))


def named_usage(valid: DataFrame, devices: DataFrame) -> DataFrame:
    """Replace the device code by the device name."""
    return valid.join(devices, "tac").select("second", "user", "device", "cell", "day")


def log_profile(usage: DataFrame) -> DataFrame:
    """Exact numbers of distinct days, users, devices and cells."""
    return usage.agg(
        F.countDistinct("day").alias("days"),
        F.countDistinct("user").alias("users"),
        F.countDistinct("device").alias("devices"),
        F.countDistinct("cell").alias("cells"),
    )


def valid_by_day(valid: DataFrame) -> DataFrame:
    return valid.groupBy("day").agg(F.count(F.lit(1)).alias("cnt")).orderBy("day")


def records_by_shard(scan: DataFrame, valid: DataFrame) -> DataFrame:
    """Records read and records kept of each shard; ``valid`` may carry fewer shards."""
    kept = valid.groupBy("shard").agg(F.count(F.lit(1)).alias("kept"))
    return scan.groupBy("shard").agg(F.count(F.lit(1)).alias("records")).join(kept, "shard", "left").select(
        "shard", "records", F.coalesce("kept", F.lit(0)).alias("kept"))


def device_days(usage: DataFrame) -> DataFrame:
    """The most used device of each user and day, with its first second that day.

    Ties go to the device seen first, then to the smaller name. The pick is a
    ``min`` over a struct, so it is partially aggregated before the shuffle.
    """
    counted = usage.groupBy("user", "day", "device").agg(
        F.count(F.lit(1)).alias("n"), F.min("second").alias("btime")
    )
    first = F.min(F.struct((-F.col("n")).alias("k"), "btime", "device")).alias("b")
    return counted.groupBy("user", "day").agg(first).select(
        "user", "day", "b.btime", "b.device", (-F.col("b.k")).alias("n")
    )


def _without_blips(history):
    """Fold: a device that interrupts another for one entry is overwritten.

    The result of one replacement is what the next comparison sees, so this is
    a fold over the ordered entries and not a lag/lead rule.
    """
    def step(acc, x):
        before = F.try_element_at(acc, F.lit(-2))["device"]
        last = F.try_element_at(acc, F.lit(-1))["device"]
        blip = (before == x["device"]) & (last != x["device"])
        kept = F.when(F.coalesce(blip, F.lit(False)),
                      F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)
        return F.concat(kept, F.array(x))

    empty = F.array().cast("array<struct<btime:bigint,device:string>>")
    return F.aggregate(history, empty, step)


def _first_of_runs(history):
    return F.filter(
        history,
        lambda x, i: (i == 0) | (x["device"] != F.get(history, i - 1)["device"]),
    )


def device_history(days: DataFrame) -> DataFrame:
    """Device changes of each user in time order: blips removed, runs merged.

    ``days`` holds at most one row per user and calendar day, which bounds the
    collected list. ``runs`` is the length of the user's history.
    """
    entry = F.struct(F.col("btime").cast("bigint").alias("btime"),
                     F.col("device").cast("string").alias("device"))
    lists = days.groupBy("user").agg(F.array_sort(F.collect_list(entry)).alias("h"))
    folded = lists.withColumn("h", _without_blips(F.col("h")))
    merged = folded.withColumn("h", _first_of_runs(F.col("h")))
    return merged.select(
        "user", F.size("h").alias("runs"), F.posexplode("h").alias("seq", "e")
    ).select("user", "seq", "e.btime", "e.device", "runs")


def usage_runs(days: DataFrame) -> DataFrame:
    """Keep the first entry of each run of equal devices; blips stay."""
    w = W.partitionBy("user").orderBy("btime", "device")
    return (
        days.withColumn("prev", F.lag("device").over(w))
        .where(F.col("prev").isNull() | (F.col("prev") != F.col("device")))
        .select("user", "btime", "device")
    )


def usage_profile(history: DataFrame, tz: str = "UTC") -> DataFrame:
    """Distinct days, users, devices and (user, device) pairs of a history."""
    day = day_of(F.col("btime"), tz)
    return history.withColumn("day", day).agg(
        F.countDistinct("day").alias("days"),
        F.min("day").alias("first_day"),
        F.max("day").alias("last_day"),
        F.countDistinct("user").alias("users"),
        F.countDistinct("device").alias("devices"),
        F.countDistinct("user", "device").alias("pairs"),
    )


def usage_days(history: DataFrame, tz: str = "UTC") -> DataFrame:
    """The distinct days on which a history entry begins, in order."""
    return history.select(day_of(F.col("btime"), tz).alias("day")).distinct().orderBy("day")


def distinct_devices(history: DataFrame) -> DataFrame:
    """The distinct devices of each user."""
    return history.select("user", "device").distinct()


def devices_per_user_hist(pairs: DataFrame, user: str = "user", device: str = "device") -> DataFrame:
    """How many users have used 1, 2, 3, ... distinct devices."""
    sizes = pairs.select(user, device).distinct().groupBy(user).agg(
        F.count(F.lit(1)).alias("value"))
    return sizes.groupBy("value").agg(F.count(F.lit(1)).alias("cnt")).orderBy("value")


def users_per_device(pairs: DataFrame, user: str = "user", device: str = "device") -> DataFrame:
    """Distinct users of each device, most used first."""
    return (
        pairs.groupBy(device).agg(F.countDistinct(user).alias("users"))
        .orderBy(F.desc("users"), device)
    )
