"""Visited positions and each user's home and work place.

A user's positions are kept in lists of bounded length (``CHUNK``), so a user
with very many positions is spread over many rows and tasks.
"""

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from geoaffinity.functions import haversine
from geoaffinity.runtime import CHUNK, chunk_count, cut, discard

WHO = ["place_type", "user"]

# The study area in degrees, inclusive.
AREA = {"lat": (30.0, 32.0), "lng": (120.0, 123.0)}


def position_counts(places: DataFrame, digits: int = 6) -> DataFrame:
    """Sightings per (place_type, user, position); positions equal at six
    decimals are one position."""
    return places.groupBy(
        *WHO, F.round("lat", digits).alias("lat"), F.round("lng", digits).alias("lng")
    ).agg(F.count(F.lit(1)).alias("cnt"))


def in_area(counts: DataFrame, area: dict = AREA) -> DataFrame:
    return counts.where(F.col("lat").between(*area["lat"]) & F.col("lng").between(*area["lng"]))


def visits_hist(counts: DataFrame) -> DataFrame:
    """How many users have 1, 2, ... sightings in total, per place type."""
    totals = counts.groupBy(*WHO).agg(F.sum("cnt").alias("value"))
    return totals.groupBy("place_type", "value").agg(F.count(F.lit(1)).alias("cnt")).orderBy(
        "place_type", "value")


def places_hist(counts: DataFrame) -> DataFrame:
    """How many users have 1, 2, ... distinct positions, per place type."""
    totals = counts.groupBy(*WHO).agg(F.count(F.lit(1)).alias("value"))
    return totals.groupBy("place_type", "value").agg(F.count(F.lit(1)).alias("cnt")).orderBy(
        "place_type", "value")


def _chunked(counts: DataFrame, chunk: int) -> DataFrame:
    sizes = counts.groupBy(*WHO).agg(F.count(F.lit(1)).alias("_n"))
    pieces = chunk_count(F.col("_n"), chunk)
    return counts.join(sizes.select(*WHO, pieces.alias("pieces")), WHO).withColumn(
        "piece", F.pmod(F.xxhash64("lat", "lng"), F.col("pieces")).cast("int"))


def _point_lists(chunked: DataFrame) -> DataFrame:
    return chunked.groupBy(*WHO, "piece").agg(
        F.collect_list(F.struct("lat", "lng", "cnt")).alias("points"))


def _kernel(distance: Column, h: float) -> Column:
    bias = math.log(h) + 0.5 * math.log(2.0 * math.pi)
    z = distance / F.lit(float(h))
    return F.exp(F.lit(-0.5) * z * z - F.lit(bias))


def _against_lists(counts: DataFrame, chunk: int) -> DataFrame:
    """Each position beside the bounded lists that make up its user's positions."""
    chunked = _chunked(counts, chunk)
    each = chunked.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    return each.join(_point_lists(chunked), [*WHO, "piece"])


def place_density(counts: DataFrame, h: float, chunk: int = CHUNK) -> DataFrame:
    """Gaussian kernel density at each of the user's positions, weighted by count.

    Distances in metres; ``h`` is the kernel width.
    """
    def term(acc, p):
        far = haversine(F.col("lat"), F.col("lng"), p["lat"], p["lng"])
        return acc + p["cnt"] * _kernel(far, h)

    part = F.aggregate("points", F.lit(0.0), term)
    return (
        _against_lists(counts, chunk).withColumn("part", part)
        .groupBy(*WHO, "lat", "lng").agg(F.first("cnt").alias("cnt"), F.sum("part").alias("density"))
    )


def place_neighbors(centers: DataFrame, counts: DataFrame, h: float) -> DataFrame:
    """The user's positions within ``h`` metres of a centre (clat, clng)."""
    far = haversine(F.col("clat"), F.col("clng"), F.col("lat"), F.col("lng"))
    return (
        counts.join(centers.select(*WHO, "clat", "clng"), WHO)
        .withColumn("dist_m", far).where(F.col("dist_m") <= h)
    )


def densest_positions(counts: DataFrame, h: float, chunk: int = CHUNK) -> DataFrame:
    """The densest position of each user; ties go to the smaller (lat, lng)."""
    best = F.min(F.struct((-F.round("density", 12)).alias("k"), "lat", "lng")).alias("b")
    return place_density(counts, h, chunk).groupBy(*WHO).agg(best).select(*WHO, "b.lat", "b.lng")


def _shift(points: DataFrame, centers: DataFrame, h: float, delta: float) -> DataFrame:
    """One weighted mean for each centre; done once it moves by less than ``delta``.

    The distance of a position is computed once. Sums are pre-aggregated where the rows are, so a
    user with very many positions costs partial sums and not a task.
    """
    w = F.col("cnt") * _kernel(F.col("dist_m"), h)
    near = place_neighbors(centers, points, h).select(
        *WHO, "lat", "lng", w.alias("w"))
    means = near.groupBy(*WHO).agg(
        F.sum("w").alias("w"), F.sum(F.col("w") * F.col("lat")).alias("y"),
        F.sum(F.col("w") * F.col("lng")).alias("x")).select(
        *WHO, (F.col("y") / F.nullif("w", F.lit(0.0))).alias("lat"),
        (F.col("x") / F.nullif("w", F.lit(0.0))).alias("lng"))
    move = F.sqrt(F.pow(F.col("lat") - F.col("clat"), 2.0) + F.pow(F.col("lng") - F.col("clng"), 2.0))
    return centers.join(means, WHO, "left").select(
        *WHO, "lat", "lng", (move.isNull() | (move < delta)).alias("done"),
        (F.col("steps") + 1).alias("steps"))


def semantic_place(counts: DataFrame, h: float, delta: float = 1e-5,
                   max_iter: int | None = None) -> DataFrame:
    """Home / work place of each user: the mode reached from the densest position.

    Repeats the weighted mean of the positions within ``h`` metres until it moves by less than
    ``delta`` degrees. All users take the same way; a step looks only at those that still move, and the search
    goes on until none is left. ``max_iter`` ends it early; ``done`` tells which places have settled.
    """
    counts = cut(counts)
    moving = cut(densest_positions(counts, h).withColumn("steps", F.lit(0)))
    parts, steps = [], 0
    while True:
        centers = moving.select(*WHO, F.col("lat").alias("clat"), F.col("lng").alias("clng"), "steps")
        state, steps = cut(_shift(counts, centers, h, delta)), steps + 1
        discard(moving)
        moving = state.where(~F.col("done"))
        if steps == max_iter or moving.isEmpty():
            break
        parts.append(state.where("done"))
        moving = cut(moving)
    return reduce(DataFrame.unionByName, [*parts, state]).select(*WHO, "lat", "lng", "steps", "done")


def user_places(semantic: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Users with both places: hlat, hlng, wlat, wlng, under their dense id if given."""
    def place(kind, column, name):
        return F.max(F.when(F.col("place_type") == kind, F.col(column))).alias(name)

    wide = semantic.groupBy("user").agg(
        place("home", "lat", "hlat"), place("home", "lng", "hlng"),
        place("work", "lat", "wlat"), place("work", "lng", "wlng"),
    ).where(F.col("hlat").isNotNull() & F.col("wlat").isNotNull())
    if users is None:
        return wide.withColumnRenamed("user", "u")
    return wide.join(users, "user").select("u", "hlat", "hlng", "wlat", "wlng")
