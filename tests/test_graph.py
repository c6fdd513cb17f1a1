"""Places and the user graph against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from geoaffinity.operators import geograph, places
from geoaffinity.runtime import salted_join

R = 6372800.0


def haversine(a, b):
    (lat1, lng1), (lat2, lng2) = [[math.radians(x) for x in p] for p in (a, b)]
    h = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin(
        (lng2 - lng1) / 2) ** 2
    return 2 * R * math.asin(math.sqrt(min(1.0, h)))


def brute(rows, distance):
    out = {}
    for u, hlat, hlng, wlat, wlng in rows:
        near = []
        for v, a, b, c, d in rows:
            d2 = haversine((hlat, hlng), (a, b)) ** 2 + haversine((wlat, wlng), (c, d)) ** 2
            if u != v and d2 <= 2 * distance * distance:
                near.append((d2, v))
        out[u] = sorted(near)
    return out


def users_near(lat, lng, n, seed, spread=0.03):
    rng = random.Random(seed)

    def wrap(x):
        return (x + 180.0) % 360.0 - 180.0

    return [(u, lat + rng.uniform(-spread, spread), wrap(lng + rng.uniform(-spread, spread)),
             lat + rng.uniform(-spread, spread), wrap(lng + rng.uniform(-spread, spread)))
            for u in range(n)]


SCHEMA = "u long, hlat double, hlng double, wlat double, wlng double"


@pytest.mark.parametrize("lat,lng", [(30.5, 120.5), (0.0, 0.0), (-35.0, -70.0), (62.0, 180.0)])
def test_grid_join_equals_brute_force(spark, lat, lng):
    rows = users_near(lat, lng, 60, seed=3)
    df = spark.createDataFrame(rows, SCHEMA)
    for distance in (800.0, 2500.0):
        want = brute(rows, distance)
        pairs = geograph.geo_pairs(df, distance)
        assert pairs.agg(F.sum(F.col("n") * F.col("o_n"))).first()[0] == len(rows) + sum(
            map(len, want.values()))
        got = geograph.geo_knn(df, distance, 5).collect()
        assert {(r.src, r.rank): r.dst for r in got} == {
            (u, i + 1): v for u, near in want.items() for i, (_, v) in enumerate(near[:5])}


def test_crowded_sites_and_small_radii(spark, monkeypatch):
    """A third of the users share one site; dense cells start at smaller radii."""
    monkeypatch.setattr(geograph, "DENSE", 1)
    rows = users_near(30.5, 120.5, 80, seed=5)
    rows += [(u, 30.5, 120.5, 30.51, 120.51) for u in range(80, 120)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows, 2000.0)
    sites = geograph.sites_of(df)
    assert len(geograph._radii(sites, 2000.0, 5)) > 1
    got = geograph.geo_knn(df, 2000.0, 4).collect()
    by_user = {}
    for r in got:
        by_user.setdefault(r.src, []).append((r.rank, r.dst))
    for u, near in want.items():
        assert [d for _, d in sorted(by_user.get(u, []))] == [v for _, v in near[:4]]


def test_edge_weights_sum_to_one(spark):
    df = spark.createDataFrame(users_near(30.5, 120.5, 50, seed=8), SCHEMA)
    for edges in (geograph.geo_edges(df, 2000.0, 5),
                  geograph.friend_weights(geograph.distance_graph(df))):
        sums = edges.groupBy("src").agg(F.sum("score").alias("s")).collect()
        assert sums and all(abs(r.s - 1.0) < 1e-12 for r in sums)


def test_overlap_modes(spark):
    graph = spark.createDataFrame([(1, 2, 0.05, 1), (1, 3, 0.15, 2), (2, 1, 0.05, 1), (3, 9, 0.1, 1)],
                                  "src long, dst long, dist_km double, rank int")
    used = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (3, 5)], "u long, d long")
    any_ = {(r.k, r.d_step): (r.overlap, r.users)
            for r in geograph.neighbor_overlap(graph, used).collect()}
    assert any_[(1, 1)] == (1.0, 2)          # 1-2 and 2-1 share device 2
    assert any_[(2, 2)] == (0.75, 2)         # user 1: mean of 1 and 0; user 9 is unknown
    ratio = {(r.k, r.d_step): r.overlap
             for r in geograph.neighbor_overlap(graph, used, mode="ratio").collect()}
    assert ratio[(1, 1)] == pytest.approx((0.5 + 1.0) / 2)


def counts_frame(spark, users=6, points=12):
    rng = random.Random(2)
    rows = [("home", u, 30.5 + rng.uniform(-0.01, 0.01), 120.5 + rng.uniform(-0.01, 0.01),
             rng.randint(1, 9)) for u in range(users) for _ in range(points)]
    return spark.createDataFrame(
        rows, "place_type string, user long, lat double, lng double, cnt long")


def test_density_does_not_depend_on_list_length(spark):
    counts = counts_frame(spark)
    whole = {(r.user, r.lat): r.density for r in places.place_density(counts, 500.0).collect()}
    split = {(r.user, r.lat): r.density
             for r in places.place_density(counts, 500.0, chunk=3).collect()}
    assert whole.keys() == split.keys()
    assert all(abs(whole[k] - split[k]) < 1e-12 for k in whole)


def shifted(points, start, h, delta=1e-5):
    """Mean shift of one user in plain Python: position and steps."""
    (y, x), steps = start, 0
    while True:
        w = [n * math.exp(-0.5 * (haversine((y, x), (a, b)) / h) ** 2) if haversine((y, x), (a, b)) <= h else 0.0
             for a, b, n in points]
        new = (sum(v * p[0] for v, p in zip(w, points)) / sum(w), sum(v * p[1] for v, p in zip(w, points)) / sum(w))
        steps, moved = steps + 1, math.dist(new, (y, x))
        y, x = new
        if moved < delta:
            return y, x, steps


def test_mode_search_goes_on_until_nothing_moves(spark):
    """One user has more than 1024 positions, one needs more than a hundred steps, one a single position."""
    rng = random.Random(8)
    rows = [("home", 1, 30.5 + rng.uniform(-0.01, 0.01), 120.5 + rng.uniform(-0.01, 0.01), rng.randint(1, 3))
            for _ in range(1100)]
    # a long gentle slope: counts rise slowly, so every step is short
    rows += [("home", 2, 30.5 + k * 0.0001, 120.5, 1000 + 2 * k) for k in range(150)]
    rows += [("work", 3, 30.7, 120.7, 4)]
    counts = spark.createDataFrame(rows, "place_type string, user long, lat double, lng double, cnt long")
    starts = {r.user: (r.lat, r.lng) for r in places.densest_positions(counts, 60.0).collect()}
    got = {r.user: r for r in places.semantic_place(counts, 60.0, delta=1e-9).collect()}
    assert got.keys() == {1, 2, 3} and all(r.done for r in got.values())
    for u in got:
        y, x, steps = shifted([(r[2], r[3], r[4]) for r in rows if r[1] == u], starts[u], 60.0, 1e-9)
        assert (got[u].lat, got[u].lng) == pytest.approx((y, x), abs=1e-7)
        assert abs(got[u].steps - steps) <= 1
    early = places.semantic_place(counts, 60.0, delta=1e-9, max_iter=1)
    assert {r.user: r.done for r in early.collect()} == {1: False, 2: False, 3: True}


def test_one_hot_cell_is_split_on_both_sides(spark, monkeypatch):
    """Users of one grid cell: the join may not put more than a bounded product into one task."""
    rows = users_near(30.5, 120.5, 120, seed=9, spread=0.0005)
    plain = geograph.geo_pairs(spark.createDataFrame(rows, SCHEMA), 800.0).count()
    sizes = []

    def spy(left, right, keys, salt_by, hot=20):
        out = salted_join(left, right, keys, salt_by, hot=20)
        sizes.append(out.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(geograph, "salted_join", spy)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert geograph.geo_pairs(spark.createDataFrame(rows, SCHEMA), 800.0).count() == plain == 120 * 120
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(sizes) <= 120 * 120 / 3
