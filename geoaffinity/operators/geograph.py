"""Grid distance join on (home, work) and the nearest-neighbour user graph.

Users at exactly the same two positions are one *site*. Distances are computed
between sites, never between copies, and a site stands for its members only up
to the number that can still matter to a nearest-neighbour list.
"""

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from geoaffinity.functions import (EARTH_KM, EARTH_M, block_size, cell_index, haversine,
                                   rms_distance)
from geoaffinity.runtime import cut, salted_join

PLACE = ["hlat", "hlng", "wlat", "wlng"]
OTHER = [f"o_{c}" for c in PLACE]
CELL = ["hc_lat", "hc_lng", "wc_lat", "wc_lng"]
DENSE = 32     # sites per cell and wanted neighbour above which a smaller radius comes first
SHRINKS = 10   # at most this many halvings of the radius
STEPS = 20     # distance thresholds of a sweep
STEP_KM = 0.1


def grid_cells(places: DataFrame, distance: float, truncate: bool = False) -> DataFrame:
    """Home and work grid cell of each user, cell side sqrt(2) times ``distance`` metres."""
    width = block_size(distance)
    names = zip(CELL, PLACE)
    return places.select("*", *[cell_index(F.col(p), width, truncate).alias(c) for c, p in names])


def grid_expand(cells: DataFrame, first: str, second: str) -> DataFrame:
    """Repeat each row for the 3 x 3 block of cells around its own."""
    around = F.sequence(F.lit(-1), F.lit(1))
    return (
        cells.withColumn("_dx", F.explode(around)).withColumn("_dy", F.explode(around))
        .withColumn(first, F.col(first) + F.col("_dx"))
        .withColumn(second, F.col(second) + F.col("_dy"))
        .drop("_dx", "_dy")
    )


class _Grid:
    """Cells twice as wide as the reach, tiling the whole circle of longitude,
    so a query box touches about two cells per axis."""

    def __init__(self, reach: float):
        self.reach = reach / EARTH_M * (1.0 + 1e-9) + 1e-12
        self.height = 2.0 * self.reach
        self.turns = max(1, int(2.0 * math.pi / self.height))
        self.width = 2.0 * math.pi / self.turns

    def own(self, df: DataFrame, names: list[str]) -> DataFrame:
        """The one cell a site lies in."""
        def lat(c):
            return F.floor(F.radians(c) / F.lit(self.height))

        def lng(c):
            return F.pmod(F.floor(F.radians(c) / F.lit(self.width)), F.lit(self.turns))

        rules = [lat, lng, lat, lng]
        return df.select("*", *[r(n).alias(c) for c, n, r in zip(CELL, names, rules)])

    def _rows(self, lat: str) -> Column:
        at = F.radians(lat)
        lo = F.floor((at - F.lit(self.reach)) / F.lit(self.height))
        hi = F.floor((at + F.lit(self.reach)) / F.lit(self.height))
        return F.sequence(lo, hi)

    def _columns(self, lat: str, lng: str) -> Column:
        """Longitude cells within reach at this latitude, wrapped at the date line."""
        top = F.abs(F.radians(lat)) + F.lit(self.reach)
        ratio = F.lit(math.sin(min(self.reach / 2.0, math.pi / 2.0))) / F.cos(top)
        half = F.when(top >= math.pi / 2.0, F.lit(math.pi)).otherwise(
            F.lit(2.0) * F.asin(F.least(ratio, F.lit(1.0)))) + F.lit(1e-12)
        lo = F.floor((F.radians(lng) - half) / F.lit(self.width))
        hi = F.floor((F.radians(lng) + half) / F.lit(self.width))
        whole = hi - lo >= self.turns - 1
        cells = F.sequence(F.when(whole, F.lit(0).cast("bigint")).otherwise(lo),
                           F.when(whole, F.lit(self.turns - 1).cast("bigint")).otherwise(hi))
        return F.transform(cells, lambda i: F.pmod(i, F.lit(self.turns)))

    def touched(self, df: DataFrame) -> DataFrame:
        """One row per cell that a site's box can reach."""
        lists = [self._rows("hlat"), self._columns("hlat", "hlng"),
                 self._rows("wlat"), self._columns("wlat", "wlng")]
        for name, cells in zip(CELL, lists):
            df = df.withColumn(name, F.explode(cells))
        return df


def _leg(first: str, radius: float) -> Column:
    return haversine(F.col(f"{first}lat"), F.col(f"{first}lng"),
                     F.col(f"o_{first}lat"), F.col(f"o_{first}lng"), radius)


def squared_distance(radius: float = EARTH_M) -> Column:
    """Sum of the squared home and work distances of a row with both sites."""
    return F.pow(_leg("h", radius), 2.0) + F.pow(_leg("w", radius), 2.0)


def sites_of(places: DataFrame) -> DataFrame:
    """Distinct (home, work) positions with the number of users there."""
    return places.groupBy(*PLACE).agg(F.count(F.lit(1)).alias("n"))


def _on_sphere(df: DataFrame, lead: str = "") -> DataFrame:
    """Add the two positions as points of the unit sphere, for a cheap first test."""
    points = []
    for place in "hw":
        lat, lng = (F.radians(f"{lead}{place}{c}") for c in ("lat", "lng"))
        points += [(F.cos(lat) * F.cos(lng)).alias(f"{lead}{place}x"),
                   (F.cos(lat) * F.sin(lng)).alias(f"{lead}{place}y"),
                   F.sin(lat).alias(f"{lead}{place}z")]
    return df.select("*", *points)


def _squared_chords() -> Column:
    total = F.lit(0.0)
    for axis in ("hx", "hy", "hz", "wx", "wy", "wz"):
        total = total + F.pow(F.col(axis) - F.col(f"o_{axis}"), 2.0)
    return total


def _within(queries: DataFrame, sites: DataFrame, distance: float) -> DataFrame:
    """Query sites beside every site with ``dH^2 + dW^2 <= 2 distance^2``, d2 added.

    ``sites`` columns other than the position get the prefix ``o_``. A chord is
    never longer than its arc, so comparing chords first rejects most candidates
    with a few multiplications; the exact distance decides on the rest.
    """
    grid = _Grid(math.sqrt(2.0) * distance)
    others = sites.select([F.col(c).alias(f"o_{c}") for c in sites.columns])
    targets = grid.own(_on_sphere(others, "o_"), OTHER)
    met = salted_join(grid.touched(_on_sphere(queries)), targets, CELL, OTHER)
    limit = 2.0 * distance * distance
    chords = limit / (EARTH_M * EARTH_M) * (1.0 + 1e-6) + 1e-15
    near = met.where((_squared_chords() <= F.lit(chords)) & (squared_distance() <= F.lit(limit)))
    return near.select(*queries.columns, *others.columns, squared_distance().alias("d2"))


def geo_pairs(places: DataFrame, distance: float) -> DataFrame:
    """Ordered pairs of sites with ``dH^2 + dW^2 <= 2 distance^2`` (metres).

    ``n`` and ``o_n`` users stand behind the two sides, so a row covers
    ``n * o_n`` user pairs; a site meets itself at distance 0.
    """
    sites = sites_of(places)
    return _within(sites, sites, distance)


def geo_pairs_rms(places: DataFrame, distance_km: float) -> DataFrame:
    """The same join by root-mean-square distance in kilometres."""
    sites = sites_of(places)
    met = _within(sites, sites, distance_km * 1000.0 * (1.0 + 1e-9))
    rms = rms_distance(_leg("h", EARTH_KM), _leg("w", EARTH_KM))
    return met.withColumn("dist_km", rms).where(F.col("dist_km") <= distance_km).drop("d2")


def _nearest(queries: DataFrame, sites: DataFrame, distance: float, keep: int) -> DataFrame:
    """The ``keep`` nearest users of each query site, itself included, as ``near``.

    The ``keep`` nearest sites (by distance, then smallest member) already hold
    them, so members are unfolded only after that cut.
    """
    order = W.partitionBy(*PLACE).orderBy("d2", F.get("o_ids", F.lit(0)))
    met = _within(queries, sites, distance).select(*PLACE, "d2", "o_ids")
    first = met.withColumn("r", F.row_number().over(order)).where(F.col("r") <= keep)
    lists = first.groupBy(*PLACE).agg(F.collect_list(F.struct("d2", "o_ids")).alias("m"))
    flat = F.flatten(F.transform("m", lambda s: F.transform(
        s["o_ids"], lambda v: F.struct(s["d2"].alias("d2"), v.alias("v")))))
    return lists.select(*PLACE, F.slice(F.array_sort(flat), 1, keep).alias("near"))


def _radii(sites: DataFrame, distance: float, keep: int) -> list[float]:
    """Radii to try, smallest first, chosen by the fullest cell of the grid."""
    radii = [float(distance)]
    for _ in range(SHRINKS):
        cells = _Grid(math.sqrt(2.0) * radii[0]).own(sites, PLACE).groupBy(*CELL)
        fullest = cells.agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        if (fullest or 0) <= DENSE * keep:
            break
        radii.insert(0, radii[0] / 2.0)
    return radii


def _neighbor_lists(places: DataFrame, distance: float, k: int) -> DataFrame:
    """(u, near) with the user's up to ``k`` nearest others within ``distance``."""
    first = W.partitionBy(*PLACE).orderBy("u")
    members = places.select("u", *PLACE).withColumn("r", F.row_number().over(first))
    sites = cut(members.where(F.col("r") <= k + 1).groupBy(*PLACE).agg(
        F.array_sort(F.collect_list("u")).alias("ids")))
    radii = _radii(sites, distance, k + 1)
    todo, found = sites.select(*PLACE), None
    for radius in radii:
        near = _nearest(todo, sites, radius, k + 1)
        if radius != radii[-1]:
            near = cut(near.where(F.size("near") == k + 1))
            todo = cut(todo.join(near, PLACE, "left_anti"))
        found = near if found is None else found.unionByName(near)
    others = F.filter("near", lambda p: p["v"] != F.col("u"))
    return places.join(found, PLACE).select("u", F.slice(others, 1, k).alias("near"))


def geo_knn(places: DataFrame, distance: float, k: int) -> DataFrame:
    """Edges (src, dst, d2, rank) to the ``k`` nearest users within ``distance``
    metres, ranked by (d2, dst).

    Sites whose list fills up inside a small radius are finished there; only the
    others look further, so dense areas do not produce all their pairs.
    """
    lists = _neighbor_lists(places, distance, k)
    return lists.select(F.col("u").alias("src"), F.posexplode("near").alias("p", "e")).select(
        "src", F.col("e.v").alias("dst"), F.col("e.d2").alias("d2"), (F.col("p") + 1).alias("rank"))


def geo_edges(places: DataFrame, distance: float, k: int) -> DataFrame:
    """Nearest-neighbour edges with similarity ``exp(-sqrt(d2) / distance)``,
    scaled to sum to one per user. The sum is taken inside the list."""
    def weight(p):
        return F.exp(-F.sqrt(p["d2"]) / F.lit(float(distance)))

    total = F.aggregate("near", F.lit(0.0), lambda acc, p: acc + weight(p))
    lists = _neighbor_lists(places, distance, k).withColumn("total", total)
    edges = lists.select(F.col("u").alias("src"), "total", F.explode("near").alias("e"))
    return edges.select("src", F.col("e.v").alias("dst"),
                        (weight(F.col("e")) / F.col("total")).alias("score"))


def softmax_edges(edges: DataFrame, distance: float) -> DataFrame:
    """Similarity of given edges (src, dst, d2), scaled by ``distance``."""
    w = F.exp(-F.sqrt("d2") / F.lit(float(distance)))
    total = F.sum("w").over(W.partitionBy("src"))
    return edges.withColumn("w", w).select("src", "dst", (F.col("w") / total).alias("score"))


def friend_weights(edges: DataFrame) -> DataFrame:
    """Weights ``exp(-dist_km)`` of given edges, scaled to sum to one per user."""
    total = F.sum("w").over(W.partitionBy("src"))
    return edges.withColumn("w", F.exp(-F.col("dist_km"))).select(
        "src", "dst", (F.col("w") / total).alias("score"))


def distance_graph(places: DataFrame, k: int = 10, distance_km: float = STEPS * STEP_KM) -> DataFrame:
    """Edges (src, dst, dist_km, rank); every smaller graph is a filter on it."""
    km = F.sqrt(F.col("d2") / F.lit(2.0)) / F.lit(1000.0)
    return geo_knn(places, distance_km * 1000.0, k).select(
        "src", "dst", km.alias("dist_km"), "rank")


def graph_at(graph: DataFrame, k: int, distance_km: float) -> DataFrame:
    return graph.where((F.col("rank") <= k) & (F.col("dist_km") <= distance_km))


def with_step(graph: DataFrame, steps: int = STEPS, width: float = STEP_KM) -> DataFrame:
    """Number of the first threshold ``step * width`` that admits the edge."""
    beyond = F.lit(1)
    for i in range(1, steps):
        beyond = beyond + (F.col("dist_km") > i * width).cast("int")
    return graph.where(F.col("dist_km") <= steps * width).withColumn("step", beyond)


def _grid_of(low_k, low_step, high_step, k: int, steps: int):
    return (F.explode(F.sequence(low_k, F.lit(k))),
            F.explode(F.sequence(low_step, high_step)))


def graph_sweep(graph: DataFrame, k: int = 10, steps: int = STEPS, width: float = STEP_KM) -> DataFrame:
    """Edges and connected users of every graph (k, step) of the sweep.

    The edges are counted once by (rank, step); the sweep adds up those counts.
    """
    counts = with_step(graph, steps, width).groupBy("rank", "step").agg(
        F.count(F.lit(1)).alias("n"), F.sum("dist_km").alias("s"))
    ks, ds = _grid_of(F.col("rank"), F.col("step"), F.lit(steps), k, steps)
    spread = counts.where(F.col("rank") <= k).withColumn("k", ks).withColumn("d_step", ds)
    return spread.groupBy("k", "d_step").agg(
        F.sum("n").alias("edges"),
        F.sum(F.when(F.col("rank") == 1, F.col("n")).otherwise(0)).alias("users"),
        (F.sum("s") / F.sum("n")).alias("mean_km"),
    )


def neighbor_coverage(graph: DataFrame, users: DataFrame, k: int = 10, steps: int = STEPS,
                      width: float = STEP_KM) -> DataFrame:
    """Users with at least k friends within each distance, and their share of all."""
    counts = with_step(graph, steps, width).groupBy("rank", "step").agg(
        F.count(F.lit(1)).alias("n"))
    spread = counts.where(F.col("rank") <= k).withColumn(
        "d_step", F.explode(F.sequence(F.col("step"), F.lit(steps))))
    total = users.agg(F.count(F.lit(1))).scalar()
    return spread.groupBy(F.col("rank").alias("k"), "d_step").agg(
        F.sum("n").alias("users")).withColumn("share", F.col("users") / total)


def edge_overlap(edges: DataFrame, usage: DataFrame, mode: str = "any") -> DataFrame:
    """Add ``cover``: do both users share a device (``any``), or what share of the
    source's devices the other one has too (``ratio``).

    Edges whose ends have no usage drop out. ``usage`` holds distinct (u, d). A user's devices travel as one list:
    an edge meets two lists and is not multiplied by the devices of its source.
    """
    lists = usage.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.collect_list("d").alias("ds"))
    src, dst = (lists.select(F.col("u").alias(c), F.col("n").alias(f"n_{c}"), F.col("ds").alias(f"ds_{c}"))
                for c in ("src", "dst"))
    shared = F.size(F.array_intersect("ds_src", "ds_dst"))
    met = edges.join(dst, "dst").join(src, "src").select(*edges.columns, "n_src", shared.alias("shared"))
    # An edge given several times counts its devices as often.
    hits = F.col("shared") * F.count(F.lit(1)).over(W.partitionBy("src", "dst"))
    cover = (hits > 0).cast("double") if mode == "any" else hits / F.col("n_src")
    return met.withColumn("cover", cover).drop("n_src", "shared")


def neighbor_overlap(graph: DataFrame, usage: DataFrame, k: int = 10, steps: int = STEPS,
                     width: float = STEP_KM, mode: str = "any") -> DataFrame:
    """For every (k, step): mean over users of the mean cover of their neighbours.

    A user's neighbours at (k, d) are a prefix of its ranked list, so one running
    mean per edge answers all graphs; what remains are counts by (rank, step).
    """
    covered = with_step(edge_overlap(graph, usage, mode), steps, width)
    w = W.partitionBy("src").orderBy("rank")
    running = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    prefix = covered.withColumn("place", F.row_number().over(w)).select(
        "rank", "step", F.avg("cover").over(running).alias("mean"),
        F.coalesce(F.lead("rank").over(w), F.lit(k + 1)).alias("next_rank"),
        F.coalesce(F.lead("step").over(w), F.lit(steps + 1)).alias("next_step"))
    counts = prefix.where(F.col("rank") <= k).groupBy(
        "rank", "step", "next_rank", "next_step").agg(
        F.sum("mean").alias("s"), F.count(F.lit(1)).alias("n"))
    ks, ds = _grid_of(F.col("rank"), F.col("step"), F.lit(steps), k, steps)
    # This prefix is the user's list while k is below the next rank or the
    # distance below the next step.
    holds = (F.col("k") < F.col("next_rank")) | (F.col("d_step") < F.col("next_step"))
    spread = counts.withColumn("k", ks).withColumn("d_step", ds).where(holds)
    return spread.groupBy("k", "d_step").agg(
        (F.sum("s") / F.sum("n")).alias("overlap"), F.sum("n").alias("users"))


def item_list_overlap(usage: DataFrame, order: list[Column], k: int = 10,
                      normalize: bool = False) -> DataFrame:
    """Baseline: mean over users of the hits of one fixed item list, for k = 1, 2, ...

    ``order`` ranks the items (columns d and users). Each hit counts 0.1, or
    ``1/k`` with ``normalize``. Only the item counts are needed.
    """
    items = usage.groupBy("d").agg(F.count(F.lit(1)).alias("users"))
    top = items.orderBy(*order).limit(k)
    ranked = top.withColumn("k", F.row_number().over(W.orderBy(*order)))
    total = usage.agg(F.countDistinct("u")).scalar()
    hits = F.sum("users").over(W.orderBy("k").rowsBetween(W.unboundedPreceding, W.currentRow))
    unit = F.lit(1.0) / F.col("k") if normalize else F.lit(0.1)
    return ranked.select("k", (hits * unit / total).alias("overlap"))
