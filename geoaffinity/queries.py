"""Named queries: each operator over the given tables, with fixed column types.

Doubles are rounded so that sums taken in another order compare equal.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from geoaffinity import fixtures as fx
from geoaffinity import functions as fn
from geoaffinity import sources
from geoaffinity.operators import als, catalog, evaluate, factor, geograph, itemcf, places
from geoaffinity.operators import sampling, splits, usage
from geoaffinity.plans import programs
from geoaffinity.runtime import cut, scratch_path

Query = Callable[[SparkSession, str], DataFrame]

RATE = 0.9        # coverage of the device catalogue
WIDTH = 500.0     # kernel width in metres
NEAR = 1000.0     # graph radius in metres
RANK = 8          # factor length of the single-step queries
FOLDS = 10        # repeats of the row-level split, the recommenders and the models
WEEK = ("20240108", "20240114")  # read back by pruning

QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def shape(df: DataFrame, **columns) -> DataFrame:
    """Select columns in order: an int rounds a double, text is a type to cast to."""
    out = []
    for name, rule in columns.items():
        c = F.col(name)
        out.append((F.round(c, rule) if isinstance(rule, int) else c.cast(rule)).alias(name))
    return df.select(*out)


# ---- sighting log -----------------------------------------------------------

def _cells(spark, sf):
    return sources.cell_dimension(fx.raw_cells(spark, sf))


def _devices(spark, sf):
    return sources.device_dimension(fx.raw_devices(spark, sf))


def _clean(spark, sf):
    return programs.clean_log(fx.sightings(spark, sf), _cells(spark, sf), _devices(spark, sf),
                              fx.DAYS)


def _context(spark, sf):
    clean = _clean(spark, sf)
    return usage.context_sightings(clean.valid, _cells(spark, sf))


def _days(spark, sf):
    return usage.device_days(_clean(spark, sf).named)


def _history(spark, sf):
    return usage.device_history(_days(spark, sf))


def _numbered(spark, sf):
    return programs.number_usage(_history(spark, sf), RATE)


@query
def scan_sightings(spark, sf):
    """Write the log as delimited text, scan it back with the fixed schema."""
    path = scratch_path(spark, "sightings")
    sources.write_text(fx.sightings(spark, sf), "sightings", path)
    return shape(sources.read_sightings(spark, f"{path}/*.csv"),
                 second="bigint", user="bigint", imei="string", cell="string")


# ---- tables handed from program to program -----------------------------------

def _text(spark, df, table):
    """Written as delimited text, read back with the fixed schema."""
    path = scratch_path(spark, table)
    sources.write_text(df, table, path)
    return sources.well_formed(sources.read_text(spark, table, f"{path}/*.csv"))


def _parquet(spark, df, name, *by):
    path = scratch_path(spark, name)
    sources.write_partitioned(df, path, *by)
    return spark.read.schema(df.schema).parquet(path)


@query
def records_by_shard(spark, sf):
    """Four parts of the log, written by all tasks; read back, each file is a shard of one part."""
    path, log = scratch_path(spark, "shards"), fx.sightings(spark, sf)
    for k in range(4):
        sources.write_text(log.where(F.pmod("second", F.lit(4)) == k), "sightings", f"{path}/{k}")
    scan = cut(sources.read_sightings(spark, f"{path}/*/*.csv"))
    valid = usage.valid_sightings(scan, _cells(spark, sf), _devices(spark, sf), fx.DAYS)
    names = scan.groupBy("shard").agg(F.min(F.pmod("second", F.lit(4))).alias("part"))
    files = usage.records_by_shard(scan, valid).join(names, "shard")
    return shape(files.groupBy("part").agg(F.sum("records").alias("records"), F.sum("kept").alias("kept")),
                 part="bigint", records="bigint", kept="bigint")


@query
def file_valid_sightings(spark, sf):
    """Valid sightings in folders by day, all read back."""
    return shape(_parquet(spark, _clean(spark, sf).valid, "valid", "day"),
                 second="bigint", user="bigint", tac="string", cell="string", day="string")


@query
def file_valid_sightings_pruned(spark, sf):
    """A week of them: the scan lists only the folders of its days."""
    stored = _parquet(spark, _clean(spark, sf).valid, "valid", "day")
    return shape(stored.where(F.col("day").between(*WEEK)), second="bigint", user="bigint",
                 tac="string", cell="string", day="string")


@query
def file_position_counts(spark, sf):
    """One text file set for each place type, positions as ``lat#lng``."""
    counts, parts = cut(_counts(spark, sf)), []
    for kind in ("home", "work"):
        rows = counts.where(F.col("place_type") == kind).withColumn(
            "position", sources.position_text("lat", "lng"))
        back = _text(spark, rows, "position_counts")
        parts.append(back.select(F.lit(kind).alias("place_type"), "user", "cnt",
                                 *sources.parse_position("position", ["lat", "lng"])))
    return shape(parts[0].unionByName(parts[1]), place_type="string", user="bigint", lat=6, lng=6,
                 cnt="bigint")


@query
def file_device_history(spark, sf):
    return shape(_text(spark, _history(spark, sf), "device_history"), user="bigint", btime="bigint",
                 device="string")


@query
def file_visits_hist(spark, sf):
    """A count file: how many users have how many home sightings."""
    return _visits_file(spark, sf, "home")


@query
def file_work_visits_hist(spark, sf):
    return _visits_file(spark, sf, "work")


def _visits_file(spark, sf, kind):
    hist = places.visits_hist(_counts(spark, sf)).where(F.col("place_type") == kind)
    return shape(_text(spark, hist, "histogram"), value="bigint", cnt="bigint")


@query
def file_numbered_devices(spark, sf):
    return shape(_text(spark, _numbered(spark, sf).devices, "numbered_devices"), device="string", d="bigint")


@query
def file_numbered_users(spark, sf):
    return shape(_text(spark, _numbered(spark, sf).users, "numbered_users"), user="bigint", u="bigint")


@query
def file_numbered_usage(spark, sf):
    return shape(_text(spark, _numbered(spark, sf).fact, "numbered_usage"), date="string", u="bigint",
                 d="bigint")


@query
def file_train_test(spark, sf):
    """Train and test usage in a folder each."""
    return shape(_parquet(spark, _time_split(spark, sf), "split", "part"), date="string", u="bigint",
                 d="bigint", part="string")


@query
def file_semantic_places(spark, sf):
    """Home places as text, positions as ``lat#lng``."""
    return _places_file(spark, sf, "home")


@query
def file_work_places(spark, sf):
    return _places_file(spark, sf, "work")


def _places_file(spark, sf, kind):
    rows = _semantic(spark, sf).where(F.col("place_type") == kind).withColumn(
        "position", sources.position_text("lat", "lng"))
    back = _text(spark, rows, "semantic_places")
    return shape(back.select("user", *sources.parse_position("position", ["lat", "lng"])), user="bigint",
                 lat=6, lng=6)


@query
def file_numbered_places(spark, sf):
    """Home and work of numbered users as one ``#``-joined text."""
    corners = ["hlat", "hlng", "wlat", "wlng"]
    wide = places.user_places(_semantic(spark, sf), _numbered(spark, sf).users).withColumn(
        "positions", sources.position_text(*corners))
    back = _text(spark, wide, "numbered_places")
    return shape(back.select("u", *sources.parse_position("positions", corners)), u="bigint",
                 **{c: 6 for c in corners})


@query
def dim_cells(spark, sf):
    return shape(_cells(spark, sf), cell="string", lat=6, lng=6)


@query
def dim_devices(spark, sf):
    return shape(_devices(spark, sf), tac="string", device="string")


@query
def valid_sightings(spark, sf):
    return shape(_clean(spark, sf).valid, second="bigint", user="bigint", tac="string",
                 cell="string", day="string")


CONTEXT = dict(second="bigint", user="bigint", tac="string", hour="bigint", wday="bigint",
               lat=6, lng=6)


@query
def context_sightings(spark, sf):
    return shape(_context(spark, sf), **CONTEXT)


@query
def home_sightings(spark, sf):
    return shape(usage.home_sightings(_context(spark, sf)), **CONTEXT)


@query
def work_sightings(spark, sf):
    return shape(usage.work_sightings(_context(spark, sf)), **CONTEXT)


@query
def log_profile(spark, sf):
    return _clean(spark, sf).profile


@query
def valid_by_day(spark, sf):
    return usage.valid_by_day(_clean(spark, sf).valid)


@query
def device_days(spark, sf):
    return shape(_days(spark, sf), user="bigint", day="string", btime="bigint", device="string",
                 n="bigint")


HISTORY = dict(user="bigint", seq="bigint", btime="bigint", device="string", runs="bigint")


@query
def device_history(spark, sf):
    return shape(_history(spark, sf), **HISTORY)


@query
def usage_runs(spark, sf):
    return shape(usage.usage_runs(_days(spark, sf)), user="bigint", btime="bigint",
                 device="string")


@query
def usage_profile(spark, sf):
    return usage.usage_profile(_history(spark, sf))


@query
def usage_days(spark, sf):
    return usage.usage_days(_history(spark, sf))


@query
def distinct_devices(spark, sf):
    return shape(usage.distinct_devices(_history(spark, sf)), user="bigint", device="string")


@query
def devices_per_user_hist(spark, sf):
    return usage.devices_per_user_hist(_history(spark, sf))


@query
def users_per_device(spark, sf):
    return usage.users_per_device(_history(spark, sf))


@query
def abnormal_users(spark, sf):
    return shape(catalog.abnormal_users(_history(spark, sf)), user="bigint", runs="bigint")


@query
def normal_usage(spark, sf):
    return shape(catalog.normal_usage(_history(spark, sf)), **HISTORY)


@query
def device_popularity(spark, sf):
    return catalog.device_popularity(catalog.normal_usage(_history(spark, sf)))


@query
def coverage_devices(spark, sf):
    kept = catalog.normal_usage(_history(spark, sf))
    return shape(catalog.coverage_devices(kept, RATE), device="string", cnt="bigint",
                 prefix="bigint", d="bigint")


@query
def records_per_user_hist(spark, sf):
    kept = catalog.normal_usage(_history(spark, sf))
    covered = catalog.covered_usage(kept, catalog.coverage_devices(kept, RATE))
    return catalog.records_per_user_hist(covered)


@query
def numbered_users(spark, sf):
    return shape(_numbered(spark, sf).users, user="bigint", u="bigint")


@query
def numbered_usage(spark, sf):
    return shape(_numbered(spark, sf).fact, date="string", u="bigint", d="bigint")


# ---- places -----------------------------------------------------------------

def _counts(spark, sf):
    return _clean(spark, sf).positions


COUNTS = dict(place_type="string", user="bigint", lat=6, lng=6, cnt="bigint")


@query
def position_counts(spark, sf):
    return shape(_counts(spark, sf), **COUNTS)


@query
def position_counts_bbox(spark, sf):
    return shape(places.in_area(_counts(spark, sf)), **COUNTS)


@query
def visits_hist(spark, sf):
    return shape(places.visits_hist(_counts(spark, sf)), place_type="string", value="bigint",
                 cnt="bigint")


@query
def places_hist(spark, sf):
    return shape(places.places_hist(_counts(spark, sf)), place_type="string", value="bigint",
                 cnt="bigint")


@query
def place_density(spark, sf):
    return shape(places.place_density(places.in_area(_counts(spark, sf)), WIDTH),
                 place_type="string", user="bigint", lat=6, lng=6, cnt="bigint", density=9)


@query
def place_neighbors(spark, sf):
    """Positions within the kernel width of each user's most visited position."""
    counts = places.in_area(_counts(spark, sf))
    top = F.min(F.struct((-F.col("cnt")).alias("k"), F.col("lat").alias("clat"),
                         F.col("lng").alias("clng"))).alias("b")
    centers = counts.groupBy("place_type", "user").agg(top).select(
        "place_type", "user", "b.clat", "b.clng")
    return shape(places.place_neighbors(centers, counts, WIDTH), place_type="string",
                 user="bigint", lat=6, lng=6, cnt="bigint", dist_m=3)


def _semantic(spark, sf):
    return places.semantic_place(places.in_area(_counts(spark, sf)), WIDTH)


@query
def semantic_place(spark, sf):
    return shape(_semantic(spark, sf), place_type="string", user="bigint", lat=6, lng=6,
                 steps="bigint")


@query
def user_places(spark, sf):
    wide = places.user_places(_semantic(spark, sf), _numbered(spark, sf).users)
    return shape(wide, u="bigint", hlat=6, hlng=6, wlat=6, wlng=6)


@query
def place_graph(spark, sf):
    """The whole way from sightings to the distance graph of named users."""
    numbered = _numbered(spark, sf)
    graph = programs.place_graph(_counts(spark, sf), WIDTH, numbered.users)
    return shape(graph, src="bigint", dst="bigint", dist_km=6, rank="bigint")


# ---- user graph -------------------------------------------------------------

PAIR = dict(hlat=6, hlng=6, wlat=6, wlng=6, n="bigint",
            o_hlat=6, o_hlng=6, o_wlat=6, o_wlng=6, o_n="bigint")


@query
def haversine_pairs(spark, sf):
    """Home-to-work distance of every user in metres and kilometres."""
    legs = [F.col(c) for c in ("hlat", "hlng", "wlat", "wlng")]
    df = fx.places(spark, sf).withColumn("dist_m", fn.haversine(*legs)).withColumn(
        "dist_km", fn.haversine(*legs, fn.EARTH_KM))
    return shape(df, u="bigint", dist_m=3, dist_km=6)


@query
def grid_cells(spark, sf):
    cells = geograph.grid_cells(fx.places(spark, sf), NEAR)
    return shape(cells, u="bigint", **{c: "bigint" for c in geograph.CELL})


@query
def grid_expand(spark, sf):
    cells = geograph.grid_cells(fx.places(spark, sf), NEAR)
    return shape(geograph.grid_expand(cells, "hc_lat", "hc_lng"),
                 u="bigint", hc_lat="bigint", hc_lng="bigint")


@query
def geo_pairs(spark, sf):
    return shape(geograph.geo_pairs(fx.places(spark, sf), NEAR), **PAIR, d2=2)


@query
def geo_pairs_rms(spark, sf):
    return shape(geograph.geo_pairs_rms(fx.places(spark, sf), NEAR / 1000.0), **PAIR, dist_km=6)


@query
def geo_knn(spark, sf):
    return shape(geograph.geo_knn(fx.places(spark, sf), NEAR, 10), src="bigint", dst="bigint",
                 d2=2, rank="bigint")


@query
def geo_edges(spark, sf):
    return shape(geograph.geo_edges(fx.places(spark, sf), NEAR, 10), src="bigint", dst="bigint",
                 score=6)


def _graph(spark, sf):
    return geograph.distance_graph(fx.places(spark, sf))


@query
def distance_graph(spark, sf):
    return shape(_graph(spark, sf), src="bigint", dst="bigint", dist_km=6, rank="bigint")


@query
def softmax_edges(spark, sf):
    edges = geograph.geo_knn(fx.places(spark, sf), NEAR, 10)
    return shape(geograph.softmax_edges(edges, NEAR), src="bigint", dst="bigint", score=6)


@query
def friend_weights(spark, sf):
    return shape(geograph.friend_weights(_graph(spark, sf)), src="bigint", dst="bigint", score=6)


@query
def graph_sweep(spark, sf):
    return shape(geograph.graph_sweep(_graph(spark, sf)), k="bigint", d_step="bigint",
                 edges="bigint", users="bigint", mean_km=6)


@query
def neighbor_coverage(spark, sf):
    return shape(geograph.neighbor_coverage(_graph(spark, sf), fx.places(spark, sf)),
                 k="bigint", d_step="bigint", users="bigint", share=6)


@query
def neighbor_overlap(spark, sf):
    used = fx.interactions(spark, sf).select("u", "d")
    return shape(geograph.neighbor_overlap(_graph(spark, sf), used), k="bigint",
                 d_step="bigint", overlap=6, users="bigint")


@query
def neighbor_overlap_ratio(spark, sf):
    used = fx.interactions(spark, sf).select("u", "d")
    return shape(geograph.neighbor_overlap(_graph(spark, sf), used, mode="ratio"), k="bigint",
                 d_step="bigint", overlap=6, users="bigint")


@query
def popular_overlap(spark, sf):
    used = fx.interactions(spark, sf).select("u", "d")
    order = [F.desc("users"), F.asc("d")]
    return shape(geograph.item_list_overlap(used, order), k="bigint", overlap=6)


@query
def random_overlap(spark, sf):
    used = fx.interactions(spark, sf).select("u", "d")
    order = [fn.hash_uniform(splits.SEED, F.col("d")).asc(), F.asc("d")]
    return shape(geograph.item_list_overlap(used, order), k="bigint", overlap=6)


# ---- splits and samples -----------------------------------------------------

@query
def train_interactions(spark, sf):
    return shape(fx.interactions(spark, sf), u="bigint", d="bigint", x="bigint")


def _time_split(spark, sf):
    return splits.time_split(fx.numbered_items(spark, sf), fx.TRAIN, fx.TEST)


@query
def time_split(spark, sf):
    return shape(_time_split(spark, sf), date="string", u="bigint", d="bigint", part="string")


@query
def split_profile(spark, sf):
    return shape(splits.split_profile(_time_split(spark, sf)), part="string", records="bigint",
                 users="bigint", items="bigint", days="bigint")


@query
def changed_users(spark, sf):
    split = _time_split(spark, sf)
    truth = splits.changed_users(split.where(F.col("part") == "train"),
                                 split.where(F.col("part") == "test"))
    return shape(truth, u="bigint", d="bigint")


SPLIT = dict(fold="bigint", u="bigint", d="bigint", part="string")


@query
def stratified_split(spark, sf):
    data = fx.interactions(spark, sf, FOLDS)
    return shape(splits.stratified_split(data), **SPLIT)


def _samples(spark, sf, times=1, mode="exact", folds=1):
    data = cut(fx.interactions(spark, sf, folds))
    return sampling.add_negatives(data, data.select("d").distinct(), times, mode)


SAMPLE = dict(fold="bigint", u="bigint", d="bigint", x="bigint")


@query
def stratified_split_labels(spark, sf):
    data = cut(_samples(spark, sf))
    return shape(splits.stratified_split(data, by_label=True), **SAMPLE, part="string")


@query
def negatives_sampled(spark, sf):
    return shape(_samples(spark, sf, 2), **SAMPLE)


@query
def negatives_bernoulli(spark, sf):
    return shape(_samples(spark, sf, 1, "bernoulli"), **SAMPLE)


@query
def negatives_all(spark, sf):
    """All unused items of every user, counted and summed instead of listed."""
    data = cut(fx.interactions(spark, sf))
    return shape(sampling.unused_counts(data, data.select("d")), fold="bigint", u="bigint",
                 unused="bigint", unused_sum="bigint")


@query
def sample_profile(spark, sf):
    return splits.sample_profile(_samples(spark, sf))


@query
def rank_triples(spark, sf):
    """Used-unused comparisons of every user, summed up per used item."""
    return shape(sampling.rank_sample_counts(_samples(spark, sf)), u="bigint", i="bigint",
                 unused="bigint", unused_sum="bigint")


@query
def popularity_weight(spark, sf):
    weights = factor.popularity_weight(fx.interactions(spark, sf))
    return shape(weights, d="bigint", n="bigint", w=9)


@query
def activity_scores(spark, sf):
    data = fx.interactions(spark, sf)
    items = itemcf.item_activity(data).select(F.lit("item").alias("kind"), F.col("d").alias("id"),
                                              "cnt", "w")
    users = itemcf.user_activity(data).select(F.lit("user").alias("kind"), F.col("u").alias("id"),
                                              "cnt", "w")
    return shape(items.unionByName(users), kind="string", id="bigint", cnt="bigint", w=9)


# ---- recommenders and evaluation --------------------------------------------

@query
def popular_items(spark, sf):
    return shape(itemcf.popular_items(fx.interactions(spark, sf), 20), d="bigint", cnt="bigint",
                 rank="bigint")


def _parts(spark, sf, folds=FOLDS):
    split = cut(splits.stratified_split(fx.interactions(spark, sf, folds)))
    return (split.where(F.col("part") == "train").select("fold", "u", "d"),
            split.where(F.col("part") == "valid").select("fold", "u", "d"))


@query
def item_pair_sim(spark, sf):
    return shape(itemcf.item_pair_sim(fx.interactions(spark, sf)), i="bigint", j="bigint", sim=6)


@query
def item_top10(spark, sf):
    similar = itemcf.item_pair_sim(fx.interactions(spark, sf))
    return shape(itemcf.item_top(similar, 10), i="bigint", j="bigint", sim=6, rank="bigint")


@query
def itemcf_scores(spark, sf):
    train, _ = _parts(spark, sf, 1)
    top = itemcf.item_top(itemcf.item_pair_sim(train), 10)
    return shape(itemcf.itemcf_scores(train, top), u="bigint", d="bigint", score=6)


@query
def itemcf_topn(spark, sf):
    train, _ = _parts(spark, sf, 1)
    return shape(itemcf.itemcf_topn(train), u="bigint", d="bigint", rank="bigint")


METRIC = dict(fold="bigint", k="bigint", users="bigint", precision=6, recall=6, f1=6)


@query
def precision_recall_at_k(spark, sf):
    """Item-item lists against the held-out rows of each fold."""
    return shape(programs.item_model(fx.interactions(spark, sf, FOLDS)), **METRIC)


@query
def popular_metrics(spark, sf):
    return shape(programs.popular_model(fx.interactions(spark, sf, FOLDS)), **METRIC)


@query
def cv_metrics(spark, sf):
    """Ten repeats of the popular recommender."""
    metrics = evaluate.cv_metrics(programs.popular_model(fx.interactions(spark, sf, 10)))
    return shape(metrics, k="bigint", precision=6, recall=6, f1=6)


# ---- vectors and single training steps --------------------------------------

def _vector_pairs(spark, sf):
    """Each embedding beside the next one by id."""
    v = fx.vectors(spark, sf)
    nxt = v.select((F.col("id") - 1).alias("id"), F.col("f").alias("g"))
    return v.join(nxt, "id")


@query
def vector_dot(spark, sf):
    df = _vector_pairs(spark, sf).withColumn("dot", fn.dot(F.col("f"), F.col("g")))
    return shape(df, id="bigint", dot=6)


def _elements(df, keys, column, name, digits=6):
    """One row per vector element."""
    return df.select(*[F.col(k).cast("bigint").alias(k) for k in keys],
                     F.posexplode(column).alias("i", "_v")).select(
        *keys, F.col("i").cast("bigint").alias("i"), F.round("_v", digits).alias(name))


@query
def vector_axpy(spark, sf):
    df = _vector_pairs(spark, sf).withColumn("h", fn.axpy(F.col("f"), F.col("g"), 2.0, -0.5))
    return _elements(df, ["id"], "h", "v")


@query
def vector_norm(spark, sf):
    df = fx.vectors(spark, sf)
    df = df.withColumn("norm", fn.norm(F.col("f"))).withColumn("norm2", fn.norm2(F.col("f")))
    df = df.withColumn("unit", fn.norm(fn.normalise(F.col("f")))).withColumn("rank", F.size("f"))
    return shape(df, id="bigint", norm=6, norm2=6, unit=6, rank="bigint")


def _factors(data):
    return factor.factor_init(data, "u", RANK), factor.factor_init(data, "d", RANK)


@query
def factor_init(spark, sf):
    return _elements(_factors(fx.interactions(spark, sf))[0], ["u"], "f", "v")


def _start(spark, sf):
    """Sampled data with the initial factors of all its users and items."""
    samples = cut(_samples(spark, sf))
    return samples, *[cut(f) for f in _factors(samples)]


@query
def predict_scores(spark, sf):
    return shape(factor.predict_scores(*_start(spark, sf), RANK), u="bigint", d="bigint",
                 x="bigint", z=6, y=6)


LOSS = dict(fold="bigint", loss=6, samples="bigint")


@query
def logloss(spark, sf):
    return shape(factor.mean_loss(*_start(spark, sf), RANK), **LOSS)


def _weighted(spark, sf):
    samples, users, items = _start(spark, sf)
    weights = factor.popularity_weight(samples.where(F.col("x") == 1))
    return factor.weigh_negatives(samples, weights), users, items


@query
def weighted_logloss(spark, sf):
    return shape(factor.mean_loss(*_weighted(spark, sf), RANK), **LOSS)


@query
def rank_loss(spark, sf):
    return shape(factor.rank_loss(*_start(spark, sf), RANK), fold="bigint", loss=6, pairs="bigint")


OPTIONS = factor.FitOptions(rank=RANK)


def _gradients(spark, sf):
    return factor.step_gradients(*_start(spark, sf), OPTIONS)


@query
def user_gradient(spark, sf):
    return _elements(_gradients(spark, sf)[0], ["u"], "g", "g")


@query
def item_gradient(spark, sf):
    return _elements(_gradients(spark, sf)[1], ["d"], "h", "g")


@query
def gradient_norm(spark, sf):
    return shape(factor.gradient_norm(*_gradients(spark, sf), RANK), fold="bigint", mp=6, mq=6)


@query
def rank_gradient(spark, sf):
    """User gradient of the pairwise loss."""
    users, _ = factor.step_gradients(*_start(spark, sf), OPTIONS, pairwise=True)
    return _elements(users, ["u"], "g", "g")


def _friends(spark, sf):
    return cut(geograph.friend_weights(_graph(spark, sf)))


@query
def graph_term(spark, sf):
    users, _ = _factors(fx.interactions(spark, sf))
    return _elements(factor.graph_term(_friends(spark, sf), users, RANK), ["u"], "m", "m")


@query
def mf_one_step(spark, sf):
    """User factors after one step of the logistic model."""
    step = factor.one_step(*_start(spark, sf), OPTIONS)
    return _elements(step.users, ["u"], "f", "v")


@query
def topn_by_factor(spark, sf):
    data = cut(fx.interactions(spark, sf))
    users, items = _factors(data)
    best = evaluate.topn_by_factor(users, items, data.select("fold", "u", "d"), 10)
    return shape(best, u="bigint", d="bigint", score=6, rank="bigint")


# ---- trained models -----------------------------------------------------------
# What a trained model returns depends on long sums, so these queries state facts about it that SQL can
# check: how many users, items and rows it stands for, and that nothing that must hold is broken. Models are
# trained with the defaults of the programs: rank 20, until the step is below tol or for 100 steps.

MODEL = factor.FitOptions()

FACTS = dict(fold="bigint", train_rows="bigint", valid_rows="bigint", users="bigint", items="bigint",
             truth_users="bigint", broken="bigint")


def _broken_steps(history, options=MODEL):
    """Per fold, steps after which the loss is higher than the accepted width allows, one more if training
    stopped before ``tol`` and before its last step, and one if it did not lower the loss."""
    bad, first, last = {}, {}, {}
    for h in history:
        worse = h["loss_after"] > h["loss"] - h["width"] * h["slope"] + 1e-12
        bad[h["fold"]] = bad.get(h["fold"], 0) + int(worse or h["loss_after"] != h["loss_after"])
        first.setdefault(h["fold"], h)
        last[h["fold"]] = h
    for fold, h in last.items():
        short = h["width"] * h["slope"] >= options.tol and h["step"] + 1 < options.max_iter
        bad[fold] += int(short) + int(not h["loss_after"] < first[fold]["loss"])
    return bad


def _facts(spark, split, users, items, metrics, broken):
    """Rows of the two parts, factors, users with new items, and broken promises of each fold: steps
    that failed their test, metrics outside 0..1, vectors that are not finite."""
    def per(df, name, key):
        return df.groupBy("fold").agg(F.count_distinct(key).alias(name))

    parts = split.groupBy("fold").agg(F.count_if(F.col("part") == "train").alias("train_rows"),
                                      F.count_if(F.col("part") == "valid").alias("valid_rows"))
    outside = ~(F.col("precision").between(0, 1) & F.col("recall").between(0, 1) & F.col("f1").between(0, 1))
    scores = metrics.groupBy("fold").agg(F.max("users").alias("truth_users"),
                                         (F.count_if(outside) + F.abs(F.count(F.lit(1)) - 10)).alias("b1"))
    odd = ~F.exists("f", lambda v: F.isnan(v) | v.isNull() | (F.abs(v) > 1e9))
    wild = users.select("fold", "f").unionByName(items.select("fold", "f")).groupBy("fold").agg(
        F.count_if(~odd).alias("b2"))
    steps = spark.createDataFrame([(int(f), int(n)) for f, n in broken.items()] or [(-1, 0)], "fold int, b3 int")
    out = (parts.join(per(users, "users", "u"), "fold").join(per(items, "items", "d"), "fold")
           .join(scores, "fold").join(wild, "fold").join(F.broadcast(steps), "fold", "left"))
    return shape(out.withColumn("broken", F.col("b1") + F.col("b2") + F.coalesce("b3", F.lit(0))), **FACTS)


def _trained(spark, trained: programs.Trained):
    return _facts(spark, trained.split, trained.model.users, trained.model.items, trained.metrics,
                  _broken_steps(trained.model.history))


@query
def train_logistic_mf(spark, sf):
    return _trained(spark, programs.logistic_model(fx.interactions(spark, sf, FOLDS), MODEL))


@query
def train_logistic_mf_neg(spark, sf):
    return _trained(spark, programs.logistic_model(fx.interactions(spark, sf, FOLDS), MODEL, times=1,
                                                   mode="bernoulli"))


@query
def train_weighted_mf(spark, sf):
    return _trained(spark, programs.weighted_model(fx.interactions(spark, sf, FOLDS), MODEL))


@query
def train_bpr(spark, sf):
    return _trained(spark, programs.ranking_model(fx.interactions(spark, sf, FOLDS), MODEL))


@query
def train_graph_mf(spark, sf):
    return _trained(spark, programs.weighted_model(fx.interactions(spark, sf, FOLDS), MODEL,
                                                   edges=_friends(spark, sf)))


# Precision, recall and F1 at 1..10, means over ten repeats: of models trained to the end, which SQL does in a recursion,
# and of two steps of weighted and graph models, which SQL unrolls.
SHORT = factor.FitOptions(rank=RANK, max_iter=2)


def _means(trained):
    return shape(evaluate.cv_metrics(trained.metrics), k="bigint", precision=6, recall=6, f1=6)


@query
def metrics_logistic_mf(spark, sf):
    return _means(programs.logistic_model(fx.interactions(spark, sf, FOLDS), MODEL))


@query
def metrics_logistic_mf_neg(spark, sf):
    return _means(programs.logistic_model(fx.interactions(spark, sf, FOLDS), MODEL, times=1, mode="bernoulli"))


@query
def metrics_weighted_mf(spark, sf):
    return _means(programs.weighted_model(fx.interactions(spark, sf, FOLDS), SHORT))


@query
def metrics_bpr(spark, sf):
    return _means(programs.ranking_model(fx.interactions(spark, sf, FOLDS), MODEL))


@query
def metrics_graph_mf(spark, sf):
    return _means(programs.weighted_model(fx.interactions(spark, sf, FOLDS), SHORT, edges=_friends(spark, sf)))


@query
def als_metrics(spark, sf):
    """ALS lists against the held-out rows, means over ten repeats."""
    return _means(programs.als_model(fx.interactions(spark, sf, FOLDS)))


def _errors(fitted):
    means = fitted.errors.groupBy("part").agg(F.avg("mse").alias("mse"), F.sum("rows").alias("rows"))
    return shape(means, part="string", mse=6, rows="bigint")


@query
def als_mse(spark, sf):
    """Squared errors by part, means over ten repeats."""
    return _errors(programs.als_model(fx.interactions(spark, sf, FOLDS)))


@query
def als_facts(spark, sf):
    fitted = programs.als_model(fx.interactions(spark, sf, FOLDS))
    return _facts(spark, fitted.split, fitted.users, fitted.items, fitted.metrics, {})


@query
def als_fits(spark, sf):
    """Rows of each part that have a prediction, and whether the training error beats a constant guess."""
    errors = programs.als_model(fx.interactions(spark, sf, FOLDS)).errors
    fits = (F.col("part") != "train") | (F.col("mse") < 0.25)
    return shape(errors.withColumn("fits", fits), fold="bigint", part="string", rows="bigint", fits="boolean")


def _als(spark, sf):
    train = cut(programs.labelled_samples(fx.interactions(spark, sf, FOLDS), 1).where(F.col("part") == "train").drop("part"))
    return train, als.fit_als(train)


@query
def als_topn(spark, sf):
    """Lists of the ten best unused items by ALS: their lengths, and used items in them (none)."""
    train, model = _als(spark, sf)
    used = train.where(F.col("x") == 1).select("fold", "u", "d")
    best = cut(evaluate.topn_by_factor(model.users, model.items, used))
    hits = best.join(used.withColumn("hit", F.lit(1)), ["fold", "u", "d"], "left")
    return shape(hits.groupBy("fold", "u").agg(F.count(F.lit(1)).alias("listed"), F.count("hit").alias("used")),
                 fold="bigint", u="bigint", listed="bigint", used="bigint")


@query
def train_als(spark, sf):
    """User factors solve their normal equations: a row per user with its samples and whether the
    residual is small. The regularisation counts each user's samples."""
    train, model = _als(spark, sf)
    rest = als.normal_residual(train, model.users, model.items, 0.01)
    return shape(rest.withColumn("solved", F.col("residual") < 1e-6 * F.col("rows")), fold="bigint", u="bigint",
                 rows="bigint", solved="boolean")


# Three iterations at rank 2, which SQL unrolls.
def _als_short(spark, sf):
    return programs.als_model(fx.interactions(spark, sf, FOLDS), rank=2, max_iter=3)


@query
def als_short_metrics(spark, sf):
    return _means(_als_short(spark, sf))


@query
def als_short_mse(spark, sf):
    return _errors(_als_short(spark, sf))


@query
def als_short_topn(spark, sf):
    """The lists themselves, of users with new items."""
    fitted = _als_short(spark, sf)
    return shape(fitted.lists, fold="bigint", u="bigint", d="bigint", rank="bigint")
