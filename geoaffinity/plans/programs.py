"""The batch programs end to end. Each takes and returns DataFrames; a caller
that wants tables on disk passes the result to ``geoaffinity.sources``."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from geoaffinity.operators import als, catalog, evaluate, factor, geograph, itemcf, places
from geoaffinity.operators import sampling, splits, usage
from geoaffinity.runtime import cut


@dataclass
class CleanLog:
    valid: DataFrame
    named: DataFrame
    profile: DataFrame
    positions: DataFrame


def clean_log(sightings: DataFrame, cells: DataFrame, devices: DataFrame,
              days: tuple[str, str] = usage.STUDY_DAYS, tz: str = "UTC",
              night: tuple[int, int] = usage.NIGHT, office: tuple[int, int] = usage.OFFICE) -> CleanLog:
    """Filter the raw log; profile it; count home and work positions."""
    valid = usage.valid_sightings(sightings, cells, devices, days, tz)
    named = usage.named_usage(valid, devices)
    context = usage.context_sightings(valid, cells, tz)
    return CleanLog(valid, named, usage.log_profile(named),
                    places.position_counts(usage.place_sightings(context, night, office)))


def device_changes(named: DataFrame) -> DataFrame:
    """Device-change history from named usage."""
    return usage.device_history(usage.device_days(named))


@dataclass
class NumberedUsage:
    devices: DataFrame
    users: DataFrame
    fact: DataFrame


def number_usage(history: DataFrame, rate: float, max_runs: int = 5,
                 tz: str = "UTC") -> NumberedUsage:
    """Normal users' usage of the devices covering ``rate`` of it, densely numbered."""
    kept = cut(catalog.normal_usage(history, max_runs))
    devices = cut(catalog.coverage_devices(kept, rate))
    covered = catalog.covered_usage(kept, devices)
    users = catalog.numbered_users(covered)
    return NumberedUsage(devices, users, catalog.numbered_usage(covered, users, devices, tz))


def place_graph(positions: DataFrame, h: float, users: DataFrame | None = None,
                k: int = 10, distance_km: float = 2.0) -> DataFrame:
    """From position counts to the distance graph of home and work places."""
    semantic = places.semantic_place(places.in_area(positions), h)
    where = cut(places.user_places(semantic, users))
    return geograph.distance_graph(where, k, distance_km)


def labelled_samples(interactions: DataFrame, times: int, mode: str = "exact") -> DataFrame:
    """Positives and sampled negatives, split by label into train and valid.

    Negatives are drawn before the split against all positives, so a held-out
    positive is never a negative.
    """
    items = interactions.select("d").distinct()
    samples = cut(sampling.add_negatives(interactions, items, times, mode))
    return cut(splits.stratified_split(samples, by_label=True))


def _lists(train: DataFrame, valid: DataFrame, model: factor.FactorModel, n: int) -> tuple[DataFrame, DataFrame]:
    """The new items of users, and the lists for these users."""
    known = train.where(F.col("x") == 1)
    truth = cut(splits.changed_users(known, valid.where(F.col("x") == 1)))
    asked = model.users.join(truth, ["fold", "u"], "left_semi")
    return truth, cut(evaluate.topn_by_factor(asked, model.items, known.select("fold", "u", "d"), n))


def _metrics(train: DataFrame, valid: DataFrame, model: factor.FactorModel, n: int) -> DataFrame:
    return evaluate.precision_recall_at_k(*_lists(train, valid, model, n), n)


def _parts(split: DataFrame) -> tuple[DataFrame, DataFrame]:
    return split.where(F.col("part") == "train"), split.where(F.col("part") == "valid")


def _both_classes(samples: DataFrame) -> DataFrame:
    users = samples.groupBy("fold", "u").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    return samples.join(users.where(F.col("lo") < F.col("hi")), ["fold", "u"], "left_semi")


@dataclass
class Trained:
    model: factor.FactorModel
    metrics: DataFrame
    split: DataFrame


@dataclass
class AlsTrained:
    """Squared errors by part, ranking metrics, lists, factors and the split behind them."""

    errors: DataFrame
    metrics: DataFrame
    lists: DataFrame
    users: DataFrame
    items: DataFrame
    split: DataFrame


def _train(split: DataFrame, options: factor.FitOptions, n: int, **kind) -> Trained:
    train, valid = _parts(split)
    model = factor.fit(train.drop("part"), options, watch=cut(valid.drop("part")), **kind)
    return Trained(model, _metrics(train, valid, model, n), split)


def logistic_model(interactions: DataFrame, options: factor.FitOptions, times: int = 0,
                   mode: str = "exact", n: int = 10) -> Trained:
    """Logistic factor model, on positives only or with sampled negatives."""
    return _train(labelled_samples(interactions, times, mode), options, n)


def weighted_model(interactions: DataFrame, options: factor.FitOptions, times: int = 1,
                   c0: float = 1.0, alpha: float = 0.5, edges: DataFrame | None = None,
                   n: int = 10, fit_on: str = "all") -> Trained:
    """Negatives weighted by item popularity; with ``edges`` also graph-regularised.

    The popularity is taken from all interactions, or from the training
    positives with ``fit_on="train"``.
    """
    split = labelled_samples(interactions, times)
    base = interactions
    if fit_on == "train":
        base = split.where((F.col("part") == "train") & (F.col("x") == 1))
    weights = factor.popularity_weight(base, c0, alpha)
    return _train(cut(factor.weigh_negatives(split, weights)), options, n, edges=edges)


def ranking_model(interactions: DataFrame, options: factor.FitOptions, times: int = 1,
                  n: int = 10) -> Trained:
    """Pairwise ranking; scored on users that have both classes in both parts."""
    train, valid = _parts(labelled_samples(interactions, times))
    train, valid = cut(_both_classes(train)), cut(_both_classes(valid))
    model = factor.fit(train.drop("part"), options, pairwise=True, watch=valid.drop("part"))
    return Trained(model, _metrics(train, valid, model, n), train.unionByName(valid))


def als_model(interactions: DataFrame, times: int = 1, rank: int = 20, reg: float = 0.01,
              max_iter: int = 30, n: int = 10) -> AlsTrained:
    """ALS, all folds in the same jobs; a catalogue too large for that goes through Spark ML, fold by fold."""
    split = labelled_samples(interactions, times)
    train, valid = _parts(split)
    model = als.fit_als(train.drop("part"), rank, reg, max_iter) or _als_by_fold(train, rank, reg, max_iter)
    truth, lists = _lists(train, valid, model, n)
    return AlsTrained(als.squared_errors(split, model, rank), evaluate.precision_recall_at_k(truth, lists, n), lists,
                      model.users, model.items, split)


def _als_by_fold(train: DataFrame, rank: int, reg: float, max_iter: int) -> factor.FactorModel:
    users, items = [], []
    for fold in [r.fold for r in train.select("fold").distinct().orderBy("fold").collect()]:
        model = als.train_als(train.where(F.col("fold") == fold), rank, reg, max_iter, seed=splits.SEED + fold)
        p, q = als.als_factors(model, fold)
        users.append(p)
        items.append(q)
    return factor.FactorModel(factor.union_all(users), factor.union_all(items))


def popular_model(interactions: DataFrame, alpha: float = 0.8, n: int = 10) -> DataFrame:
    """Everyone gets the same most popular items, used or not."""
    train, valid = _parts(cut(splits.stratified_split(interactions, alpha)))
    truth = cut(splits.changed_users(train, valid))
    top = itemcf.popular_items(train, n).select("fold", "d", "rank")
    lists = truth.select("fold", "u").distinct().join(F.broadcast(top), "fold")  # n rows per fold
    return evaluate.precision_recall_at_k(truth, lists, n)


def item_model(interactions: DataFrame, alpha: float = 0.8, n: int = 10) -> DataFrame:
    """Item-item lists with popular fill."""
    train, valid = _parts(cut(splits.stratified_split(interactions, alpha)))
    truth = cut(splits.changed_users(train, valid))
    return evaluate.precision_recall_at_k(truth, cut(itemcf.itemcf_topn(train, n)), n)
