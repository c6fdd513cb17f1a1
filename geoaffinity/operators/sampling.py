"""Negative sampling and rank samples without touching every user-item pair."""

import math
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import IntegralType

from geoaffinity.functions import hash_uniform
from geoaffinity.operators.splits import SEED, seed_of
from geoaffinity.runtime import CHUNK, chunk_count, chunk_of, cut, ordered_prefix

STRIDE = 4096  # positions of one piece of a long walk
LISTED = 1 << 16  # items up to which a user's used ones are one list, and its walk stays in the task that holds it
WALK = 1 << 18  # places walked at a time
TASK = 1 << 18  # samples of a task whose users' lists are gathered


def next_prime(n: int) -> int:
    """The smallest prime that is at least ``n`` (and at least 2)."""
    p = max(2, n)
    while any(p % f == 0 for f in range(2, int(p ** 0.5) + 1)):
        p += 1
    return p


def _numbered_items(items: DataFrame) -> tuple[int, DataFrame | None]:
    """Item count, and an (idx, d) table unless the ids are already 0..n-1."""
    size = items.agg(F.count_distinct("d").alias("n"), F.min("d").alias("lo"),
                     F.max("d").alias("hi")).first()
    if size.lo == 0 and size.hi == size.n - 1:
        return size.n, None
    numbered = ordered_prefix(items.select("d").distinct(), ["d"])
    return size.n, numbered.select(F.col("pos").alias("idx"), "d")


def add_negatives(positives: DataFrame, items: DataFrame, times: int,
                  mode: str = "exact") -> DataFrame:
    """Positives (x = 1) plus items the user has not used (x = 0).

    ``times = 0``: positives only. ``times = -1``: every unused item, as rows, which grow with
    users x items (``unused_counts`` keeps them factored). Otherwise,
    for a user with c positives and N unused items, ``exact`` gives
    ``min(times c, N)`` unused items without replacement; ``bernoulli`` draws each unused item
    independently with probability ``times c / N`` and keeps the first ``times c`` in item order
    (``bernoulli_draws``).

    In mode ``exact`` every user walks the items in a permutation of its own,
    ``(a j + b) mod P`` with P the first prime not below the item count and a, b
    hashed from the user. A walk of ``times c + c`` steps (plus the gap up to P)
    must meet enough unused items, so the work follows the positives and not
    users x items. With up to ``LISTED`` items a user's used ones travel as one list and the walk ends in
    its task; otherwise walks are rows, long ones cut into pieces of ``STRIDE`` steps.
    """
    keys = ["fold", "u"]
    base = positives.select(*keys, "d", F.lit(1).alias("x"))
    if times == 0:
        return base
    n, numbered = _numbered_items(items)
    want = F.col("c") * times
    if mode not in ("exact", "bernoulli"):
        raise ValueError(f"unknown mode {mode!r}")
    kind = positives.schema["d"].dataType
    if mode == "exact" and times > 0 and numbered is None and n <= LISTED and isinstance(kind, IntegralType):
        unused = _listed_walk(positives, n, times).withColumn("d", F.col("d").cast(kind))
        return base.unionByName(unused.select(*keys, "d", F.lit(0).alias("x")))
    users = positives.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"))
    if mode == "bernoulli" and times != -1:
        walk = bernoulli_draws(users, n, times).withColumn("steps", F.lit(n).cast("bigint"))
    else:
        walk = _permuted_walk(users, n, F.lit(next_prime(n)) if times == -1 else want + F.col("c") + (next_prime(n) - n))
    if numbered is None:
        walk = walk.withColumn("d", F.col("idx").cast(kind))
    else:
        walk = walk.join(numbered, "idx")
    unused = walk.join(positives.select(*keys, "d"), [*keys, "d"], "left_anti")
    if times != -1:
        order = "j" if mode == "exact" else "idx"
        unused = _first_of_walk(unused, keys, order, want)
    return base.unionByName(unused.select(*keys, "d", F.lit(0).alias("x")))


def _steps(n: int, times: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prime = next_prime(n)
        for batch in batches:
            c, a, b = (batch.column(k).to_numpy() for k in ("c", "a", "b"))
            used = batch.column("used")
            edge, gone = np.asarray(used.offsets).astype(np.int64), used.values.to_numpy()
            steps = np.minimum(times * c + c + (prime - n), prime)
            ends, first = np.cumsum(steps), 0
            while first < len(c):
                last = max(first + 1, int(np.searchsorted(ends, ends[first] - steps[first] + WALK, "right")))
                many = steps[first:last]
                row = np.repeat(np.arange(last - first), many)
                j = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                idx = (a[first:last][row] * j + b[first:last][row]) % prime
                owner = np.repeat(np.arange(last - first), np.diff(edge[first: last + 1]))
                d = gone[edge[first]: edge[last]]
                known = (d >= 0) & (d < n)
                free = (idx < n) & ~np.isin(row * n + idx, owner[known] * n + d[known])
                rank = np.cumsum(free)
                before = (rank - free)[np.cumsum(many) - many]
                keep = np.flatnonzero(free & (rank - before[row] <= times * c[first:last][row]))
                at = pa.array(first + row[keep])
                yield pa.RecordBatch.from_arrays([batch.column("fold").take(at), batch.column("u").take(at), pa.array(idx[keep])],
                                                 names=["fold", "u", "d"])
                first = last

    return run


def _listed_walk(positives: DataFrame, n: int, times: int) -> DataFrame:
    """(fold, u, d): the first ``times c`` unused items of each user's permutation. One row per user meets its list of
    used items; rows without a user match none, as in a join."""
    prime, seed = next_prime(n), seed_of(F.col("fold"))
    known = F.when(F.col("fold").isNotNull() & F.col("u").isNotNull(), F.col("d").cast("bigint"))
    users = (
        positives.groupBy("fold", "u").agg(F.count(F.lit(1)).alias("c"), F.collect_set(known).alias("used"))
        .withColumn("a", 1 + F.floor(hash_uniform(seed, F.col("u"), "a") * (prime - 1)))
        .withColumn("b", F.floor(hash_uniform(seed, F.col("u"), "b") * prime))
    )
    kinds = ", ".join(f"{c} {users.schema[c].dataType.simpleString()}" for c in ("fold", "u"))
    return users.mapInArrow(_steps(n, times), f"{kinds}, d bigint")


def _permuted_walk(users: DataFrame, n: int, steps) -> DataFrame:
    """``users`` once for each of the first ``steps`` places of a permutation of their own, with the item number ``idx``."""
    prime, seed = next_prime(n), seed_of(F.col("fold"))
    users = (
        users.withColumn("steps", F.least(steps, F.lit(prime)).cast("bigint"))
        .withColumn("a", 1 + F.floor(hash_uniform(seed, F.col("u"), "a") * (prime - 1)))
        .withColumn("b", F.floor(hash_uniform(seed, F.col("u"), "b") * prime))
    )
    pieces = users.withColumn(
        "piece", F.explode(F.sequence(F.lit(0), F.ceil(F.col("steps") / STRIDE) - 1)))
    walk = pieces.withColumn("j", F.explode(F.sequence(
        F.col("piece") * STRIDE, F.least(F.col("steps"), (F.col("piece") + 1) * STRIDE) - 1)))
    idx = F.pmod(F.col("a") * F.col("j") + F.col("b"), F.lit(prime))
    return walk.withColumn("idx", idx).where(F.col("idx") < n)


def _gaps(n: int, times: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, idx = [], []

            def out() -> pa.RecordBatch:
                names = ["fold", "u", "c"]
                return pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(row, pa.int64())) for c in names],
                                                   pa.array(idx, pa.int64())], names=[*names, "idx"])

            for r, (fold, u, c) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("fold", "u", "c")])):
                p = times * c / max(1, n - c)
                scale = math.log(1.0 - p) if p < 1.0 else -math.inf
                at, k, key = -1, 0, f"{fold + seed}|{u}|gap|"
                while True:
                    draw = int(md5(f"{key}{k}".encode()).hexdigest()[:8], 16) / 4294967296.0
                    at += 1 + math.floor(math.log(1.0 - draw) / scale)
                    if at >= n:
                        break
                    row.append(r)
                    idx.append(at)
                    k += 1
                if len(row) > STRIDE:
                    yield out()
                    row, idx = [], []
            yield out()

    return run


def bernoulli_draws(users: DataFrame, n: int, times: int) -> DataFrame:
    """(fold, u, c, idx): each of n items independently with probability ``times c / (n - c)`` per user.

    The gap to the next item that is drawn is geometric, so the k-th keyed number of a user says how many items to
    pass over: the work follows the draws and not users x items.
    """
    kinds = ", ".join(f"{c} {users.schema[c].dataType.simpleString()}" for c in ("fold", "u", "c"))
    return users.select("fold", "u", "c").mapInArrow(_gaps(n, times, SEED), f"{kinds}, idx bigint")


def unused_counts(positives: DataFrame, items: DataFrame) -> DataFrame:
    """All unused items of every user in factored form: fold, u, how many there are and the
    sum of their ids. No user-item pair becomes a row: a user's unused items are all items
    without the used ones."""
    every = items.select("d").distinct().agg(F.count(F.lit(1)).alias("n"), F.sum("d").alias("s")).first()
    known = positives.select("fold", "u", "d").join(items.select("d").distinct(), "d", "left_semi").distinct()
    own = known.groupBy("fold", "u").agg(F.count(F.lit(1)).alias("c"), F.sum("d").alias("t"))
    return positives.select("fold", "u").distinct().join(own, ["fold", "u"], "left").select(
        "fold", "u", (F.lit(every["n"]) - F.coalesce("c", F.lit(0))).alias("unused"),
        (F.lit(every["s"] or 0) - F.coalesce("t", F.lit(0))).alias("unused_sum"))


def _first_of_walk(walk: DataFrame, keys: list[str], order: str, want) -> DataFrame:
    """Rows whose rank by ``order`` inside the user is at most ``want``.

    Ranked piece by piece; only users with several pieces need the sizes of
    their earlier pieces.
    """
    long = F.col("steps") > STRIDE
    walk = walk.withColumn(
        "piece", F.when(long, F.floor(F.col(order) / STRIDE)).otherwise(F.lit(0)))
    sizes = walk.where(long).groupBy(*keys, "piece").agg(F.count(F.lit(1)).alias("n"))
    earlier = W.partitionBy(*keys).orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "piece", F.sum("n").over(earlier).alias("before"))
    inside = W.partitionBy(*keys, "piece").orderBy(order)
    rank = F.row_number().over(inside) + F.coalesce(F.col("before"), F.lit(0))
    return (
        walk.join(offsets, [*keys, "piece"], "left")
        .withColumn("rank", rank).where(F.col("rank") <= want)
    )


def rank_dealt(samples: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Samples of users with both kinds, once for each combination (cp, cn) of a piece of the used
    and a piece of the unused items that they take part in."""
    keys = ["fold", "u"]
    sizes = (
        samples.groupBy(*keys).agg(F.count_if(F.col("x") == 1).alias("np"),
                                   F.count_if(F.col("x") == 0).alias("nn"))
        .where((F.col("np") > 0) & (F.col("nn") > 0))
        .select(*keys, chunk_count(F.col("np"), chunk).alias("kp"),
                chunk_count(F.col("nn"), chunk).alias("kn"))
    )
    used = F.col("x") == 1
    own = F.when(used, chunk_of(F.col("d"), F.col("kp"))).otherwise(
        chunk_of(F.col("d"), F.col("kn")))
    others = F.sequence(F.lit(0), F.when(used, F.col("kn")).otherwise(F.col("kp")) - 1)
    dealt = samples.join(sizes, keys).withColumn("own", own).withColumn(
        "other", F.explode(others))
    return dealt.withColumn("cp", F.when(used, F.col("own")).otherwise(F.col("other"))).withColumn(
        "cn", F.when(used, F.col("other")).otherwise(F.col("own")))


def rank_chunks(samples: DataFrame, chunk: int = CHUNK, extra: tuple[str, ...] = ()) -> DataFrame:
    """Used-versus-unused comparisons in factored form.

    One row per (fold, u) and combination of a piece of the used and a piece of
    the unused items, each list bounded by the piece size: every used item of
    ``pos`` is compared with every unused one of ``neg``. The comparisons stay
    factored: unfolding both lists would give one row for each. Users without
    one of the two kinds drop out. ``extra`` columns travel inside the lists.
    """
    used, item = F.col("x") == 1, F.struct("d", *extra)
    return (
        rank_dealt(samples, chunk).groupBy("fold", "u", "cp", "cn")
        .agg(F.collect_list(F.when(used, item)).alias("pos"),
             F.collect_list(F.when(~used, item)).alias("neg"))
        .where((F.size("pos") > 0) & (F.size("neg") > 0))
    )


def rank_sample_counts(samples: DataFrame) -> DataFrame:
    """How many unused items each used item is compared with, and their id sum.

    There is a task for every ``TASK`` samples, so what a task holds does not grow with the samples.
    """
    samples = cut(samples)
    n = max(int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(samples.count() / TASK))
    samples = samples.repartition(n, "fold", "u")
    total = F.aggregate("neg.d", F.lit(0).cast("bigint"), lambda acc, d: acc + d)
    part = rank_chunks(samples).select(
        "fold", "u", F.explode("pos.d").alias("i"), F.size("neg").alias("n"), total.alias("s"))
    return part.groupBy("fold", "u", "i").agg(
        F.sum("n").alias("unused"), F.sum("s").alias("unused_sum"))
