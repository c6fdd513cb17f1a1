"""Logistic factor models trained by gradient descent with line search.

Factors are tables ``(fold, id, f)``; only per-fold scalars (gradient norms,
losses, step widths) ever reach the driver. One training step is two lineage
cuts (the user and the item gradients) and two small aggregations.
"""

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from geoaffinity.functions import (dot, log_loss, logistic, norm2, random_unit_vector, softplus,
                                   sum_vectors)
from geoaffinity.operators import alone, blocks
from geoaffinity.operators.pairwise import pair_errors, pair_losses
from geoaffinity.operators.splits import seed_of
from geoaffinity.runtime import cut, discard, spread

USER, ITEM = ["fold", "u"], ["fold", "d"]
STEP_WIDTHS = [0.5 ** i for i in range(20)]  # 1, 1/2, ... while above 1e-6


@dataclass(frozen=True)
class FitOptions:
    """``lp``, ``lq``, ``lg``: weights of the user, item and graph terms, added
    once per sample. A step must lower the loss by ``width * slope`` with
    ``slope = c (|gp| + |gq|) / samples``; training ends when that is below
    ``tol``, when no width passes, or after ``max_iter`` steps."""

    rank: int = 20
    lp: float = 0.01
    lq: float = 0.01
    lg: float = 0.01
    max_iter: int = 100
    c: float = 0.5
    tol: float = 1e-6


@dataclass
class FactorModel:
    users: DataFrame
    items: DataFrame
    history: list[dict] = field(default_factory=list)


@dataclass
class Step:
    """New factors, a report per fold, and the tables the factors are read from."""

    users: DataFrame
    items: DataFrame
    report: dict[int, dict]
    tables: tuple[DataFrame, DataFrame]


def factor_init(ids: DataFrame, key: str, rank: int) -> DataFrame:
    """A random unit vector per (fold, id), decided by fold seed, kind and id."""
    f = random_unit_vector(rank, seed_of(F.col("fold")), key, F.col(key))
    return ids.select("fold", key).distinct().withColumn("f", f)


def popularity_weight(positives: DataFrame, c0: float = 1.0, alpha: float = 0.5) -> DataFrame:
    """Weight of an item as a negative: ``c0 n^alpha / (sum n)^alpha``, with n the
    item's distinct users."""
    counts = positives.select("fold", "u", "d").distinct().groupBy(*ITEM).agg(
        F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("fold").agg(F.sum("n").alias("total"))
    w = F.lit(float(c0)) * F.pow("n", F.lit(float(alpha))) / F.pow("total", F.lit(float(alpha)))
    return counts.join(F.broadcast(totals), "fold").select(*ITEM, "n", w.alias("w"))


def weigh_negatives(samples: DataFrame, weights: DataFrame) -> DataFrame:
    """``w = 1`` for positives, the item's popularity weight for negatives."""
    w = F.when(F.col("x") == 1, F.lit(1.0)).otherwise(F.coalesce("pw", F.lit(0.0)))
    return samples.join(weights.select(*ITEM, F.col("w").alias("pw")), ITEM, "left").select(
        *samples.columns, w.alias("w"))


def with_factors(samples: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Add p and q; samples of unknown users or items drop out.

    The item table is the small side: Spark broadcasts it when it measures
    small, otherwise the adaptive join splits the heavy items. Users come first, so that
    samples are shuffled to them without an item vector each.
    """
    return samples.join(users.withColumnRenamed("f", "p"), USER).join(
        items.withColumnRenamed("f", "q"), ITEM)


def predict_scores(samples: DataFrame, users: DataFrame, items: DataFrame,
                   rank: int | None = None) -> DataFrame:
    """Raw score ``z = p . q`` and probability ``y`` of each sample."""
    z = dot(F.col("p"), F.col("q"), rank)
    return with_factors(samples, users, items).select(
        *samples.columns, z.alias("z")).withColumn("y", logistic(F.col("z")))


def _weight(samples: DataFrame) -> Column:
    return F.col("w") if "w" in samples.columns else F.lit(1.0)


def mean_loss(samples: DataFrame, users: DataFrame, items: DataFrame,
              rank: int | None = None) -> DataFrame:
    """Mean (weighted, if ``w`` is present) log-loss per fold."""
    loss = _weight(samples) * log_loss(F.col("x"), F.col("z"))
    return predict_scores(samples, users, items, rank).groupBy("fold").agg(
        F.avg(loss).alias("loss"), F.count(F.lit(1)).alias("samples"))


def rank_loss(samples: DataFrame, users: DataFrame, items: DataFrame,
              rank: int | None = None) -> DataFrame:
    """Mean of ``-ln logistic(z_i - z_j)`` over used i and unused j of a user.

    Computed inside bounded list pairs, so no comparison becomes a row.
    """
    scored = predict_scores(samples, users, items, rank).withColumnRenamed("z", "z0")
    return pair_losses(scored, ("z0",), [0.0], ["loss"]).select(
        "fold", "loss", F.col("n").alias("pairs"))


def point_terms(samples: DataFrame, users: DataFrame, items: DataFrame, rank: int) -> DataFrame:
    """Per sample: p, q, error ``e = w (y - x)`` and sample count ``n``."""
    y = logistic(dot(F.col("p"), F.col("q"), rank))
    return with_factors(samples, users, items).select(
        "fold", "u", "d", "p", "q", (_weight(samples) * (y - F.col("x"))).alias("e"),
        F.lit(1).cast("bigint").alias("n"))


def rank_errors(samples: DataFrame, users: DataFrame, items: DataFrame, rank: int) -> DataFrame:
    """Pairwise errors folded onto (fold, u, d).

    With ``g = logistic(z_i - z_j) - 1`` a used item gets the sum of its g, an
    unused item minus the sum of its g. The vector work that follows then runs
    over samples instead of over comparisons.
    """
    rows = pair_errors(predict_scores(samples, users, items, rank))
    return rows.groupBy("fold", "u", "d").agg(
        F.sum("e").alias("e"), F.sum("n").alias("n"), F.sum("np").alias("np"))


def rank_terms(errors: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """``point_terms`` for pairwise errors. ``np``: each comparison holds the
    user once, which the used side stands for."""
    return with_factors(errors, users, items).select(
        "fold", "u", "d", "p", "q", "e", "n", "np")


def user_gradient(terms: DataFrame, users: DataFrame, lp: float, rank: int,
                  graph: DataFrame | None = None, lg: float = 0.0) -> DataFrame:
    """(fold, u, p, g): ``sum(e q) + n lp p``, plus ``n lg (p - m)`` with a graph.

    ``graph`` holds m per (fold, u), computed once per user; users without
    friends have m = 0.
    """
    count = F.sum("np" if "np" in terms.columns else "n")
    sums = terms.groupBy(*USER).agg(
        count.alias("n"), sum_vectors(F.col("q"), rank, F.col("e")).alias("s"))
    both = users.withColumnRenamed("f", "p").join(sums, USER)
    if graph is not None:
        both = both.join(graph, USER, "left")
    pull = []
    for i in range(rank):
        at = F.lit(i)
        p = F.get("p", at)
        part = F.get("s", at) + F.col("n") * F.lit(lp) * p
        if graph is not None:
            m = F.coalesce(F.get("m", at), F.lit(0.0))
            part = part + F.col("n") * F.lit(lg) * (p - m)
        pull.append(part)
    return both.select(*USER, "p", F.array(*pull).alias("g"))


def item_gradient(terms: DataFrame, items: DataFrame, lq: float, rank: int) -> DataFrame:
    """(fold, d, q, h): ``sum(e p) + n lq q``."""
    sums = terms.groupBy(*ITEM).agg(
        F.sum("n").alias("n"), sum_vectors(F.col("p"), rank, F.col("e")).alias("s"))
    both = items.withColumnRenamed("f", "q").join(sums, ITEM)
    parts = [F.get("s", F.lit(i)) + F.col("n") * F.lit(lq) * F.get("q", F.lit(i))
             for i in range(rank)]
    return both.select(*ITEM, "q", F.array(*parts).alias("h"))


def gradient_norm(user_grad: DataFrame, item_grad: DataFrame, rank: int) -> DataFrame:
    """Total Euclidean norm of the user and of the item gradient per fold."""
    up = user_grad.groupBy("fold").agg(F.sqrt(F.sum(norm2(F.col("g"), rank))).alias("mp"))
    down = item_grad.groupBy("fold").agg(F.sqrt(F.sum(norm2(F.col("h"), rank))).alias("mq"))
    return up.join(F.broadcast(down), "fold")


def graph_term(edges: DataFrame, users: DataFrame, rank: int) -> DataFrame:
    """(fold, u, m): ``m = sum over friends v of (s_uv - p_u . p_v) p_v``.

    Friends without factors are left out.
    """
    src = users.select("fold", F.col("u").alias("src"), F.col("f").alias("p"))
    dst = users.select("fold", F.col("u").alias("dst"), F.col("f").alias("v"))
    near = edges.select("src", "dst", "score").join(src, "src").join(dst, ["fold", "dst"])
    pull = F.col("score") - dot(F.col("p"), F.col("v"), rank)
    return near.withColumn("pull", pull).groupBy("fold", F.col("src").alias("u")).agg(
        sum_vectors(F.col("v"), rank, F.col("pull")).alias("m"))


def per_fold(spark, values: dict[int, Sequence[float]], names: Sequence[str]) -> DataFrame:
    """Numbers of each fold as a table: one row per fold, so it may be broadcast.

    As data, not as literals: the plan of every step is then the same text and
    its generated code is compiled once.
    """
    rows = [(int(f), *(float(v) for v in vs)) for f, vs in values.items()]
    schema = "fold int, " + ", ".join(f"{n} double" for n in names)
    return F.broadcast(spark.createDataFrame(rows, schema))


def _inverse(value: float) -> float:
    return 1.0 / value if value else 0.0


def line_losses(samples: DataFrame, user_grad: DataFrame, item_grad: DataFrame,
                scales: DataFrame, rank: int, pairwise: bool) -> DataFrame:
    """Loss at the current point (``l``) and after each candidate width (``l0``..).

    Moving by a width w changes a score to ``z0 - w z1 + w^2 z2``; the three
    numbers are computed once per sample and every width is tried in one pass.
    ``scales`` holds the inverse gradient norms of each fold.
    """
    p, g, q, h, up, down = (F.col(c) for c in ("p", "g", "q", "h", "up", "down"))
    scored = samples.join(item_grad, ITEM).join(user_grad, USER).join(scales, "fold").select(
        *samples.columns, dot(p, q, rank).alias("z0"),
        (dot(p, h, rank) * down + dot(g, q, rank) * up).alias("z1"),
        (dot(g, h, rank) * up * down).alias("z2"))
    widths = [0.0, *STEP_WIDTHS]
    names = ["l", *[f"l{i}" for i in range(len(STEP_WIDTHS))]]
    if not pairwise:
        def loss(w):
            z = F.col("z0") - F.lit(w) * F.col("z1") + F.lit(w * w) * F.col("z2")
            return F.avg(_weight(samples) * log_loss(F.col("x"), z))

        return scored.groupBy("fold").agg(
            F.count(F.lit(1)).alias("n"), *[loss(w).alias(c) for c, w in zip(names, widths)])

    return pair_losses(scored, ("z0", "z1", "z2"), widths, names)


def step_gradients(samples: DataFrame, users: DataFrame, items: DataFrame, options: FitOptions,
                   edges: DataFrame | None = None, pairwise: bool = False):
    """Both gradients at the given factors, as lineage-free tables."""
    rank = options.rank
    errors = cut(rank_errors(samples, users, items, rank)) if pairwise else None
    if pairwise:
        terms = rank_terms(errors, users, items)
    else:
        terms = point_terms(samples, users, items, rank)
    graph = graph_term(edges, users, rank) if edges is not None else None
    user_grad = cut(user_gradient(terms, users, options.lp, rank, graph, options.lg))
    item_grad = cut(item_gradient(terms, items, options.lq, rank))
    if pairwise:
        discard(errors)
    return user_grad, item_grad


def _choose(row, slope: float) -> float:
    """The largest width whose loss is low enough; 0 when none is."""
    for i, width in enumerate(STEP_WIDTHS):
        if row[f"l{i}"] <= row["l"] - width * slope:
            return width
    return 0.0


def one_step(samples: DataFrame, users: DataFrame, items: DataFrame, options: FitOptions,
             edges: DataFrame | None = None, pairwise: bool = False) -> Step:
    """One gradient step of every fold."""
    rank = options.rank
    user_grad, item_grad = step_gradients(samples, users, items, options, edges, pairwise)
    norms = {r.fold: r for r in gradient_norm(user_grad, item_grad, rank).collect()}
    scales = {f: (_inverse(r.mp), _inverse(r.mq)) for f, r in norms.items()}
    spark = samples.sparkSession
    losses = line_losses(samples, user_grad, item_grad, per_fold(spark, scales, ["up", "down"]),
                         rank, pairwise)
    report = {}
    for row in losses.collect():
        slope = options.c * (norms[row.fold].mp + norms[row.fold].mq) / row.n
        width = _choose(row, slope)
        after = row["l"] if width == 0.0 else row[f"l{STEP_WIDTHS.index(width)}"]
        report[row.fold] = {"fold": row.fold, "width": width, "slope": slope,
                            "loss": row["l"], "loss_after": after}
    moves = per_fold(spark, {f: [r["width"] * s for s in scales[f]] for f, r in report.items()},
                     ["by_user", "by_item"])

    def moved(old, direction, by):
        return F.array(*[F.get(old, F.lit(i)) - F.col(by) * F.get(direction, F.lit(i))
                         for i in range(rank)]).alias("f")

    new_users = user_grad.join(moves, "fold").select(*USER, moved("p", "g", "by_user"))
    new_items = item_grad.join(moves, "fold").select(*ITEM, moved("q", "h", "by_item"))
    return Step(new_users, new_items, report, (user_grad, item_grad))


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def fit(samples: DataFrame, options: FitOptions, edges: DataFrame | None = None,
        pairwise: bool = False, watch: DataFrame | None = None) -> FactorModel:
    """Train on (fold, u, d, x[, w]); every fold is trained in the same jobs.

    ``edges`` (src, dst, score) adds the graph term, ``pairwise`` replaces the
    log-loss by the ranking loss over used and unused items of a user; users with only
    one of the two kinds compare nothing and should be left out. With ``watch``, further rows of the
    same form, ``history`` holds their mean loss after each step.

    Trained on packed blocks if the items fit into one row per fold, otherwise by joins; small folds are trained in
    a task each (``alone``). All take the same steps.
    """
    samples = cut(samples)
    ids = blocks.catalogue(samples)
    if ids is not None:
        users, items = (cut(factor_init(samples, key, options.rank)) for key in ("u", "d"))
        packed = blocks.pack(samples, users, items, ids, options.rank, pairwise, watch)
        friends = None if edges is None else blocks.friend_cells(edges, packed)
        if alone.fits(packed, friends):
            return FactorModel(*alone.fit(packed, options, STEP_WIDTHS, friends))
        return _fit_blocks(packed, options, friends)
    return fit_joined(samples, options, edges, pairwise, watch)


def _fit_blocks(packed: blocks.Packed, options: FitOptions, friends: DataFrame | None) -> FactorModel:
    """Three actions a step; more widths are tried in a further one if none of the first few will do."""
    cells, state = packed.cells, packed.state
    moves = {r.fold: (0.0, 0.0) for r in state.items.select("fold").orderBy("fold").collect()}
    done_users, done_items, history, tried = [], [], [], 4
    for number in range(options.max_iter):
        old = state
        state, norms = blocks.gradient_state(packed, cells, old, moves, options.lp, options.lq, options.lg, friends)
        scales = {f: tuple(map(_inverse, n)) for f, n in norms.items()}
        report, losses, open_folds, widths = {}, {}, sorted(moves), [0.0, *STEP_WIDTHS[:tried]]
        while open_folds:
            some = cells if len(open_folds) == len(moves) else cells.where(F.col("fold").isin(open_folds))
            found = blocks.width_losses(packed, some, state, scales, widths)
            for fold in open_folds:
                n, means = found[fold, False]
                for held_out in (False, True):
                    seen = found.get((fold, held_out), (0, [None] * len(widths)))[1]
                    losses.setdefault((fold, held_out), {}).update(zip(widths, seen))
                at = losses[fold, False]
                slope = options.c * sum(norms[fold]) / n
                width = next((w for w in STEP_WIDTHS if w in at and at[w] <= at[0.0] - w * slope), 0.0)
                if width or len(at) > len(STEP_WIDTHS):
                    report[fold] = {"fold": fold, "width": width, "slope": slope, "loss": at[0.0], "loss_after": at[width]}
            open_folds = [f for f in open_folds if f not in report]
            widths = STEP_WIDTHS[tried:]
        if number:
            discard(old.users, old.items)
        moves = {f: tuple(r["width"] * s for s in scales[f]) for f, r in report.items()}
        history += [{"step": number, **r, "watched_loss": losses[f, True][r["width"]]} for f, r in sorted(report.items())]
        finished = [f for f, r in report.items() if r["width"] * r["slope"] < options.tol]
        last = number == options.max_iter - 1
        if finished or last:
            out = sorted(moves) if last else finished
            at_end = state.where(F.col("fold").isin(out))
            done_users.append(cut(blocks.vectors(packed, at_end, moves, "u")))
            done_items.append(cut(blocks.vectors(packed, at_end, moves, "d")))
            if len(out) == len(moves):
                discard(state.users, state.items)
                break
            moves = {f: m for f, m in moves.items() if f not in finished}
            cells, state = (df.where(~F.col("fold").isin(finished)) for df in (cells, state))
        used = [STEP_WIDTHS.index(r["width"]) if r["width"] else len(STEP_WIDTHS) for r in report.values()]
        tried = min(len(STEP_WIDTHS), max(4, 3 + max(used)))
    return FactorModel(union_all(done_users), union_all(done_items), history)


def fit_joined(samples: DataFrame, options: FitOptions, edges: DataFrame | None = None,
        pairwise: bool = False, watch: DataFrame | None = None) -> FactorModel:
    """``fit`` for catalogues of any size: samples meet both factor tables in joins at every step."""
    # Rows of a user lie together, so every later partial sum by user is short.
    samples = cut(spread(samples, *USER))
    users = cut(factor_init(samples, "u", options.rank))
    items = cut(factor_init(samples, "d", options.rank))
    done_users, done_items, history, old = [], [], [], (users, items)
    for number in range(options.max_iter):
        step = one_step(samples, users, items, options, edges, pairwise)
        users, items, report = step.users, step.items, step.report
        seen = {}
        if watch is not None:  # held-out rows are scored, not learned from
            loss = rank_loss if pairwise else mean_loss
            seen = {r.fold: r.loss for r in loss(watch, users, items, options.rank).collect()}
        history += [{"step": number, **r, "watched_loss": seen.get(f)} for f, r in sorted(report.items())]
        discard(*old)
        finished = [f for f, r in report.items() if r["width"] * r["slope"] < options.tol]
        if finished:
            done_users.append(users.where(F.col("fold").isin(finished)))
            done_items.append(items.where(F.col("fold").isin(finished)))
            users, items, samples = (
                df.where(~F.col("fold").isin(finished)) for df in (users, items, samples))
        old = () if finished else step.tables
        if len(finished) == len(report):
            break
    return FactorModel(union_all([*done_users, users]), union_all([*done_items, items]), history)
