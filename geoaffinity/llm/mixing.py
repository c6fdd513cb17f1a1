"""Mix sources to target weights by repeating whole documents.

DataFrame functions only. Words are counted once per document; sources are
summed with map-side partial sums; targets are shares of all words, filled up like
water below each source's limit; a document is taken floor(rate) times
plus one Bernoulli copy drawn from a hash of its id. Nothing is collected: the only
rows that meet in one task are the sources, one row each, in the window that ranks and fills them.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..runtime import cut

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the id and the seed only."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, limit: int = 3) -> DataFrame:
    """source, source_size, target for each source of ``sizes(source, size)``.

    Sources rank by code point, null last, and take the weights in turn. With sources sorted
    by limit per weight, one is full exactly if the level that the rest would reach without
    it lies above its own limit; all others stand at the level of the first that is not full.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]),
                        ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    cap = (F.lit(limit) * F.col("source_size"))
    ranked = per.withColumn("w", pick.cast("long")).withColumn("cap", cap)
    fill = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("w").over(fill.rowsBetween(W.currentRow, W.unboundedFollowing))
    every = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("source_size").over(every) - before
    filled = ranked.select("*", left.alias("left"), after.alias("rest"),
                           F.row_number().over(fill).alias("step"))
    full = F.col("left") * F.col("w") > F.col("cap") * F.col("rest")
    level = F.min(F.when(~full, F.struct("step", "left", "rest"))).over(every)
    spread = filled.withColumn("full", full).withColumn("level", level)
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(
        (F.col("w") * F.col("level.left")).cast("double") / F.col("level.rest").cast("double"))
    return spread.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, *, doc_id: str = "doc_id", source: str = "source", text: str = "text",
        weights: Sequence[int] = WEIGHTS, limit: int = 3, seed: int = 42,
        keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken, and the columns in ``keep``.

    Size is the number of words (null text: 0). A null source is a source of its own.
    Rows that share an id share the draw. A source without words gets target 0
    and no copies. The draw depends on id and seed alone, so reruns agree. An empty table
    gives an empty table.
    """
    cols = [F.col(doc_id).alias("_id"), F.col(source).alias("_source"), word_count(F.col(text)).alias("_size")]
    rows = docs.select(*cols, *[F.col(c).alias(f"_k_{c}") for c in keep])
    sizes = rows.select(F.col("_source").alias("source"), F.col("_size").alias("size"))
    if not keep:  # without texts the counted rows are a small table, read twice
        rows = cut(rows)
        sizes = rows.select(F.col("_source").alias("source"), F.col("_size").alias("size"))
    targets = cut(source_targets(sizes, weights, limit))
    found = rows.join(targets, rows["_source"].eqNullSafe(targets["source"]))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    one = (draw(F.col("_id"), seed) < rate - F.floor(rate)).cast("long")
    copies = F.floor(rate) + one
    return found.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), "source_size",
                        "target", copies.alias("copies"), (copies * F.col("_size")).alias("taken"),
                        *[F.col(f"_k_{c}") for c in keep])


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, columns as in ``docs``."""
    taken = mix(docs, keep=docs.columns, **options)
    return (taken.where("copies > 0")
            .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
            .select(*[F.col(f"_k_{c}").alias(c) for c in docs.columns]))
