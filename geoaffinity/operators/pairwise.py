"""Sums over the used-unused comparisons of bounded list pairs.

Spark cuts every user into list pairs of limited length and shuffles them; a task reads the lists of many users end to
end and numpy runs over slabs of their comparisons, so neither comparisons nor users are looped over
in Python and no comparison becomes a row.
"""

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from geoaffinity.operators.sampling import rank_chunks

PAIRS = 1 << 18  # comparisons at a time, or one item's against one list


def steps(sizes: np.ndarray) -> np.ndarray:
    """0, 1, .. inside each of the runs of these sizes."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def run_sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of these sizes; an empty run is 0."""
    out, some = np.zeros(len(sizes)), sizes > 0
    if some.any():
        out[some] = np.add.reduceat(values, (np.cumsum(sizes) - sizes)[some])
    return out


@dataclass
class Segments:
    """List pairs in one array: where the used and the unused items of each begin, and how many there are."""

    used_from: np.ndarray
    used: np.ndarray
    unused_from: np.ndarray
    unused: np.ndarray

    def slabs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """All comparisons, about ``PAIRS`` at a time: for some used items their segments and places, how many
        unused ones each meets, and the places of those, one after another."""
        own = np.repeat(np.arange(len(self.used)), self.used)
        mine = np.repeat(self.used_from, self.used) + steps(self.used)
        many, begin = self.unused[own], self.unused_from[own]
        ends, k = np.cumsum(many), 0
        while k < len(mine):
            stop = max(k + 1, int(np.searchsorted(ends, ends[k] - many[k] + PAIRS, "right")))
            n = many[k:stop]
            yield own[k:stop], mine[k:stop], n, np.repeat(begin[k:stop], n) + steps(n)
            k = stop


def slopes(lists: Segments, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per place the sum of ``logistic(z_used - z_unused) - 1`` over its comparisons (minus that for an unused
    item), and their number."""
    e, n = np.zeros(len(z)), np.zeros(len(z), np.int64)
    for _, mine, many, other in lists.slabs():
        with np.errstate(over="ignore"):
            slope = 1.0 / (1.0 + np.exp(z[other] - np.repeat(z[mine], many))) - 1.0
        e[mine] += run_sums(slope, many)
        n[mine] += many
        e -= np.bincount(other, slope, len(z))
        n += np.bincount(other, minlength=len(z))
    return e, n


def softplus(z: np.ndarray) -> np.ndarray:
    return np.maximum(z, 0.0) + np.log(1.0 + np.exp(-np.abs(z)))


def losses(lists: Segments, scores: Sequence[np.ndarray]) -> np.ndarray:
    """Per segment and score the sum of ``softplus(z_unused - z_used)`` over its comparisons."""
    out = np.zeros((len(lists.used), len(scores)))
    calm = all(np.abs(z).max(initial=0.0) < 300.0 for z in scores)  # then products of exponentials are finite
    powers = [np.exp(z) for z in scores] if calm else scores
    for own, mine, many, other in lists.slabs():
        for k, z in enumerate(powers):
            if calm:
                value = np.log(1.0 + z[other] * np.repeat(1.0 / z[mine], many))
            else:
                value = softplus(z[other] - np.repeat(z[mine], many))
            np.add.at(out[:, k], own, run_sums(value, many))
    return out


def _flat(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column end to end, and the lengths of its lists."""
    column = batch.column(name)
    return (column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))


def _segments(used: np.ndarray, unused: np.ndarray) -> Segments:
    """Lists of these lengths, all used items before all unused ones."""
    return Segments(np.cumsum(used) - used, used, used.sum() + np.cumsum(unused) - unused, unused)


def _loss_sums(scores: Sequence[str], widths: Sequence[float], names: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # The score after a step is a polynomial of its width.
            terms = [np.concatenate([_flat(batch, f"p_{c}")[0], _flat(batch, f"n_{c}")[0]]) for c in scores]
            lists = _segments(*(_flat(batch, f"{side}_{scores[0]}")[1] for side in "pn"))
            moved = [sum(t * (-w) ** power for power, t in enumerate(terms)) for w in widths]
            sums = losses(lists, moved)
            yield pa.RecordBatch.from_arrays(
                [batch.column("fold"), pa.array(lists.used * lists.unused),
                 *[pa.array(sums[:, i]) for i in range(len(widths))]], ["fold", "n", *names])

    return run


def pair_losses(scored: DataFrame, scores: Sequence[str], widths: Sequence[float],
                names: Sequence[str]) -> DataFrame:
    """Mean ranking loss per fold after each step width, and the pair count ``n``.

    ``scores`` are the coefficients of a score as a polynomial of the width with
    alternating signs: ``z0 - w z1 + w^2 z2``.
    """
    chunks = rank_chunks(scored, extra=tuple(scores)).select(
        F.col("fold").cast("int").alias("fold"),
        *[F.col(f"pos.{c}").alias(f"p_{c}") for c in scores],
        *[F.col(f"neg.{c}").alias(f"n_{c}") for c in scores])
    schema = "fold int, n bigint, " + ", ".join(f"{c} double" for c in names)
    sums = chunks.mapInArrow(_loss_sums(scores, widths, names), schema)
    return sums.groupBy("fold").agg(
        F.sum("n").alias("n"), *[(F.sum(c) / F.sum("n")).alias(c) for c in names])


def _errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        (used, a), (unused, b) = _flat(batch, "p_d"), _flat(batch, "n_d")
        lists = _segments(a, b)
        e, n = slopes(lists, np.concatenate([_flat(batch, "p_z")[0], _flat(batch, "n_z")[0]]))
        rows = np.arange(batch.num_rows)
        owner = pa.array(np.concatenate([np.repeat(rows, a), np.repeat(rows, b)]))
        as_used = np.where(np.arange(len(n)) < len(used), n, 0)
        yield pa.RecordBatch.from_arrays(
            [batch.column("fold").take(owner), batch.column("u").take(owner),
             pa.array(np.concatenate([used, unused]).astype(np.int64)), pa.array(e), pa.array(n), pa.array(as_used)],
            ["fold", "u", "d", "e", "n", "np"])


def pair_errors(scored: DataFrame) -> DataFrame:
    """(fold, u, d, e, n, np): the summed slope of an item's comparisons within
    one list pair, their number, and the number in which the item is the used one."""
    chunks = rank_chunks(scored, extra=("z",)).select(
        F.col("fold").cast("int").alias("fold"), F.col("u").cast("bigint").alias("u"),
        F.col("pos.d").cast("array<bigint>").alias("p_d"),
        F.col("neg.d").cast("array<bigint>").alias("n_d"),
        F.col("pos.z").alias("p_z"), F.col("neg.z").alias("n_z"))
    return chunks.mapInArrow(
        _errors, "fold int, u bigint, d bigint, e double, n bigint, np bigint")
