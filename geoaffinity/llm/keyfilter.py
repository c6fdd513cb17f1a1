"""A filter of keys of fixed size: what does not pass it needs no shuffle to be told apart."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

FILTER = 1 << 27  # bits


def key_filter(keys: DataFrame) -> Broadcast:
    """One bit for each of the longs in the only column of ``keys``, by its last digits. Other keys may share a bit."""
    key = F.pmod(F.col(keys.columns[0]), F.lit(FILTER))
    words = keys.select(key.alias("k")).groupBy(F.floor(F.col("k") / 32).alias("w")).agg(
        F.expr("bit_or(shiftleft(1L, cast(pmod(k, 32) as int)))").alias("b")).toArrow()
    table = np.zeros(FILTER // 32, np.uint32)
    table[words.column("w").to_numpy()] = words.column("b").to_numpy().astype(np.uint32)
    return keys.sparkSession.sparkContext.broadcast(table)


def inside(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the ``keys`` may be in the filter."""
    k = np.mod(keys, FILTER)
    return ((table[k >> 5] >> (k & 31).astype(np.uint32)) & 1).astype(bool)


def passing(rows: DataFrame, key: str, sent: Broadcast, may: bool = True) -> DataFrame:
    """The ``rows`` whose ``key`` (a long) may be in the filter; with ``may`` false, the others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(inside(sent.value, batch.column(key).to_numpy()) == may))

    return rows.mapInArrow(run, rows.schema)
