"""Whole groups of sorted rows inside ``mapInArrow``, many small groups at a time."""

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def group_starts(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """The first row of each run of equal keys."""
    if not table.num_rows:
        return np.zeros(0, np.int64)
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for key in keys:
        column = table.column(key).combine_chunks()
        new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str],
                 least: int = 5000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups with their group starts, from rows sorted by non-null ``keys``.

    At least ``least`` rows at a time where there are so many; a group is never cut.
    """
    waiting, rows = [], 0
    for batch in batches:
        waiting.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        table = pa.Table.from_batches(waiting)
        starts = group_starts(table, keys)
        if len(starts) > 1:
            last = int(starts[-1])
            yield table.slice(0, last), starts[:-1]
            waiting, rows = table.slice(last).to_batches(), table.num_rows - last
    if rows:
        table = pa.Table.from_batches(waiting)
        yield table, group_starts(table, keys)
