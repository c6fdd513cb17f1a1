"""Arrow text columns as bytes, and hashes of byte and token spans in numpy."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = b" \t\n\x0b\x0c\r"
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))  # A-Z only

PIECE = 1 << 20  # bytes hashed at a time


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and the n + 1 row borders; null is empty."""
    kind = pa.large_binary() if "large" in str(column.type) else pa.binary()
    column = column.cast(kind)
    if column.null_count:
        column = pc.fill_null(column, b"")
    _, borders, data = column.buffers()
    size = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(borders, size)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]: at[-1]], at - at[0]


def row_texts(column: pa.Array) -> Iterator[bytes]:
    """The rows of a text column as bytes, one at a time."""
    raw, at = text_bytes(column)
    view = memoryview(raw)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        yield bytes(view[a:b])


def row_blocks(at: np.ndarray, most: int = 2 * PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows with at most ``most`` bytes, or one longer row."""
    first, rows = 0, len(at) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield first, min(last, rows)
        first = min(last, rows)


def word_borders(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words between white space, and the first word of each row (n + 1)."""
    inside = ~IS_SPACE[raw]
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    cuts = at[:-1][at[:-1] < len(raw)]
    before[cuts] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[at[1:][at[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


class SpanHash:
    """64-bit polynomial hashes of spans: sums of random byte values times powers of an odd base.

    Wrapping arithmetic modulo 2**64, so one running sum serves all spans of a piece.
    """

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.value = rng.integers(0, 2**64, 256, np.uint64)
        base = int(rng.integers(0, 2**62)) * 8 + 5
        self.base, self.inverse = np.uint64(base % 2**64), np.uint64(pow(base, -1, 2**64))
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            factor = np.full(size, self.base, np.uint64)
            factor[0] = 1
            self.up = np.multiply.accumulate(factor)
            factor[1:] = self.inverse
            self.down = np.multiply.accumulate(factor)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Running sums (n + 1) of values times powers."""
        n = len(values)
        self._powers(n + 1)
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(values * self.up[:n], out=out[1:])
        return out

    def between(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._powers(int(starts.max(initial=0)) + 1)
        return mixed((sums[ends] - sums[starts]) * self.down[starts]
                     + (ends - starts).astype(np.uint64) * self.value[7])

    def bytes(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of byte spans in order of their starts and ends."""
        out, i, n = np.empty(len(starts), np.uint64), 0, len(starts)
        while i < n:
            low = int(starts[i])
            j = max(i + 1, int(np.searchsorted(ends, low + PIECE, "right")))
            s, e = starts[i:j] - low, ends[i:j] - low
            out[i:j] = self.between(self.sums(self.value[raw[low: int(ends[j - 1])]]), s, e)
            i = j
        return out


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread all bits over all bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))
