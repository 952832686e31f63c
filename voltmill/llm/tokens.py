"""Words of Arrow text columns as flat numpy arrays, without a Python object for each word.

A column is handled in slices of a few megabytes, so the working memory of a task is about forty times the longer of
``SLICE`` and its longest text, however many rows an Arrow batch holds. Word identities are 64-bit hashes: at a billion different
words two of them share one with a probability of about 3 %, so nothing here is used where one collision would matter more
than one word's count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 21
_U = np.uint64
_ODD = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number modulo 2**64 and of its inverse."""
    if len(_powers.get("up", ())) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for name, base in (("up", _ODD), ("down", pow(_ODD, -1, 1 << 64))):
            x = np.full(size, base, _U)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x ^ (x >> _U(31))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


@dataclass
class Words:
    """Words of consecutive rows: byte positions in ``data``; row r has the words ``first[r]:first[r + 1]`` and the bytes ``offsets[r]:offsets[r + 1]``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    offsets: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word's bytes; ``lower`` folds A-Z."""
        if not len(self.start):
            return np.zeros(0, _U)
        up, down = _power(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, _U)
        np.cumsum((_LOWER[self.data] if lower else self.data).astype(_U) * up[:-1] + up[:-1], out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(_U))

    def count(self, chosen: np.ndarray) -> np.ndarray:
        """How many bytes of each row's words the table ``chosen`` (256 booleans) picks."""
        sums = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(chosen[self.data] & ~_SPACE[self.data], out=sums[1:])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]

    def windows(self, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the windows of ``width`` words that lie within one row, and a hash of each one's sequence."""
        last = np.repeat(self.first[1:] - width, self.counts)
        at = np.flatnonzero(np.arange(len(hashes)) <= last)
        return at, window_hashes(hashes, at, width)


def window_hashes(hashes: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    up, down = _power(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, _U)
    np.cumsum(hashes * up[:-1], out=sums[1:])
    return mix((sums[at + width] - sums[at]) * down[at])


def words(column: pa.Array) -> Words:
    """Null texts have no words."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    low, high = (int(offsets[0]), int(offsets[-1])) if len(column) else (0, 0)
    data = np.frombuffer(column.buffers()[2], np.uint8)[low:high] if high > low else np.zeros(0, np.uint8)
    offsets = offsets - low if len(column) else np.zeros(1, np.int64)
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    start = np.flatnonzero(begins)
    return Words(data, start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets), offsets)


def slices(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive parts of a column of about ``SLICE`` bytes and the row that each begins at; a longer text is a part of its own."""
    if not len(column):
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    row = 0
    while row < len(column):
        base = size[row - 1] if row else 0
        stop = max(row + 1, int(np.searchsorted(size, base + SLICE, side="right")))
        yield row, column.slice(row, stop - row)
        row = stop
