"""A Bloom filter of 64-bit keys that the driver holds and tasks test against: what fails the test is not among the keys.

Two bits for each key; sixteen to thirty-two bits of room for each while that is at most ``WORDS`` words. With more keys than
that, more strangers pass, which costs time and never changes a result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of 64 bits: 16 MB.
WORDS = 1 << 21


def places(key: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of unsigned keys in a filter of ``size`` words, a power of two: of the low and of the high half."""
    mask = np.uint64(64 * size - 1)
    return key & mask, (key >> np.uint64(32)) & mask


def build(keys: DataFrame, n: int) -> np.ndarray:
    """From about ``n`` well mixed keys, the one long column of ``keys``."""
    size = 1 << max(8, min(WORDS.bit_length() - 1, (n // 4).bit_length()))
    key, mask = F.col(keys.columns[0]), F.lit(64 * size - 1).cast("long")
    at = F.explode(F.array(key.bitwiseAND(mask), F.shiftrightunsigned(key, 32).bitwiseAND(mask))).alias("at")
    one = F.expr("shiftleft(1L, cast(at & 63 as int))")
    rows = keys.select(at).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()  # WORDS rows at most
    table = np.zeros(size, np.uint64)
    table[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return table


def test(table: np.ndarray, key: np.ndarray) -> np.ndarray:
    inside = np.ones(len(key), bool)
    for at in places(key, len(table)):
        inside &= (table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return inside
