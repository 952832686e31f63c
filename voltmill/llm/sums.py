"""Sums of fixed-size numpy tables over all tasks, through shuffles of their pieces."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import partitions

_PIECE = 1 << 14
_SCHEMA = "salt int, piece int, sums binary, size int"


def _rows(pieces: dict[int, np.ndarray], salt: int) -> pa.RecordBatch:
    return pa.record_batch([pa.array([salt] * len(pieces), pa.int32()), pa.array(list(pieces), pa.int32()), pa.array([pa.compress(x.tobytes(), "zstd", asbytes=True) for x in pieces.values()], pa.binary()), pa.array([x.nbytes for x in pieces.values()], pa.int32())], names=["salt", "piece", "sums", "size"])


def _unpack(packed: bytes | pa.Buffer, size: int, kind: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed, decompressed_size=size, codec="zstd", asbytes=True), kind).astype(np.float64)


def _add(kind: type):
    """One row for each piece that the task sees. It holds no more than the table, however many rows come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, packed, size in zip(batch.column("piece").to_pylist(), batch.column("sums"), batch.column("size").to_pylist(), strict=True):
                x = _unpack(packed.as_buffer(), size, kind)
                sums[piece] = sums[piece] + x if piece in sums else x
        if sums:
            yield _rows({k: x.astype(kind) for k, x in sums.items()}, 0)

    return run


def table_sum(docs: DataFrame, size: int, count: Callable[[Iterator[pa.RecordBatch]], np.ndarray], fan: int = 32, kind: type = np.float64) -> np.ndarray:
    """The sum of ``count(batches)``, a table of ``size`` numbers, over the tasks of ``docs``; ``kind``: how exactly tables are sent.

    Each task sends its table in pieces, pieces of zeros not at all. Groups of ``fan`` tasks are summed first, then the groups,
    so no task of a large job reads a piece from all others; the driver receives one table.
    """
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.asarray(count(batches), kind)
        pieces = {k: x for k, x in enumerate(np.split(table, range(_PIECE, size, _PIECE))) if x.any()}
        if pieces:
            yield _rows(pieces, TaskContext.get().partitionId() // fan)

    n, pieces = partitions(docs.sparkSession), -(-size // _PIECE)
    # dealt by number, as a few hundred pieces would hash unevenly
    fanned = docs.mapInArrow(run, _SCHEMA).repartitionById(n, F.pmod(F.col("salt") * pieces + F.col("piece"), F.lit(n)).cast("int")).mapInArrow(_add(kind), _SCHEMA)
    sums = fanned.repartitionById(n, F.pmod("piece", F.lit(n)).cast("int")).mapInArrow(_add(kind), _SCHEMA)
    out = np.zeros(size)
    for row in sums.collect():
        x = _unpack(bytes(row.sums), row.size, kind)
        out[row.piece * _PIECE : row.piece * _PIECE + len(x)] += x
    return out
