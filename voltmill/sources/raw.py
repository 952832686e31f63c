"""Recordings as Spark data sources: read in chunks with halos, written as one file for each chunk."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .layouts import layout
from .probefile import natural_key

SCHEMA = "chunk_id long, t_start long, n long, before int, channels int, samples binary"


class Chunk(InputPartition):
    def __init__(self, number: int, start: int, stop: int):
        self.number, self.start, self.stop = number, start, stop


class RecordingReader(DataSourceReader):
    def __init__(self, options: dict):
        path, form = options["path"], options.get("layout", "raw_binary")
        paths = path.split(",")
        if form == "raw_binary" and len(paths) == 1 and os.path.isdir(path):
            paths = [os.path.join(path, n) for n in sorted(os.listdir(path), key=natural_key) if n.endswith(".dat")]
        self.layout = layout(paths, form, options)
        self.keep = [int(c) for c in options["keep"].split(",")] if options.get("keep") else None
        self.chunk, self.halo = int(options.get("chunk", 1 << 16)), int(options.get("halo", 0))
        self.start, self.stop, self.every = int(options.get("start", 0)), min(int(options.get("stop", self.layout.steps)), self.layout.steps), int(options.get("every", 1))
        if self.start < 0 or self.every < 1 or self.every > 1 and self.halo:
            raise ValueError("start must not be negative, every at least 1, and 1 where there is a halo")

    def partitions(self) -> list[Chunk]:
        """Only chunks of the range are planned, so nothing else is read."""
        return [Chunk(i, a, min(a + self.chunk, self.stop)) for i, a in enumerate(range(self.start, self.stop, self.chunk))]

    def read(self, part: Chunk | None):
        if part is None:  # an empty recording has no chunks
            return
        low, high = max(self.start, part.start - self.halo), min(self.stop, part.stop + self.halo)
        x = self.layout.read(low, high)
        if self.every > 1:
            first = -(part.start - self.start) % self.every
            x = x[first :: self.every]
            start = (part.start + first - self.start) // self.every
        else:
            start = part.start
        if self.keep is not None:
            x = x[:, self.keep]
        names = ["chunk_id", "t_start", "n", "before", "channels", "samples"]
        columns = [pa.array([part.number]), pa.array([start]), pa.array([len(x) if self.every > 1 else part.stop - part.start]), pa.array([part.start - low], pa.int32()), pa.array([x.shape[1]], pa.int32()), pa.array([x.tobytes()], pa.binary())]
        yield pa.record_batch(columns, names=names)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class ChunkWriter(DataSourceWriter):
    """A file of its own samples for each chunk, named by its start, put in place in one step: a task that runs again leaves the same files."""

    def __init__(self, options: dict, overwrite: bool = False):
        self.path, self.dtype = options["path"], np.dtype(options.get("dtype", "float32"))
        self.gain, self.offset = float(options.get("gain", 1)), float(options.get("offset", 0))
        os.makedirs(self.path, exist_ok=True)
        self.stale = [n for n in os.listdir(self.path) if n.endswith(".dat")] if overwrite else []

    def write(self, rows: Iterator) -> WriterCommitMessage:
        done = []
        for row in rows:
            x = samples(row)[row.before : row.before + row.n] / np.float32(self.gain) + np.float32(self.offset)
            if self.dtype.kind in "iu":
                x = np.clip(np.rint(x), np.iinfo(self.dtype).min, np.iinfo(self.dtype).max)
            part = os.path.join(self.path, f"_{row.t_start:020d}-{uuid.uuid4().hex}")
            with open(part, "wb") as f:
                f.write(np.ascontiguousarray(x).astype(self.dtype).tobytes())
            os.replace(part, os.path.join(self.path, f"{row.t_start:020d}.dat"))
            done.append(f"{row.t_start:020d}.dat")
        return Written(done)

    def commit(self, messages: list) -> None:
        """Chunks of an earlier recording go once the new ones are all in place."""
        kept = {n for m in messages if m for n in m.names}
        for name in set(self.stale) - kept:
            os.remove(os.path.join(self.path, name))
        self._sweep()

    def abort(self, messages: list) -> None:
        """What was put in place stays, as a new run puts the same there; halves go."""
        self._sweep()

    def _sweep(self) -> None:
        for name in os.listdir(self.path):
            if name.startswith("_") and "-" in name:
                os.remove(os.path.join(self.path, name))


class Recording(DataSource):
    """``spark.read.format("recording")``: a row for each chunk of ``chunk`` steps, its samples as float32 in C order (time, channel),
    ``before`` of them and up to ``halo`` after from the neighbours. Options: path (which executors can open; several, comma between,
    follow each other in time; a folder of .dat files is read in their order), layout (see ``layouts.READERS``), keep (channels,
    comma between), chunk, halo, start and stop (steps; nothing outside is read), every (one step of so many, counted anew from 0), and for raw_binary channels, dtype, header bytes, gain and offset. A torn last step is not read.

    ``df.write.format("recording").mode("append")`` writes chunks without their halos into the folder ``path``; options dtype, gain, offset.
    ``mode("overwrite")`` removes the chunks of an earlier recording that the new one does not replace."""

    @classmethod
    def name(cls) -> str:
        return "recording"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RecordingReader:
        return RecordingReader(self.options)

    def writer(self, schema, overwrite: bool) -> ChunkWriter:
        return ChunkWriter(self.options, overwrite)


def register(spark) -> None:
    spark.dataSource.register(Recording)


def samples(row) -> np.ndarray:
    return np.frombuffer(row.samples, np.float32).reshape(-1, row.channels)
