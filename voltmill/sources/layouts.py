"""Where a recording's samples lie in its files, by format, and which formats there are.

Every format here is a header and then records of one fixed numpy dtype, whose field ``x`` holds samples by time and channel. A reader
therefore needs no parser of its own: it maps the records that a chunk touches.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .probefile import natural_key


@dataclass(frozen=True)
class Block:
    """Records of one file: ``x`` is (time, channel), or (channel, time) if ``channels_first``; microvolts are (x - offset) * gain."""

    path: str
    skip: int
    record: np.dtype
    records: int
    channels_first: bool = False
    gain: float | np.ndarray = 1.0
    offset: float = 0.0

    @property
    def per(self) -> int:
        return self.record["x"].shape[1 if self.channels_first else 0]

    @property
    def channels(self) -> int:
        return self.record["x"].shape[0 if self.channels_first else 1]

    @property
    def steps(self) -> int:
        return self.per * self.records

    def read(self, low: int, high: int) -> np.ndarray:
        first, last = low // self.per, -(-high // self.per)
        rows = np.memmap(self.path, self.record, "r", self.skip, (self.records,))["x"][first:last]
        if self.channels_first and len(rows) == 1:
            x = rows[0, :, low - first * self.per : high - first * self.per].T
        else:
            x = (rows.transpose(0, 2, 1) if self.channels_first else rows).reshape(-1, self.channels)[low - first * self.per : high - first * self.per]
        return (x.astype(np.float32) - np.float32(self.offset)) * np.asarray(self.gain, np.float32)


@dataclass(frozen=True)
class Layout:
    """Spans that follow each other in time; the blocks of a span lie side by side, channel after channel."""

    spans: tuple[tuple[Block, ...], ...]
    rate: float | None = None

    @property
    def lengths(self) -> list[int]:
        return [min(b.steps for b in span) for span in self.spans]

    @property
    def steps(self) -> int:
        return sum(self.lengths)

    @property
    def channels(self) -> int:
        return sum(b.channels for b in self.spans[0]) if self.spans else 0

    def read(self, low: int, high: int) -> np.ndarray:
        """float32 (time, channel) of the steps from ``low`` to before ``high``."""
        out, at = [np.empty((0, self.channels), np.float32)], 0
        for span, n in zip(self.spans, self.lengths, strict=True):
            a, b = max(low - at, 0), min(high - at, n)
            if a < b:
                out.append(np.concatenate([block.read(a, b) for block in span], axis=1))
            at += n
        return np.concatenate(out)


def _plain(dtype, per: int, channels: int, head: int = 0, tail: int = 0) -> np.dtype:
    return np.dtype([("head", f"V{head}"), ("x", dtype, (per, channels)), ("tail", f"V{tail}")] if head or tail else [("x", dtype, (per, channels))])


def _whole(path: str, skip: int, record: np.dtype) -> int:
    """Complete records after the header; a torn last one is not read."""
    return max(0, os.path.getsize(path) - skip) // record.itemsize


def _interleaved(path: str, skip: int, dtype, channels: int, gain=1.0, offset=0.0, rate=None) -> Layout:
    record = _plain(dtype, 1, channels)
    return Layout(((Block(path, skip, record, _whole(path, skip, record), False, gain, offset),),), rate)


def raw_binary(path: str, options: dict) -> Layout:
    """Interleaved samples after ``header`` bytes. Needs ``channels``; dtype float32 unless named."""
    rate = float(options["rate"]) if "rate" in options else None
    return _interleaved(path, int(options.get("header", 0)), np.dtype(options.get("dtype", "float32")), int(options["channels"]), float(options.get("gain", 1)), float(options.get("offset", 0)), rate)


def npy(path: str, options: dict) -> Layout:
    """A numpy array of one or two dimensions, or three with a first of 1; the longer axis is time, the first if both are alike."""
    data = np.lib.format.open_memmap(path, "r")
    skip, shape = data.offset, data.shape[1:] if data.ndim == 3 else data.shape
    if data.ndim == 3 and data.shape[0] != 1 or not 1 <= len(shape) <= 2:
        raise ValueError(f"{path}: an array of shape {data.shape} is no recording")
    rows, columns = shape if len(shape) == 2 else (shape[0], 1)
    time_first, fortran = rows >= columns, len(shape) == 2 and data.flags.f_contiguous and not data.flags.c_contiguous
    steps, channels = (rows, columns) if time_first else (columns, rows)
    if time_first != fortran:
        record, records, first = np.dtype([("x", data.dtype, (1, channels))]), steps, False
    else:
        record, records, first = np.dtype([("x", data.dtype, (channels, steps))]), 1, True
    return Layout(((Block(path, skip, record, records, first, float(options.get("gain", 1)), float(options.get("offset", 0))),),))


# fixed values: the type codes of an mda file
MDA_TYPES = {-2: "<u1", -3: "<f4", -4: "<i2", -5: "<i4", -6: "<u2", -7: "<f8", -8: "<u4"}


def mda(path: str, options: dict) -> Layout:
    """Channels by time, the channel fastest; sizes have 64 bits where the number of dimensions is negative."""
    with open(path, "rb") as f:
        code, _, dims = struct.unpack("<3i", f.read(12))
        sizes = np.fromfile(f, "<i8" if dims < 0 else "<i4", abs(dims))
        skip = f.tell()
    if code not in MDA_TYPES:
        raise ValueError(f"{path}: type {code} is not known")
    return _interleaved(path, skip, np.dtype(MDA_TYPES[code]), int(sizes[0]), float(options.get("gain", 1)), float(options.get("offset", 0)))


def mcs_raw(path: str, options: dict) -> Layout:
    """Interleaved 16-bit samples after a text header that ends in EOH and names streams, rate, zero and microvolts a unit."""
    with open(path, "rb") as f:
        head = f.read(1 << 16)
    end = head.index(b"EOH")
    text = head[:end].decode("latin-1")
    skip = end + 3 + (2 if head[end + 3 : end + 5] == b"\r\n" else 1 if head[end + 3 : end + 4] == b"\n" else 0)
    streams = re.search(r"Streams\s*=\s*(.*)", text)
    channels = len(re.findall(r"(?:El|Fi)_", streams[1] if streams else text))
    number = lambda name, default: float(m[1]) if (m := re.search(rf"^{name}\s*=\s*(-?[0-9.]+)", text, re.M)) else default
    zero = number("ADC zero", 0.0)
    return _interleaved(path, skip, np.dtype("<u2" if zero else "<i2"), channels, number("El", number("Fi", 1.0)), zero, number("Sample rate", None))


def _side_by_side(folder: str, suffix: str, one: Callable[[str], tuple[Block, float | None]]) -> Layout:
    paths = [folder] if os.path.isfile(folder) else [os.path.join(folder, n) for n in sorted((n for n in os.listdir(folder) if n.endswith(suffix)), key=natural_key)]
    if not paths:
        raise FileNotFoundError(f"no {suffix} files in {folder}")
    found = [one(p) for p in paths]
    return Layout((tuple(b for b, _ in found),), found[0][1])


def open_ephys(path: str, options: dict) -> Layout:
    """A folder of .continuous files, one for each channel: 1024 bytes of text, then records of 1024 samples, big-endian."""

    def one(p: str) -> tuple[Block, float | None]:
        with open(p, "rb") as f:
            text = f.read(1024).decode("latin-1")
        number = lambda name: float(m[1]) if (m := re.search(rf"{name}\s*=\s*([0-9.eE+-]+)", text)) else None
        record = _plain(">i2", 1024, 1, 12, 10)
        return Block(p, 1024, record, _whole(p, 1024, record), gain=number("bitVolts") or 1.0), number("sampleRate")

    return _side_by_side(path, ".continuous", one)


def neuralynx(path: str, options: dict) -> Layout:
    """A folder of .ncs files, one for each channel: 16 KiB of text, then records of 512 samples; inverted inputs are turned round."""

    def one(p: str) -> tuple[Block, float | None]:
        with open(p, "rb") as f:
            text = f.read(16384).decode("latin-1")
        value = lambda name: m[1] if (m := re.search(rf"-{name}\s+(\S+)", text)) else None
        gain = float(value("ADBitVolts") or 1e-6) * 1e6 * (-1 if (value("InputInverted") or "").lower() == "true" else 1)
        record = _plain("<i2", 512, 1, 20)
        rate = value("SamplingFrequency")
        return Block(p, 16384, record, _whole(p, 16384, record), gain=gain), float(rate) if rate else None

    return _side_by_side(path, ".ncs", one)


class _Fields:
    """Little-endian fields read one after another."""

    def __init__(self, f):
        self.f = f

    def take(self, form: str) -> tuple:
        return struct.unpack("<" + form, self.f.read(struct.calcsize("<" + form)))

    def text(self) -> str:
        """A length in bytes and UTF-16; the greatest length means none."""
        (n,) = self.take("I")
        return "" if n == 0xFFFFFFFF else self.f.read(n).decode("utf-16-le")


def intan(path: str, options: dict) -> Layout:
    """An .rhd file: amplifier channels in blocks of 60 samples (version 1) or 128 (version 2 on), in microvolts."""
    with open(path, "rb") as f:
        fields = _Fields(f)
        magic, major, minor, rate = fields.take("Ihhf")
        if magic != 0xC6912702:
            raise ValueError(f"{path} is no .rhd file")
        fields.take("h6fh2f")
        for _ in range(3):
            fields.text()
        version = (major, minor)
        sensors = fields.take("h")[0] if version >= (1, 1) else 0
        if version >= (1, 3):
            fields.take("h")
        if version >= (2, 0):
            fields.text()
        kinds = [0] * 6  # amplifier, auxiliary, supply, board analogue, digital in, digital out
        for _ in range(fields.take("h")[0]):
            fields.text(), fields.text()
            _, channels, _ = fields.take("3h")
            for _ in range(channels):
                fields.text(), fields.text()
                _, _, kind, enabled, *_ = fields.take("10h2f")
                kinds[kind] += bool(enabled)
        skip = f.tell()
    n = 128 if major >= 2 else 60
    after = 2 * (kinds[1] * (n // 4) + kinds[2] + sensors + kinds[3] * n + bool(kinds[4]) * n + bool(kinds[5]) * n)
    record = np.dtype([("time", "<i4", (n,)), ("x", "<u2", (kinds[0], n))] + ([("rest", f"V{after}")] if after else []))
    return Layout(((Block(path, skip, record, _whole(path, skip, record), True, 0.195, 32768.0),),), rate)


def nsx(path: str, options: dict) -> Layout:
    """An NSx file of version 2.2 on: packets of interleaved samples follow each other, each channel with its own range."""
    with open(path, "rb") as f:
        fields = _Fields(f)
        if f.read(8) not in (b"NEURALCD", b"BRSMPGRP"):
            raise ValueError(f"{path} is no NSx file")
        major, _, end = fields.take("BBI")
        f.seek(286)
        period, resolution = fields.take("II")
        f.seek(310)
        (channels,) = fields.take("I")
        gains = []
        for i in range(channels):
            f.seek(314 + 66 * i + 22)
            low, high, least, most = fields.take("4h")
            gains.append((most - least) / (high - low))
        size, record, spans, at = os.path.getsize(path), np.dtype([("x", "<i2", (1, channels))]), [], end
        head = 13 if major >= 3 else 9
        while at + head <= size:
            f.seek(at + head - 4)
            (points,) = fields.take("I")
            points = min(points, (size - at - head) // record.itemsize)
            if points:
                spans.append((Block(path, at + head, record, points, False, np.array(gains, np.float32)),))
            at += head + points * record.itemsize
    return Layout(tuple(spans), resolution / period)


READERS = {"raw_binary": raw_binary, "npy": npy, "mda": mda, "mcs_raw": mcs_raw, "open_ephys": open_ephys, "neuralynx": neuralynx, "intan": intan, "nsx": nsx}

#: Formats that need a library which is not there.
UNREADABLE = {name: "needs an HDF5 library" for name in ("hdf5", "kwd", "arf", "nix", "brw", "maxwell", "nwb")} | {name: "needs the vendor's library" for name in ("neuroshare", "plexon", "mcd")}


def layout(paths: list[str], form: str, options: dict) -> Layout:
    """One recording from one path, or from several that follow each other."""
    if form in UNREADABLE:
        raise ValueError(f"{form} {UNREADABLE[form]}")
    found = [READERS[form](p, options) for p in paths]
    if len({x.channels for x in found}) > 1:
        raise ValueError("the files differ in channels")
    return Layout(tuple(span for x in found for span in x.spans), found[0].rate)


def formats(spark: SparkSession) -> DataFrame:
    """(format, readable, note) of every format known by name."""
    rows = [(n, True, (r.__doc__ or "").split(".")[0]) for n, r in READERS.items()] + [(n, False, why) for n, why in UNREADABLE.items()]
    return spark.createDataFrame(rows, "format string, readable boolean, note string")
