"""Synthetic benchmarks: copies of templates put into a recording at known times.

What happens in a chunk follows from the seed and the chunk's number alone, so a task that runs again, or chunks dealt otherwise,
give the same recording and the same truth. Chunks must come without halos: no copy reaches over a chunk's border.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from ..sources.raw import SCHEMA
from .recording import _by_chunk, _same


@dataclass(frozen=True)
class Injection:
    """Units to inject: the template and the scale of each, its rate in Hz, and for drifts the slope of its amplitude over five minutes.

    ``shared``: the share of one common train that each unit keeps, in place of trains of their own.
    """

    templates: tuple[int, ...]
    scales: tuple[float, ...]
    rates: tuple[float, ...]
    slopes: tuple[float, ...] | None = None
    shared: float | None = None


def kind(name: str, templates: int, seed: int = 0) -> Injection:
    """The units of a benchmark of that name among so many templates."""
    r = np.random.default_rng([seed, 1])
    pick = lambda n: tuple(int(k) for k in r.integers(0, templates, n))
    grid = [(i, j) for i in range(5) for j in range(5)]
    steps = np.linspace(0.5, 5, 5)
    if name == "fitting":
        return Injection(pick(25), tuple(np.linspace(0.5, 5, 25)), (10.0,) * 25)
    if name == "clustering":
        return Injection(pick(25), tuple(steps[j] for _, j in grid), tuple(np.linspace(0.5, 20, 5)[i] for i, _ in grid))
    if name == "synchrony":
        return Injection(pick(1) * 5, (2.0,) * 5, (10 / 0.2,) * 5, shared=0.2)
    if name == "pca-validation":
        return Injection(pick(10), tuple(r.uniform(0.5, 5, 10)), tuple(r.uniform(0.5, 20, 10)))
    if name == "smart-search":
        return Injection(pick(1) * 10, (2.0,) * 10, tuple(1.0 + 5 * k for k in range(10)))
    if name == "drifts":
        return Injection(pick(25), tuple(steps[j] for _, j in grid), (5.0,) * 25, slopes=tuple(r.standard_normal(25)))
    raise ValueError(f"no such benchmark: {name}")


def shuffled(templates: np.ndarray, injection: Injection, seed: int = 0) -> np.ndarray:
    """The waveforms (unit, time, channel) to inject: each unit's template with its channels in another order, scaled."""
    r = np.random.default_rng([seed, 2])
    waves = []
    for k, scale in zip(injection.templates, injection.scales, strict=True):
        order = r.permutation(templates.shape[2])
        waves.append(scale * templates[k][:, order])
    return np.array(waves)


def _trains(injection: Injection, row: dict, rate: float, margin: int, refractory: int, seed: int) -> list[np.ndarray]:
    """The times of each unit in a chunk."""
    r = np.random.default_rng([seed, 3, row["chunk_id"]])
    n, trains = row["n"], []
    mother = np.flatnonzero(r.random(n) < injection.rates[0] / rate) if injection.shared is not None else None
    for hertz in injection.rates:
        at = np.flatnonzero(r.random(n) < hertz / rate) if mother is None else mother[r.random(len(mother)) < injection.shared]
        kept, last = [], -refractory
        for t in at[(at >= margin) & (at < n - margin)]:
            if t - last > refractory:
                kept.append(t)
                last = t
        trains.append(np.array(kept, np.int64))
    return trains


def _inject(x: np.ndarray, row: dict, waves: np.ndarray, injection: Injection, rate: float, seed: int) -> tuple[np.ndarray, list[tuple]]:
    t = waves.shape[1]
    half, out, truth = t // 2, np.array(x, np.float64), []
    for u, train in enumerate(_trains(injection, row, rate, t, int(0.005 * rate), seed)):
        wave, power = waves[u], (waves[u] ** 2).sum()
        best = int(np.unravel_index(np.abs(wave).argmax(), wave.shape)[1])
        for at in train:
            amplitude = 1.0 + (injection.slopes[u] * (at + row["t_start"]) / (300 * rate) if injection.slopes else 0.0)
            part = out[at - half : at - half + t]
            part += amplitude * wave
            truth.append((u, int(at + row["t_start"]), amplitude, float((part * wave).sum() / power), float(out[at, best])))
    return out, truth


def inject(chunks: DataFrame, waves: np.ndarray, injection: Injection, rate: float, seed: int = 0) -> DataFrame:
    """The chunks with the copies in them."""
    return _by_chunk(chunks, SCHEMA, lambda x, row: _same(row, _inject(x, row, waves, injection, rate, seed)[0]))


def truth(chunks: DataFrame, waves: np.ndarray, injection: Injection, rate: float, seed: int = 0) -> DataFrame:
    """(unit, t, amplitude, real_amp, voltage) of each copy: as scaled, as the recording shows it with what lies under it, and at its best channel."""

    def work(x, row):
        found = _inject(x, row, waves, injection, rate, seed)[1]
        kinds = (np.int32, np.int64, np.float64, np.float64, np.float64)
        return {n: np.array([f[k] for f in found], kind) for k, (n, kind) in enumerate(zip(("unit", "t", "amplitude", "real_amp", "voltage"), kinds, strict=True))}

    return _by_chunk(chunks, "unit int, t long, amplitude double, real_amp double, voltage double", work)


def noise(spark, steps: int, channels: int, chunk: int, deviation: float = 0.5, seed: int = 0) -> DataFrame:
    """A recording of normal noise in chunks without halos."""
    n = -(-steps // chunk)
    frame = spark.range(n).selectExpr("id as chunk_id", f"id * {chunk} as t_start", f"least({chunk}, {steps} - id * {chunk}) as n", "0 as before", f"{channels} as channels", "cast('' as binary) as samples")

    def work(_, row):
        r = np.random.default_rng([seed, 4, row["chunk_id"]])
        return _same(row, deviation * r.standard_normal((row["n"], channels)))

    return _by_chunk(frame, SCHEMA, work)
