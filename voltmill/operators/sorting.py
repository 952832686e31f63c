"""A whole sort: crossings, waveforms, clusters of each electrode, templates, merges, bounds and the fit.

Chunks and waveforms stay on the executors; the driver holds templates, one for each unit, and what relates them to each other.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels, merging, sorting
from . import recording
from .lineage import materialise


@dataclass
class Settings:
    rate: float = 20_000.0
    steps: int = 61  # of a template, odd
    threshold: float = 6.0  # deviations
    sign: int = -1
    components: int = 5
    quota: int = 2000  # waveforms of an electrode that are clustered
    per_template: int = 500  # waveforms of a cluster that its template is made of
    metric: str = "nd-bhatta"
    parameter: float | None = None
    cc_merge: float = 0.95
    most_amplitude: float = 2.0


@dataclass
class Templates:
    """waves: (unit, time, channel); bounds: (unit, 2); electrode, size and purity of each unit."""

    waves: np.ndarray
    second: np.ndarray
    bounds: np.ndarray
    electrode: np.ndarray
    size: np.ndarray
    purity: np.ndarray


def thresholds(chunks: DataFrame, times: float, channels: int) -> np.ndarray:
    """By channel, from one number of each: ``times`` deviations."""
    out = np.full(channels, np.inf)
    for r in recording.deviations(chunks).collect():
        out[r.channel] = times * r.mad if r.mad > 0 else np.inf
    return out


def best_crossings(crossed: DataFrame, width: int) -> DataFrame:
    """(event_id, electrode, t, amp): of crossings within ``width`` steps of each other on any channel the largest, so that a spike counts
    on one electrode. Time is cut into cells of that width; a crossing stays if none of its own and the neighbouring cells beats it."""
    cell = F.floor(F.col("t") / width)
    top = crossed.withColumn("cell", cell).groupBy("cell").agg(F.max(F.struct(F.abs("amp").alias("size"), (-F.col("t")).alias("t"), (-F.col("channel")).alias("c"), "amp")).alias("top"))
    mine = top.select(F.explode(F.array(*(F.col("cell") + k for k in (-1, 0, 1)))).alias("cell"), "top", F.col("cell").alias("home"))
    beaten = mine.groupBy("cell").agg(F.max("top").alias("best"), F.max(F.when(F.col("cell") == F.col("home"), F.col("top"))).alias("own"))
    won = beaten.where("own is not null and own = best").select((-F.col("own.c")).cast("long").alias("electrode"), (-F.col("own.t")).alias("t"), F.col("own.amp").alias("amp"))
    return won.withColumn("event_id", F.xxhash64("electrode", "t"))


def cluster_electrodes(waves: DataFrame, channels: int, settings: Settings) -> DataFrame:
    """(electrode, event_id, cluster) from (electrode, event_id, waveform): the leading components of an electrode's bounded sample, density
    peaks among them, and merges of clusters that the metric takes for one. -1 for none."""
    steps = settings.steps

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("event_id")
        x = np.array(pdf["waveform"].tolist(), np.float64)
        label = np.full(len(x), -1)
        if len(x) >= 10:
            own = x.reshape(len(x), channels, steps)
            features = (x - x.mean(axis=0)) @ kernels.pca(own.reshape(len(x), -1), min(settings.components, len(x) - 1)).T
            label = sorting.density_peaks(features)
            if (label < 0).all():
                label = np.zeros(len(x), int)  # one cloud
            label, _ = merging.merge(features, label, settings.metric, settings.parameter)
        return pd.DataFrame({"electrode": pdf["electrode"].to_numpy(), "event_id": pdf["event_id"].to_numpy(), "cluster": label})

    sample = recording.quota(waves, settings.quota, id="event_id").select("electrode", "event_id", "waveform")
    return sample.groupBy("electrode").applyInPandas(work, "electrode long, event_id long, cluster int")


def extract(waves: DataFrame, clusters: DataFrame, channels: int, settings: Settings) -> list:
    """For each cluster (electrode, cluster, size, template, second, amplitudes): the median of a bounded number of its waveforms, centred, with
    channels silenced where it does not rise above what is left, and the median of the rest as second component."""
    steps = settings.steps

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("event_id").head(settings.per_template)
        x = np.array(pdf["waveform"].tolist(), np.float64).reshape(len(pdf), channels, steps)
        template = np.median(x, axis=0)
        spread = np.median(np.abs(x - template), axis=(0, 2))
        template[np.abs(template).max(axis=1) < spread] = 0
        template = sorting.centred(template, settings.sign)
        power = max(float((template**2).sum()), 1e-300)
        amplitude = (x * template).sum(axis=(1, 2)) / power
        rest = np.median(x - amplitude[:, None, None] * template, axis=0)
        rest -= (rest * template).sum() / power * template
        return pd.DataFrame({"electrode": [pdf["electrode"].iloc[0]], "cluster": [pdf["cluster"].iloc[0]], "size": [len(pdf)], "template": [template.T.ravel()], "second": [rest.T.ravel()], "amplitudes": [amplitude]})

    chosen = waves.join(clusters.where("cluster >= 0"), ["electrode", "event_id"]).select("electrode", "cluster", "event_id", "waveform")
    schema = "electrode long, cluster int, size long, template array<double>, second array<double>, amplitudes array<double>"
    return chosen.groupBy("electrode", "cluster").applyInPandas(work, schema).orderBy("electrode", "cluster").collect()


def projections(waves: DataFrame, clusters: DataFrame, channels: int, templates: np.ndarray, settings: Settings) -> dict[tuple[int, int], np.ndarray]:
    """For each cluster the amplitudes (waveform, template) of its bounded sample on all templates (n, time, channel)."""
    flat = templates.transpose(0, 2, 1).reshape(len(templates), -1)
    flat = flat / np.maximum((flat**2).sum(axis=1, keepdims=True), 1e-300)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("event_id").head(settings.per_template)
        x = np.array(pdf["waveform"].tolist(), np.float64)
        return pd.DataFrame({"electrode": [pdf["electrode"].iloc[0]], "cluster": [pdf["cluster"].iloc[0]], "amplitudes": [(x @ flat.T).ravel()]})

    chosen = waves.join(clusters.where("cluster >= 0"), ["electrode", "event_id"]).select("electrode", "cluster", "event_id", "waveform")
    rows = chosen.groupBy("electrode", "cluster").applyInPandas(work, "electrode long, cluster int, amplitudes array<double>").collect()
    return {(r.electrode, r.cluster): np.array(r.amplitudes).reshape(-1, len(templates)) for r in rows}


def find_templates(chunks: DataFrame, channels: int, settings: Settings, length: int) -> Templates:
    """From filtered chunks of ``length`` steps with halos: the templates of all units, merged across electrodes, mixtures left out."""
    half = settings.steps // 2
    limits = thresholds(chunks, settings.threshold, channels)
    crossed = recording.crossings(chunks, limits, max(1, half // 2), settings.sign)
    events = materialise(best_crossings(crossed, half))
    waves = materialise(recording.snippets(chunks, events.select("event_id", "t"), half, half, length).join(events.select("event_id", "electrode"), "event_id"))
    clusters = materialise(cluster_electrodes(waves, channels, settings))
    rows = extract(waves, clusters, channels, settings)
    shape = (len(rows), settings.steps, channels)
    stack = lambda name: np.array([r[name] for r in rows], np.float64).reshape(shape)
    t, second, sizes = stack("template"), stack("second"), np.array([r["size"] for r in rows])
    alive = (t**2).sum(axis=(1, 2)) > 0
    similar = sorting.similarity(t.transpose(0, 2, 1)) if len(rows) else np.zeros((0, 0))
    into = sorting.merge_similar(np.where(alive[:, None] & alive[None], similar, 0), sizes, settings.cc_merge)
    # amplitudes that a template must take, against those of other units' waveforms and of noise
    on = projections(waves, clusters, channels, t, settings) if len(rows) else {}
    found = []
    for i in range(len(rows)):
        good = [on[r["electrode"], r["cluster"]][:, i] for k, r in enumerate(rows) if into[k] == into[i]]
        bad = [on[r["electrode"], r["cluster"]][:, i] for k, r in enumerate(rows) if into[k] != into[i]]
        power = max(float((t[i] ** 2).sum()), 1e-300)
        noise = 3 * np.sqrt((t[i] ** 2 * (limits / settings.threshold / 0.6745)[None] ** 2).sum()) / power if np.isfinite(limits).all() else 0.0
        found.append(sorting.amplitude_bounds(np.concatenate(good), np.concatenate([*bad, noise * np.linspace(-1, 1, 101)]), settings.most_amplitude))
    bounds = np.array([f[:2] for f in found]).reshape(-1, 2)
    purity = np.array([f[2] for f in found])
    kept = np.flatnonzero((into == np.arange(len(rows))) & alive)
    mixed = sorting.mixtures(t[kept].transpose(0, 2, 1), bounds[kept], settings.cc_merge) if len(kept) else np.zeros(0, bool)
    kept = kept[~mixed]
    total = np.array([sizes[into == i].sum() for i in kept])
    return Templates(t[kept], second[kept], bounds[kept], np.array([rows[k]["electrode"] for k in kept], int), total, purity[kept])


def sort(chunks: DataFrame, channels: int, settings: Settings, length: int) -> tuple[Templates, DataFrame]:
    """(templates, spikes): the templates, and (template, t, amp, amp2) of every spike that they explain."""
    found = find_templates(chunks, channels, settings, length)
    if not len(found.waves):
        return found, chunks.sparkSession.createDataFrame([], "template int, t long, amp double, amp2 double")
    limits = thresholds(chunks, settings.threshold * 0.5, channels)
    return found, recording.fit(chunks, found.waves, found.bounds[:, 0], found.bounds[:, 1], thresholds=limits, sign=settings.sign)
