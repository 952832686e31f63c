"""Operators on chunks of a recording: filters, thresholds, whitening, crossings, fitted templates, clusters of each electrode.

A chunk's own steps lie between halos of its neighbours, so every chunk is worked on alone and an event belongs to the chunk that
owns its time: nothing is shuffled but small sums by channel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..sources.raw import SCHEMA


def _by_chunk(chunks: DataFrame, schema: str, work: Callable[[np.ndarray, dict], dict[str, np.ndarray]]) -> DataFrame:
    """One chunk after another goes through ``work``, as (time, channel) with its halos and its other columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in ("chunk_id", "t_start", "n", "before", "channels")}
                x = np.frombuffer(batch.column("samples")[i].as_buffer(), np.float32).reshape(-1, row["channels"])
                out = work(x, row)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    arrow = pa.schema([pa.field(n, {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "boolean": pa.bool_()}[t]) for n, t in (c.split() for c in schema.split(", "))])
    return chunks.select("chunk_id", "t_start", "n", "before", "channels", "samples").mapInArrow(run, schema)


def _same(row: dict, x: np.ndarray) -> dict:
    return {**{k: [v] for k, v in row.items()}, "samples": [np.ascontiguousarray(x, np.float32).tobytes()]}


def band_pass(chunks: DataFrame, order: int, low: float, high: float, rate: float, saturation: float | None = None, common: bool = False, shanks: list[list[int]] | None = None, grounds: dict[int, int] | None = None) -> DataFrame:
    """Chunks after a zero-phase Butterworth filter. Each channel's median over the chunk goes; steps beyond ``saturation`` become 0; with
    ``common`` each step's median over the channels goes too, over each of ``shanks`` by itself where they are given. ``grounds`` names a
    channel for others, whose signal is taken from theirs first. Halos are filtered like the rest and stay."""
    sections = kernels.butter(order, low, high, rate)

    def work(x, row):
        ground = {c: x[:, g] for c, g in (grounds or {}).items()}
        x = np.column_stack([x[:, c] - ground[c] if c in ground else x[:, c] for c in range(x.shape[1])])
        y = kernels.filtfilt(x, sections)
        own = y[row["before"] : row["before"] + row["n"]]
        y = y - np.median(own, axis=0)
        if saturation is not None:
            y[np.abs(x) >= saturation] = 0
        for own in (shanks or [list(range(y.shape[1]))]) if common else []:
            y[:, own] -= np.median(y[:, own], axis=1, keepdims=True)
        return _same(row, y)

    return _by_chunk(chunks, SCHEMA, work)


def saturated(chunks: DataFrame, level: float) -> DataFrame:
    """(channel, t, amp) of every step at or beyond ``level``."""

    def work(x, row):
        own = x[row["before"] : row["before"] + row["n"]]
        t, c = np.nonzero(np.abs(own) >= level)
        return {"channel": c, "t": t + row["t_start"], "amp": own[t, c]}

    return _by_chunk(chunks, "channel int, t long, amp double", work)


def deviations(chunks: DataFrame) -> DataFrame:
    """(channel, mad, chunks): the mean over all chunks of each channel's median absolute deviation."""

    def work(x, row):
        own = x[row["before"] : row["before"] + row["n"]]
        return {"channel": np.arange(own.shape[1]), "mad": np.median(np.abs(own - np.median(own, axis=0)), axis=0)}

    return _by_chunk(chunks, "channel int, mad double", work).groupBy("channel").agg(F.avg("mad").alias("mad"), F.count(F.lit(1)).alias("chunks"))


def covariance(chunks: DataFrame) -> DataFrame:
    """(i, j, covariance) of channels over all steps. Tasks send sums of products, not samples."""

    def work(x, row):
        own = x[row["before"] : row["before"] + row["n"]].astype(np.float64)
        c = own.shape[1]
        i, j = np.divmod(np.arange(c * c), c)
        total = own.sum(axis=0)
        return {"i": i, "j": j, "n": np.full(c * c, len(own)), "xy": (own.T @ own).ravel(), "x": total[i], "y": total[j]}

    sums = _by_chunk(chunks, "i int, j int, n long, xy double, x double, y double", work).groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in ("n", "xy", "x", "y")))
    return sums.select("i", "j", (F.col("xy") / F.col("n") - F.col("x") / F.col("n") * F.col("y") / F.col("n")).alias("covariance"))


def whiten(chunks: DataFrame, matrix: np.ndarray) -> DataFrame:
    """Chunks times a whitening matrix, such as ``kernels.whitening`` makes of a covariance by channel pairs."""
    return _by_chunk(chunks, SCHEMA, lambda x, row: _same(row, x @ matrix))


def crossings(chunks: DataFrame, thresholds: np.ndarray, distance: int, sign: int = -1) -> DataFrame:
    """(channel, t, amp): peaks at or beyond each channel's threshold. ``sign``: -1 troughs, 1 peaks, 0 both."""

    def work(x, row):
        found = []
        for c, limit in enumerate(thresholds):
            v = x[:, c] * sign if sign else np.abs(x[:, c])
            at = kernels.find_peaks(v, limit, distance)
            at = at[(at >= row["before"]) & (at < row["before"] + row["n"])]
            found.append((np.full(len(at), c), at - row["before"] + row["t_start"], x[at, c]))
        return dict(zip(("channel", "t", "amp"), map(np.concatenate, zip(*found, strict=True)), strict=True))

    return _by_chunk(chunks, "channel int, t long, amp double", work)


def fit(chunks: DataFrame, templates: np.ndarray, low, high, second: np.ndarray | None = None, least_second: float = 0.0, thresholds: np.ndarray | None = None, sign: int = -1) -> DataFrame:
    """(template, t, amp, amp2): events by greedy matching, at the middle of their template. Halos must be two templates long or more.

    ``low`` and ``high``: numbers, or one for each template. With ``thresholds`` by channel only steps where some channel has a peak
    beyond its own are looked at.
    """
    middle, n = templates.shape[1] // 2, len(templates)
    bounds = np.column_stack([np.broadcast_to(low, n), np.broadcast_to(high, n)])

    def work(x, row):
        places = None
        if thresholds is not None:
            v = x * sign if sign else np.abs(x)
            places = np.unique(np.concatenate([kernels.find_peaks(v[:, c], limit) for c, limit in enumerate(thresholds)])) - middle
        found = kernels.match(np.asarray(x, np.float64), templates, bounds, second, least_second, places)
        at = found[:, 1].astype(np.int64) + middle
        own = (at >= row["before"]) & (at < row["before"] + row["n"])
        return {"template": found[own, 0].astype(np.int32), "t": at[own] - row["before"] + row["t_start"], "amp": found[own, 2], "amp2": found[own, 3]}

    return _by_chunk(chunks, "template int, t long, amp double, amp2 double", work)


def unfitted(crossed: DataFrame, spikes: DataFrame, reach: int) -> DataFrame:
    """Crossings (channel, t, amp) with no fitted spike within ``reach`` steps: the garbage of each channel."""
    from . import joins

    marked = crossed.withColumn("event_id", F.xxhash64("channel", "t"))
    return joins.matched(marked.withColumn("_one", F.lit(0)), spikes.select(F.lit(0).alias("_one"), "t"), ["_one"], reach + 1).where("not hit").select(*crossed.columns)


def snippets(chunks: DataFrame, spikes: DataFrame, before: int, after: int, length: int) -> DataFrame:
    """(event_id, waveform): samples around each of ``spikes`` (event_id, t), channel after channel, from the chunk that owns it; those
    that the halo does not reach are left out. Spikes meet chunks by equality on the chunk's number, all chunks but the last being of
    ``length`` steps; a chunk's spikes are as many as its steps allow."""
    listed = spikes.select(F.floor(F.col("t") / length).cast("long").alias("chunk_id"), "event_id", "t").groupBy("chunk_id").agg(F.collect_list(F.struct("event_id", "t")).alias("spikes"))

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                x = np.frombuffer(r["samples"], np.float32).reshape(-1, r["channels"])
                base = r["before"] - r["t_start"]
                kept = [s for s in r["spikes"] if s["t"] + base >= before and s["t"] + base + after < len(x)]
                waves = [x[s["t"] + base - before : s["t"] + base + after + 1].T.ravel() for s in kept]
                yield pa.RecordBatch.from_arrays([pa.array([s["event_id"] for s in kept], pa.int64()), pa.array(waves, pa.list_(pa.float32()))], names=["event_id", "waveform"])

    return chunks.join(listed, "chunk_id").mapInArrow(run, "event_id long, waveform array<float>")


def clusters(points: DataFrame, k: int, clusters: int) -> DataFrame:
    """(electrode, point_id, cluster) by density peaks from (electrode, point_id, features); a group is an electrode's bounded sample.
    Points with missing features are left out; ties go to the smaller point_id."""

    def run(pdf):
        pdf = pdf.sort_values("point_id")
        x = np.array(pdf["features"].tolist(), np.float64)
        pdf["cluster"] = kernels.density_clusters(x, k, clusters) if len(x) > 1 else 0
        return pdf[["electrode", "point_id", "cluster"]]

    clean = points.where(F.col("features").isNotNull() & ~F.exists("features", lambda v: v.isNull() | F.isnan(v)))
    return clean.groupBy("electrode").applyInPandas(run, "electrode long, point_id long, cluster int")


def long_view(chunks: DataFrame, decimals: int = 6) -> DataFrame:
    """(t, channel, v): a row for each sample that a chunk owns, rounded."""

    def work(x, row):
        own = np.round(x[row["before"] : row["before"] + row["n"]].astype(np.float64), decimals)
        t, c = np.divmod(np.arange(own.size), own.shape[1])
        return {"t": t + row["t_start"], "channel": c, "v": own.ravel()}

    return _by_chunk(chunks, "t long, channel int, v double", work)


def whitening_matrix(chunks: DataFrame) -> np.ndarray:
    """From the covariance of all chunks; the driver receives one number for each two channels."""
    rows = covariance(chunks).collect()
    c = np.zeros((max((r.i for r in rows), default=-1) + 1,) * 2)
    for r in rows:
        c[r.i, r.j] = r.covariance
    return kernels.whitening(c)


def quota(points: DataFrame, n: int, by: str = "electrode", id: str = "point_id") -> DataFrame:
    """The bounded sample of each electrode that is clustered: the ``n`` points with the least hash of their id."""
    line = Window.partitionBy(by).orderBy(F.xxhash64(id), id)
    return points.withColumn("_r", F.row_number().over(line)).where(F.col("_r") <= n).drop("_r")


def matched(chunks: DataFrame, wave: np.ndarray) -> DataFrame:
    """Chunks convolved in time with a mean waveform, turned about and of unit weight: what a spike of that shape stands out in.
    ``deviations`` of these give the thresholds. Halos must be half the waveform long or more."""
    filter_ = wave[::-1] / (np.abs(wave.sum()) * len(wave) if wave.sum() else np.abs(wave).sum())
    return _by_chunk(chunks, SCHEMA, lambda x, row: _same(row, np.column_stack([np.convolve(x[:, c], filter_, "same") for c in range(x.shape[1])])))


def artefacts(chunks: DataFrame, triggers: DataFrame, tau: int, length: int) -> DataFrame:
    """(label, lag, channel, v): the median of what follows the triggers (label, t) of each label, for ``tau`` steps. Halos must be that long."""
    from . import robust

    marked = triggers.withColumn("event_id", F.xxhash64("label", "t"))
    waves = snippets(chunks, marked, 0, tau - 1, length).join(marked.select("event_id", "label"), "event_id")
    values = waves.select("label", F.posexplode("waveform").alias("k", "w"))
    placed = values.select("label", (F.col("k") % tau).alias("lag"), F.floor(F.col("k") / tau).cast("int").alias("channel"), F.col("w").cast("double").alias("w"))
    return robust.median(placed, ["label", "lag", "channel"], "w", "v")


def remove_artefacts(chunks: DataFrame, triggers: DataFrame, shapes: dict[int, np.ndarray], length: int) -> DataFrame:
    """Chunks without the artefact (lag, channel) that follows each trigger (label, t). Triggers meet the chunks that their artefact reaches by
    equality on the chunk's number; shapes are one for each label."""
    reach = max((len(s) for s in shapes.values()), default=1)
    at = F.sequence(F.floor(F.greatest(F.col("t") - reach, F.lit(0)) / length), F.floor((F.col("t") + reach) / length))
    listed = triggers.where(F.col("label").isin(list(shapes))).select("label", "t", F.explode(at).alias("chunk_id")).groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("t", "label"))).alias("triggers"))

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                x = np.frombuffer(r["samples"], np.float32).reshape(-1, r["channels"]).copy()
                for g in r["triggers"] or ():
                    first = g["t"] - r["t_start"] + r["before"]
                    a, b = max(first, 0), min(first + len(shapes[g["label"]]), len(x))
                    if a < b:
                        x[a:b] -= shapes[g["label"]][a - first : b - first].astype(np.float32)
                names = ["chunk_id", "t_start", "n", "before", "channels"]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
                yield pa.record_batch([*(pa.array([r[n]], k) for n, k in zip(names, kinds, strict=True)), pa.array([x.tobytes()], pa.binary())], names=[*names, "samples"])

    return chunks.join(listed, "chunk_id", "left").mapInArrow(run, SCHEMA)


def silent_periods(crossed: DataFrame, steps: int, safety: int, least: int) -> DataFrame:
    """(start, stop): stretches of ``least`` steps or more of a recording of ``steps`` that no crossing (t) comes nearer to than ``safety``; a
    covariance of noise is taken there. The loud zones are coalesced in buckets and what lies between them is left."""
    from pyspark.sql import Window

    from . import joins

    spark = crossed.sparkSession
    ends = spark.createDataFrame([(-1, 0), (steps, steps + 1)], "start long, stop long")
    loud = crossed.select((F.col("t") - safety).alias("start"), (F.col("t") + safety + 1).alias("stop")).unionByName(ends)
    zones = joins.coalesce_intervals(loud, 1 << 20)
    gaps = zones.select(F.col("stop").alias("start"), F.lead("start").over(Window.orderBy("start")).alias("stop"))  # one row for each zone
    clipped = gaps.select(F.greatest("start", F.lit(0)).alias("start"), F.least("stop", F.lit(steps)).alias("stop"))
    return clipped.where(F.col("stop") - F.col("start") >= least)
