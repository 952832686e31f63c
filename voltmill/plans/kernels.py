"""Queries on a recording: operators that work on chunks in numpy. Their results do not depend on how the chunks are dealt."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import kernels
from ..operators import recording, templates
from . import waveforms as wave_plans
from .tables import ELECTRODES, STEPS, WAVES, waveforms
from .tables import recording as chunks
from .waveforms import _LONG

QUERIES: dict = {}
ORACLES: dict = {}
RATE = 20_000.0

_SAMPLES = f"(SELECT vec_id * {STEPS} + k % {STEPS} AS t, k // {STEPS} AS channel, v::DOUBLE AS v FROM {_LONG})"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"SELECT t, channel::INT AS channel, round(v, 5) AS v FROM {_SAMPLES}")
def recording_samples(spark, sf):
    return recording.long_view(chunks(spark, sf), 5)


@query(f"SELECT channel::INT AS channel, round(avg(m), 5) AS mad, count(*) AS chunks FROM (SELECT channel, t // {WAVES * STEPS} AS c, mad(v) AS m FROM {_SAMPLES} GROUP BY ALL) GROUP BY channel")
def chunk_deviations(spark, sf):
    return recording.deviations(chunks(spark, sf)).select("channel", F.round("mad", 5).alias("mad"), "chunks")


@query(f"SELECT a.channel::INT AS i, b.channel::INT AS j, round(covar_pop(a.v, b.v), 5) AS covariance FROM {_SAMPLES} a JOIN {_SAMPLES} b USING (t) GROUP BY 1, 2")
def channel_covariance(spark, sf):
    return recording.covariance(chunks(spark, sf)).select("i", "j", F.round("covariance", 5).alias("covariance"))


@query(f"SELECT channel::INT AS channel, t, round(v, 5) AS amp FROM {_SAMPLES} WHERE abs(v::FLOAT) >= 0.3::FLOAT")
def saturated_samples(spark, sf):
    return recording.saturated(chunks(spark, sf), np.float32(0.3)).select("channel", "t", F.round("amp", 5).alias("amp"))


@query()
def kernel_filtfilt(spark, sf):
    """Zero-phase band-pass."""
    return recording.long_view(recording.band_pass(chunks(spark, sf), 3, 500.0, 5000.0, RATE), 4)


@query()
def kernel_find_peaks(spark, sf):
    """Troughs of each channel at or below a threshold."""
    return recording.crossings(chunks(spark, sf), np.full(ELECTRODES, 0.2), distance=4).select("channel", "t", F.round("amp", 5).alias("amp"))


@query()
def spatial_whitening(spark, sf):
    c = chunks(spark, sf)
    return recording.long_view(recording.whiten(c, recording.whitening_matrix(c)), 4)


@query()
def pca_basis(spark, sf):
    """(component, k, v): the three leading directions of the waveforms, from sums of products of the tasks."""
    rows = templates.gram(waveforms(spark, sf), "embedding").collect()  # one number for each two values of a waveform
    means = {r.k: r.m for r in templates.long_view(waveforms(spark, sf), [], "embedding").groupBy("k").agg(F.avg(F.col("v").cast("double")).alias("m")).collect()}
    d = ELECTRODES * STEPS
    g = np.zeros((d, d))
    for r in rows:
        g[r.i, r.j] = r.g
    m = np.array([means.get(k, 0.0) for k in range(d)])
    v = kernels.directions(g - np.outer(m, m), 3)
    return spark.createDataFrame([(c, k, float(round(v[c, k], 4))) for c in range(3) for k in range(d)], "component int, k int, v double")


@query()
def density_cluster(spark, sf):
    """Density peaks among the bounded sample of each electrode."""
    points = waveforms(spark, sf).select(F.col("label").cast("long").alias("electrode"), F.col("vec_id").alias("point_id"), F.col("embedding").alias("features"))
    return recording.clusters(recording.quota(points, 1000), k=5, clusters=3)


@query()
def greedy_match(spark, sf):
    """Spikes by template matching with the median templates."""
    rows = sorted((r.label, r.vector) for r in wave_plans._vectors(spark, sf).collect())  # one row for each template
    t = np.array([v for _, v in rows], np.float64).reshape(-1, ELECTRODES, STEPS).transpose(0, 2, 1)
    return recording.fit(chunks(spark, sf), t, 2.0, 12.0).select("template", "t", F.round("amp", 4).alias("amp"))
