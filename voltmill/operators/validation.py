"""How well a sorting finds known events: matches, best unions of units, and the best linear and ellipsoidal classifiers of features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import joins
from .lineage import materialise


def rates(truth: DataFrame, spikes: DataFrame, tolerance: int) -> DataFrame:
    """(unit, template, found, n_truth, hits, n_spikes): for each known unit and template that meet, the unit's events with a spike within
    ``tolerance`` steps, and the template's spikes with an event. truth: (event_id, unit, t), spikes: (event_id, template, t)."""
    a = truth.select("event_id", "unit", "t", F.lit(0).alias("_one"))
    b = spikes.select("event_id", "template", "t", F.lit(0).alias("_one"))
    met = joins.band(a, b, ["_one"], tolerance, strict=False)
    both = met.groupBy("unit", F.col("b_template").alias("template")).agg(F.countDistinct("event_id").alias("found"), F.countDistinct("b_event_id").alias("hits"))
    n = truth.groupBy("unit").agg(F.count(F.lit(1)).alias("n_truth"))
    m = spikes.groupBy("template").agg(F.count(F.lit(1)).alias("n_spikes"))
    return both.join(n, "unit").join(m, "template").select("unit", "template", "found", "n_truth", "hits", "n_spikes")


def best_template(truth: DataFrame, spikes: DataFrame, tolerance: int) -> DataFrame:
    """(unit, template, recall, precision) of the template with the best mean of both for each unit, ties to the smaller template."""
    r = rates(truth, spikes, tolerance).withColumn("recall", F.col("found") / F.col("n_truth")).withColumn("precision", F.col("hits") / F.col("n_spikes"))
    best = F.max(F.struct((F.col("recall") + F.col("precision")).alias("sum"), (-F.col("template")).alias("t"), "recall", "precision")).alias("b")
    return r.groupBy("unit").agg(best).select("unit", (-F.col("b.t")).alias("template"), "b.recall", "b.precision")


def best_union(truth: DataFrame, spikes: DataFrame, tolerance: int) -> tuple[list[int], float, float]:
    """(templates, recall, precision): templates are added one after another, always the one that makes the mean of recall and precision
    largest, while it grows; ties to the smaller. ``truth``: the events (event_id, t) of one unit. The events stay on the executors; of each template that meets
    the unit the driver receives its counts."""
    a = truth.select("event_id", "t", F.lit(0).alias("_one"))
    b = spikes.select("event_id", "template", "t", F.lit(0).alias("_one"))
    met = materialise(joins.band(a, b, ["_one"], tolerance, strict=False).select("event_id", F.col("b_template").alias("template"), F.col("b_event_id").alias("spike")))
    n = truth.count()
    hits = {r.template: r.hits for r in met.groupBy("template").agg(F.countDistinct("spike").alias("hits")).collect()}
    sizes = {r.template: r["count"] for r in spikes.groupBy("template").count().collect() if r.template in hits}
    chosen: list[int] = []
    found, hit, size, best = 0, 0, 0, 0.0
    while n:
        done = met.where(F.col("template").isin(chosen)).select("event_id").distinct() if chosen else met.limit(0).select("event_id")
        more = met.join(done, "event_id", "left_anti").groupBy("template").agg(F.countDistinct("event_id").alias("new")).collect()
        gains = {r.template: r.new for r in more if r.template not in chosen}
        scored = [(((found + gains.get(k, 0)) / n + (hit + hits[k]) / (size + sizes[k])) / 2, -k) for k in hits if k not in chosen]
        if not scored or max(scored)[0] <= best:
            break
        best, k = max(scored)
        k = -k
        chosen.append(k)
        found, hit, size = found + gains.get(k, 0), hit + hits[k], size + sizes[k]
    return chosen, found / n if n else 0.0, hit / size if size else 0.0


def quadratic(features: np.ndarray, pairwise: bool = True) -> np.ndarray:
    """Rows with their squares, and with the products of each two values."""
    n, d = features.shape
    i, j = np.triu_indices(d) if pairwise else (np.arange(d), np.arange(d))
    return np.concatenate([features, features[:, i] * features[:, j]], axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 0))


def _sums(points: DataFrame, columns: list, work) -> np.ndarray | None:
    """The sum over tasks of the arrays that ``work`` makes of batches of ``columns``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                x = work(*batch.columns)
                total = x if total is None else total + x
        if total is not None:
            yield pa.record_batch([pa.array([k for k in range(len(total))], pa.int32()), pa.array(total)], names=["k", "x"])

    rows = points.select(*columns).mapInArrow(run, "k int, x double").groupBy("k").agg(F.sum("x").alias("x")).collect()  # a model's size
    if not rows:
        return None
    out = np.zeros(len(rows))
    for r in rows:
        out[r.k] = r.x
    return out


def ellipsoid(points: DataFrame, features: str = "features", good: str = "good") -> tuple[np.ndarray, np.ndarray]:
    """(centre, inverse covariance) of the good points, from sums of products."""

    def work(x, _):
        x = _matrix(x)
        return np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])

    s = _sums(points.where(good), [features, good], work)
    if s is None:
        raise ValueError("there is no good point")
    d = int((np.sqrt(4 * len(s) - 3) - 1) // 2)
    centre = s[1 : d + 1] / s[0]
    return centre, np.linalg.pinv(s[d + 1 :].reshape(d, d) / s[0] - np.outer(centre, centre))


def mahalanobis(features: str, centre: np.ndarray, inverse: np.ndarray) -> Column:
    """The squared distance of a column of features."""
    x = F.zip_with(F.col(features), F.array(*map(F.lit, centre.tolist())), lambda a, b: a - b)
    rows = F.array(*(F.array(*map(F.lit, r)) for r in inverse.tolist()))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return dot(x, F.transform(rows, lambda r: dot(r, x)))


def weighted_logistic(points: DataFrame, weight: float, features: str = "features", good: str = "good", ridge: float = 1e-3, rounds: int = 30) -> np.ndarray:
    """Coefficients, the constant first, of a logistic regression in which a good point counts ``weight`` times. Every step of Newton's method
    is one pass, in which the tasks add up gradient and curvature."""
    first = points.select(F.size(features).alias("d")).limit(1).collect()
    d = (first[0].d if first else 0) + 1
    beta = np.zeros(d)
    for _ in range(rounds):

        def work(x, y, beta=beta):
            x = _matrix(x)
            x = np.column_stack([np.ones(len(x)), x])
            y = y.to_numpy(zero_copy_only=False).astype(np.float64)
            w = np.where(y > 0, weight, 1.0)
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            return np.concatenate([x.T @ (w * (y - p)), ((x * (w * p * (1 - p))[:, None]).T @ x).ravel()])

        s = _sums(points, [features, good], work)
        if s is None:
            break
        step = np.linalg.solve(s[d:].reshape(d, d) + ridge * np.eye(d), s[:d] - ridge * beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def decision(features: str, beta: np.ndarray) -> Column:
    """The linear score of a column of features."""
    return F.aggregate(F.zip_with(F.col(features), F.array(*map(F.lit, beta[1:].tolist())), lambda a, b: a * b), F.lit(float(beta[0])), lambda s, v: s + v)


def balanced_rates(points: DataFrame, weights: list[float], features: str = "features", good: str = "good") -> list[tuple[float, float, float]]:
    """(weight, true positive rate, false positive rate) of the classifier of each class weight."""
    out = []
    for weight in weights:
        yes = decision(features, weighted_logistic(points, weight, features, good)) > 0
        n = lambda p: F.count(F.when(p, 1))
        r = points.agg(n(yes & F.col(good)).alias("tp"), n(yes & ~F.col(good)).alias("fp"), n(F.col(good)).alias("p"), n(~F.col(good)).alias("n")).first()
        out.append((weight, r.tp / max(r.p, 1), r.fp / max(r.n, 1)))
    return out
