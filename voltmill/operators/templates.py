"""Templates and waveforms as vectors: norms, similarities, neighbours and densities.

A waveform is an array of ``electrodes`` times ``steps`` values, one electrode after another. Pairs are made among templates,
which are few, or within one cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import robust

#: Waveforms of one cluster that meet as many others in one task.
BLOCK = 2048


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))


def long_view(waveforms: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """(keys, k, v): one row for each value."""
    return waveforms.select(*keys, F.posexplode(vector).alias("k", "v"))


def median_templates(waveforms: DataFrame, cluster: str, vector: str) -> DataFrame:
    """(cluster, k, v): the median of each value over a cluster's waveforms."""
    return robust.median(long_view(waveforms, [cluster], vector), [cluster, "k"], "v", "v")


def as_vectors(templates: DataFrame, cluster: str) -> DataFrame:
    """(cluster, vector) from (cluster, k, v)."""
    return templates.groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("vector"))


def pairs(templates: DataFrame, cluster: str) -> DataFrame:
    """(i, j, a, b) for every i < j; ``templates`` are as few as a recording's units and their pairs are the result itself."""
    left = templates.select(F.col(cluster).alias("i"), F.col("vector").alias("a"))
    right = templates.select(F.col(cluster).alias("j"), F.col("vector").alias("b"))
    return left.join(right, F.col("i") < F.col("j"))


def similarity(templates: DataFrame, cluster: str) -> DataFrame:
    """(i, j, similarity): normalised dot products."""
    return pairs(templates, cluster).select("i", "j", (dot(F.col("a"), F.col("b")) / (norm(F.col("a")) * norm(F.col("b")))).alias("similarity"))


def lagged(a: Column, b: Column, electrodes: int, steps: int, lag: Column) -> Column:
    """The dot product of a with b moved by ``lag`` steps on every electrode."""
    at = F.sequence(F.lit(0), F.lit(electrodes * steps - 1))
    inside = lambda k: ((k % steps) + lag).between(0, steps - 1)
    return F.aggregate(F.transform(at, lambda k: F.when(inside(k), F.get(a, k).cast("double") * F.get(b, (k + lag).cast("int"))).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)


def per_electrode(waveforms: DataFrame, keys: list[str], vector: str, steps: int) -> DataFrame:
    """(keys, electrode, low, high, energy) of each waveform's part on each electrode."""
    values = long_view(waveforms, keys, vector).withColumn("electrode", F.floor(F.col("k") / steps).cast("int"))
    return values.groupBy(*keys, "electrode").agg(F.min("v").cast("double").alias("low"), F.max("v").cast("double").alias("high"), F.sum(F.col("v").cast("double") * F.col("v")).alias("energy"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def _blocked(waveforms: DataFrame, cluster: str, schema: str, work) -> DataFrame:
    """``work(left, right)`` on every two blocks of a cluster's ``waveforms`` (cluster, i, vec, ...). A cluster is cut into blocks of about
    ``BLOCK``, so no task holds more than two, and it sends what it found of a waveform instead of its pairs."""
    sizes = waveforms.groupBy(cluster).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_blocks"))
    sized = waveforms.join(sizes, cluster)
    own = F.pmod(F.xxhash64("i"), F.col("_blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    left = sized.withColumn("_x", own).withColumn("_y", every).drop("_blocks")
    right = sized.withColumn("_y", own).withColumn("_x", every).drop("_blocks")
    keys = [cluster, "_x", "_y"]
    other = right.toDF(*(f"r_{c}" for c in right.columns))  # both sides are of one table, so names must differ
    both = left.groupBy(*keys).cogroup(other.groupBy(*(f"r_{c}" for c in keys)))
    return both.applyInArrow(lambda key, a, b: work(a, b.rename_columns([c[2:] for c in b.column_names])), schema)


def _distances(a: pa.Table, b: pa.Table, rows: int = 64) -> Iterator[tuple[int, np.ndarray]]:
    """Distances of a few rows of ``a`` at a time to all of ``b``; infinite to themselves."""
    x, y, i, j = _matrix(a.column("vec")), _matrix(b.column("vec")), a.column("i").to_numpy(), b.column("i").to_numpy()
    for at in range(0, len(x), rows):
        d = np.sqrt(((x[at : at + rows, None, :] - y[None]) ** 2).sum(axis=2))
        d[i[at : at + rows, None] == j[None]] = np.inf
        yield at, d


def density(waveforms: DataFrame, id: str, cluster: str, vector: str, k: int) -> DataFrame:
    """(cluster, i, rho): the mean of the k smallest distances to others of the cluster, of all if they are fewer; none for one alone."""

    def work(a: pa.Table, b: pa.Table) -> pa.Table:
        out = ([], [])
        if len(a) and len(b):
            i = a.column("i").to_numpy()
            for at, d in _distances(a, b):
                near = np.sort(np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, :k], axis=1)
                for row, x in enumerate(near):
                    out[0].append(i[at + row])
                    out[1].append(x[np.isfinite(x)])
        label = a.column(cluster).slice(0, 1).combine_chunks().take(pa.array(np.zeros(len(out[0]), np.int64))) if len(a) else a.column(cluster).combine_chunks()
        return pa.table({cluster: label, "i": pa.array(out[0], pa.int64()), "near": pa.array(out[1], pa.list_(pa.float64()))})

    points = waveforms.select(cluster, F.col(id).alias("i"), F.col(vector).alias("vec"))
    kind = points.schema[cluster].dataType.simpleString()
    found = _blocked(points, cluster, f"`{cluster}` {kind}, i long, near array<double>", work)
    # k distances from each block of the cluster
    nearest = F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k)
    mean = F.aggregate(nearest, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(nearest), F.lit(0))
    return found.groupBy(cluster, "i").agg(mean.alias("rho")).where("rho is not null")


def denser(waveforms: DataFrame, rho: DataFrame, id: str, cluster: str, vector: str) -> DataFrame:
    """(i, j, delta): the nearest point of higher density, which is a smaller ``rho``, ties to the smaller j; none for the densest."""

    def work(a: pa.Table, b: pa.Table) -> pa.Table:
        out = ([], [], [])
        if len(a) and len(b):
            i, j, own, other = (t.column(c).to_numpy() for t, c in ((a, "i"), (b, "i"), (a, "rho"), (b, "rho")))
            order = np.argsort(j, kind="stable")
            for at, d in _distances(a, b):
                r = own[at : at + len(d), None]
                above = (other[None] < r) | ((other[None] == r) & (j[None] < i[at : at + len(d), None]))
                d = np.where(above, d, np.inf)[:, order]
                best = d.argmin(axis=1)
                found = np.flatnonzero(np.isfinite(d[np.arange(len(d)), best]))
                for o, x in zip(out, (i[at + found], j[order][best[found]], d[found, best[found]]), strict=True):
                    o.append(x)
        return pa.table({n: pa.array(np.concatenate(o) if o else np.zeros(0), t) for n, o, t in zip(("i", "j", "distance"), out, (pa.int64(), pa.int64(), pa.float64()), strict=True)})

    points = waveforms.select(cluster, F.col(id).alias("i"), F.col(vector).alias("vec")).join(rho.select("i", "rho"), "i").select(cluster, "i", "vec", "rho")
    found = _blocked(points, cluster, "i long, j long, distance double", work)
    return found.groupBy("i").agg(F.min(F.struct("distance", "j")).alias("m")).select("i", F.col("m.j").alias("j"), F.col("m.distance").alias("delta"))


def gram(waveforms: DataFrame, vector: str) -> DataFrame:
    """(i, j, g): the mean product of values i and j, over all waveforms of the one length."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = 0.0, 0
        for batch in batches:
            if len(batch):
                x = _matrix(pa.chunked_array([batch.column(0)]))
                total, n = total + x.T @ x, n + len(x)
        if n:
            d = len(total)
            i, j = np.divmod(np.arange(d * d), d)
            yield pa.record_batch([pa.array(i), pa.array(j), pa.array(total.ravel()), pa.array(np.full(d * d, n))], names=["i", "j", "xy", "n"])

    sums = waveforms.where(F.col(vector).isNotNull()).select(vector).mapInArrow(work, "i long, j long, xy double, n long")
    return sums.groupBy("i", "j").agg((F.sum("xy") / F.sum("n")).alias("g"))


def chances(waveforms: DataFrame, templates: DataFrame, id: str, cluster: str, vector: str) -> DataFrame:
    """(i, j, chances, n): of the waveforms of cluster i how many template j explains at least as well as their own, and how many there are.

    A waveform's fit to every template is computed inside its row, against one row that holds all templates.
    """
    gathered = templates.agg(F.collect_list(F.struct(F.col(cluster).alias("j"), F.col("vector").alias("w"), dot(F.col("vector"), F.col("vector")).alias("power"))).alias("all"))
    fits = F.transform("all", lambda t: F.struct(t["j"].alias("j"), (dot(F.col(vector), t["w"]) / t["power"]).alias("b")))
    fitted = waveforms.select(F.col(cluster).alias("i"), vector).crossJoin(gathered).select("i", fits.alias("fits"))  # one row of as many templates as units
    own = F.get(F.filter("fits", lambda f: f["j"] == F.col("i")), F.lit(0))["b"]
    each = fitted.withColumn("own", own).select("i", "own", F.inline("fits")).where("i <> j")
    return each.groupBy("i", "j").agg(F.count(F.when(F.col("b") >= F.col("own"), 1)).alias("chances"), F.count(F.lit(1)).alias("n"))


def mean_fits(waveforms: DataFrame, templates: DataFrame, cluster: str, vector: str) -> DataFrame:
    """(i, j, mean): the mean amplitude with which template j explains the waveforms of cluster i.

    An amplitude is linear in the waveform, so the clusters' mean waveforms are enough, and no waveform meets a template.
    """
    means = long_view(waveforms, [cluster], vector).groupBy(cluster, "k").agg(F.avg(F.col("v").cast("double")).alias("m"))
    values = templates.select(F.col(cluster).alias("j"), F.posexplode("vector").alias("k", "w"), dot(F.col("vector"), F.col("vector")).alias("power"))
    both = means.withColumnRenamed(cluster, "i").join(values, "k")
    return both.groupBy("i", "j").agg((F.sum(F.col("m") * F.col("w").cast("double")) / F.first("power")).alias("mean"))
