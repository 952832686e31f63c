"""Template, waveform, probe and dense-signal queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import joins, robust, templates
from ..operators import probe as probes
from .tables import PROBE, SIGNAL, probe, signal, waveforms

ELECTRODES, STEPS = 8, 8
CHUNK = 1 << 16
RADIUS = 1.5
r6 = lambda c: F.round(c, 6)

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


_LONG = "(SELECT vec_id, label, unnest(embedding) AS v, unnest(range(64)) AS k FROM embeddings)"
_TEMPLATE = f"(SELECT label, k, median(v) AS v FROM {_LONG} GROUP BY label, k)"
_VEC = f"(SELECT label, list(v ORDER BY k) AS w FROM {_TEMPLATE} GROUP BY label)"


def _template(spark, sf):
    return templates.median_templates(waveforms(spark, sf), "label", "embedding")


def _vectors(spark, sf):
    return templates.as_vectors(_template(spark, sf), "label")


@query(f"SELECT label, k, round(v::DOUBLE, 5) AS v FROM {_TEMPLATE}")
def template_median(spark, sf):
    return _template(spark, sf).select("label", F.col("k").cast("long").alias("k"), F.round(F.col("v").cast("double"), 5).alias("v"))


@query(f"SELECT label, round(sqrt(sum(v::DOUBLE * v) / {ELECTRODES * STEPS}), 6) AS norm FROM {_TEMPLATE} GROUP BY label")
def template_norm(spark, sf):
    v = F.col("v").cast("double")
    return _template(spark, sf).groupBy("label").agg(r6(F.sqrt(F.sum(v * v) / (ELECTRODES * STEPS))).alias("norm"))


@query(f"WITH r AS (SELECT l.label, l.k, l.v - t.v AS d FROM {_LONG} l JOIN {_TEMPLATE} t USING (label, k)) SELECT label, electrode, round(max(m)::DOUBLE, 5) AS mad FROM (SELECT label, k // {STEPS} AS electrode, k, mad(d) AS m FROM r GROUP BY ALL) GROUP BY ALL")
def residual_mad(spark, sf):
    values = templates.long_view(waveforms(spark, sf), ["label"], "embedding")
    rest = values.join(_template(spark, sf).withColumnRenamed("v", "m"), ["label", "k"]).withColumn("d", F.col("v").cast("double") - F.col("m"))
    return robust.mad(rest, ["label", "k"], "d").groupBy("label", F.floor(F.col("k") / STEPS).alias("electrode")).agg(F.round(F.max("mad").cast("double"), 5).alias("mad"))


@query(f"SELECT label, k // {STEPS} AS electrode, round(stddev_pop(v::DOUBLE), 5) AS sd, stddev_pop(v::DOUBLE) < 0.02 AS silent FROM {_TEMPLATE} GROUP BY ALL")
def sparsify_channels(spark, sf):
    sd = F.stddev_pop(F.col("v").cast("double"))
    return _template(spark, sf).groupBy("label", F.floor(F.col("k") / STEPS).alias("electrode")).agg(F.round(sd, 5).alias("sd"), (sd < 0.02).alias("silent"))


_SUP = f"(SELECT label, electrode FROM (SELECT label, k // {STEPS} AS electrode, stddev_pop(v::DOUBLE) AS sd FROM {_TEMPLATE} GROUP BY ALL) WHERE sd >= 0.02)"


def _support(spark, sf):
    return sparsify_channels(spark, sf).where("not silent").select("label", "electrode")


@query(f"SELECT label, round(1 - (count(*) - 1) / {ELECTRODES - 1}.0, 6) AS sparsity FROM {_SUP} GROUP BY label")
def sparsity(spark, sf):
    return _support(spark, sf).groupBy("label").agg(r6(1 - (F.count(F.lit(1)) - 1) / float(ELECTRODES - 1)).alias("sparsity"))


@query(f"SELECT a.label AS i, b.label AS j, count(*) AS common FROM {_SUP} a JOIN {_SUP} b ON a.electrode = b.electrode AND a.label < b.label GROUP BY 1, 2")
def support_intersection(spark, sf):
    s = _support(spark, sf)
    other = s.withColumnRenamed("label", "j")
    return s.withColumnRenamed("label", "i").join(other, "electrode").where("i < j").groupBy("i", "j").agg(F.count(F.lit(1)).alias("common"))


_SIM = f"(SELECT a.label AS i, b.label AS j, list_inner_product(a.w::DOUBLE[], b.w::DOUBLE[]) / sqrt(list_inner_product(a.w::DOUBLE[], a.w::DOUBLE[]) * list_inner_product(b.w::DOUBLE[], b.w::DOUBLE[])) AS s FROM {_VEC} a JOIN {_VEC} b ON a.label < b.label)"


@query(f"SELECT i, j, round(s, 5) AS similarity FROM {_SIM}")
def similarity_matrix(spark, sf):
    return templates.similarity(_vectors(spark, sf), "label").select("i", "j", F.round("similarity", 5).alias("similarity"))


@query(f"SELECT i, j, round(s, 5) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY s DESC, j) AS r FROM (SELECT i, j, s FROM {_SIM} UNION ALL SELECT j, i, s FROM {_SIM})) WHERE r <= 3")
def top_similar(spark, sf):
    s = templates.similarity(_vectors(spark, sf), "label")
    both = s.unionByName(s.select(F.col("j").alias("i"), F.col("i").alias("j"), "similarity"))
    w = Window.partitionBy("i").orderBy(F.desc("similarity"), "j")
    return both.withColumn("r", F.row_number().over(w)).where("r <= 3").select("i", "j", F.round("similarity", 5).alias("similarity"))


@query(f"SELECT i, j, round(s, 5) AS similarity FROM {_SIM} UNION ALL SELECT j, i, round(s, 5) FROM {_SIM}")
def symmetric_completion(spark, sf):
    s = similarity_matrix(spark, sf)
    return s.unionByName(s.select(F.col("j").alias("i"), F.col("i").alias("j"), "similarity"))


_LAG = f"(SELECT a.label AS i, b.label AS j, g.lag, sum(x.v::DOUBLE * y.v) AS o FROM {_VEC} a JOIN {_VEC} b ON a.label < b.label, (SELECT unnest(range(-7, 8)) AS lag) g, {_TEMPLATE} x, {_TEMPLATE} y WHERE x.label = a.label AND y.label = b.label AND y.k = x.k + g.lag AND y.k // {STEPS} = x.k // {STEPS} GROUP BY 1, 2, 3)"


def _lagged(spark, sf):
    p = templates.pairs(_vectors(spark, sf), "label").withColumn("lag", F.explode(F.sequence(F.lit(1 - STEPS), F.lit(STEPS - 1))))
    return p.select("i", "j", F.col("lag").cast("long").alias("lag"), templates.lagged(F.col("a"), F.col("b"), ELECTRODES, STEPS, F.col("lag")).alias("overlap"))


@query(f"SELECT i, j, lag, round(o, 5) AS overlap FROM {_LAG}")
def lagged_overlap(spark, sf):
    return _lagged(spark, sf).withColumn("overlap", F.round("overlap", 5))


@query(f"SELECT i, j, round(max(o), 5) AS overlap, arg_max(lag, o) AS lag FROM {_LAG} GROUP BY i, j")
def max_overlap_lag(spark, sf):
    return _lagged(spark, sf).groupBy("i", "j").agg(F.round(F.max("overlap"), 5).alias("overlap"), F.max_by("lag", "overlap").alias("lag"))


_EL = f"(SELECT vec_id, k // {STEPS} AS electrode, min(v)::DOUBLE AS low, sum(v::DOUBLE * v) AS energy FROM {_LONG} GROUP BY ALL)"


@query(f"SELECT vec_id, arg_min(electrode, low) AS electrode, round(min(low), 5) AS low FROM {_EL} GROUP BY vec_id")
def best_electrode(spark, sf):
    e = templates.per_electrode(waveforms(spark, sf), ["vec_id"], "embedding", STEPS)
    return e.groupBy("vec_id").agg(F.min_by(F.col("electrode").cast("long"), "low").alias("electrode"), F.round(F.min("low"), 5).alias("low"))


@query(f"SELECT vec_id, round(sum(electrode * energy) / sum(energy), 5) AS centre FROM {_EL} GROUP BY vec_id")
def barycentre_electrode(spark, sf):
    e = templates.per_electrode(waveforms(spark, sf), ["vec_id"], "embedding", STEPS)
    return e.groupBy("vec_id").agg(F.round(F.sum(F.col("electrode") * F.col("energy")) / F.sum("energy"), 5).alias("centre"))


_DIST = "(SELECT a.label, a.vec_id AS i, b.vec_id AS j, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]) * (z[1]::DOUBLE - z[2])))) AS d FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id)"
_RHO = f"(SELECT i, avg(d) AS rho FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r FROM {_DIST}) WHERE r <= 5 GROUP BY i)"


@query(f"SELECT i, round(rho, 5) AS rho FROM {_RHO}")
def knn_rho(spark, sf):
    return templates.density(waveforms(spark, sf), "vec_id", "label", "embedding", 5).select("i", F.round("rho", 5).alias("rho"))


@query(f"SELECT d.i, arg_min(d.j, d.d) AS j, round(min(d.d), 5) AS delta FROM {_DIST} d JOIN {_RHO} a ON a.i = d.i JOIN {_RHO} b ON b.i = d.j WHERE b.rho < a.rho GROUP BY d.i")
def denser_neighbour(spark, sf):
    w = waveforms(spark, sf)
    rho = templates.density(w, "vec_id", "label", "embedding", 5)
    return templates.denser(w, rho, "vec_id", "label", "embedding").select("i", "j", F.round("delta", 5).alias("delta"))


@query(f"SELECT label, vec_id, r AS rank FROM (SELECT e.label, e.vec_id, row_number() OVER (PARTITION BY e.label ORDER BY list_sum(list_transform(list_zip(e.embedding, t.w), lambda z: (z[1]::DOUBLE - z[2]) * (z[1]::DOUBLE - z[2]))), e.vec_id) AS r FROM embeddings e JOIN {_VEC} t USING (label)) WHERE r <= 10")
def nearest_to_centroid(spark, sf):
    w = waveforms(spark, sf).join(_vectors(spark, sf), "label").withColumn("d", templates.distance(F.col("embedding"), F.col("vector")))
    line = Window.partitionBy("label").orderBy("d", "vec_id")
    return w.withColumn("rank", F.row_number().over(line).cast("long")).where("rank <= 10").select("label", "vec_id", "rank")


@query(f"SELECT a.k AS i, b.k AS j, round(sum(a.v::DOUBLE * b.v) / (SELECT count(*) FROM embeddings), 6) AS g FROM {_LONG} a JOIN {_LONG} b USING (vec_id) WHERE a.k <= b.k GROUP BY 1, 2")
def gram_matrix(spark, sf):
    """Not centred. Each task adds up its own waveforms' products; a row for each pair of values and task is shuffled."""
    return templates.gram(waveforms(spark, sf), "embedding").where("i <= j").select("i", "j", r6("g").alias("g"))


@query(f"SELECT e.vec_id, round(list_inner_product(e.embedding::DOUBLE[], t.w::DOUBLE[]) / list_inner_product(t.w::DOUBLE[], t.w::DOUBLE[]), 4) AS amplitude, round(list_sum(list_transform(list_zip(e.embedding, t.w), lambda z: (z[1]::DOUBLE - z[2]) * (z[1]::DOUBLE - z[2]))) / 64, 6) AS mse FROM embeddings e JOIN {_VEC} t USING (label)")
def reconstruction_mse(spark, sf):
    w = waveforms(spark, sf).join(_vectors(spark, sf), "label")
    d = templates.distance(F.col("embedding"), F.col("vector"))
    a = templates.dot(F.col("embedding"), F.col("vector")) / templates.dot(F.col("vector"), F.col("vector"))
    return w.select("vec_id", F.round(a, 4).alias("amplitude"), r6(d * d / 64).alias("mse"))


@query(f"WITH b AS (SELECT e.vec_id, e.label AS i, t.label AS j, list_inner_product(e.embedding::DOUBLE[], t.w::DOUBLE[]) / list_inner_product(t.w::DOUBLE[], t.w::DOUBLE[]) AS b FROM embeddings e, {_VEC} t), own AS (SELECT vec_id, b AS own FROM b WHERE i = j) SELECT i, j, count(*) FILTER (b >= own) AS chances, count(*) AS n FROM b JOIN own USING (vec_id) WHERE i <> j GROUP BY i, j")
def confusion_nb_chances(spark, sf):
    """For each template the waveforms that another explains at least as well. A waveform meets every template, as the counts are of all pairs of both."""
    return templates.chances(waveforms(spark, sf), _vectors(spark, sf), "vec_id", "label", "embedding")


@query(f"SELECT vec_id, list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)) / 64 < 0.015 AS noise, round(sqrt(list_sum(list_transform(embedding[1:8], lambda x: x::DOUBLE * x))), 5) AS first FROM embeddings")
def noise_snippets(spark, sf):
    e = F.col("embedding")
    return waveforms(spark, sf).select("vec_id", (templates.dot(e, e) / 64 < 0.015).alias("noise"), F.round(templates.norm(F.slice(e, 1, 8)), 5).alias("first"))


_EDGES = f"(SELECT a.channel, b.channel AS neighbour FROM {PROBE} a JOIN {PROBE} b ON a.grp = b.grp AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= {RADIUS * RADIUS * 4})"


def _edges(spark, sf):
    return probes.edges(probe(spark, sf), 2 * RADIUS)


@query(f"SELECT channel, neighbour FROM {_EDGES}")
def probe_edges(spark, sf):
    return _edges(spark, sf)


@query(f"SELECT round(avg(n), 6) AS degree FROM (SELECT count(*) AS n FROM {_EDGES} GROUP BY channel)")
def mean_degree(spark, sf):
    return _edges(spark, sf).groupBy("channel").agg(F.count(F.lit(1)).alias("n")).agg(r6(F.avg("n")).alias("degree"))


@query(f"SELECT channel, row_number() OVER (ORDER BY channel) - 1 AS idx FROM {PROBE} WHERE channel % 7 <> 3")
def dead_channels(spark, sf):
    p = probe(spark, sf)
    alive = p.join(F.broadcast(p.where("channel % 7 = 3").select("channel")), "channel", "left_anti")
    return probes.dense_ids(alive).select("channel", F.col("idx").cast("long").alias("idx"))


@query(f"SELECT node_i, node_j, max(channel) AS channel FROM (SELECT a.channel AS node_i, b.channel AS node_j, c.channel, (c.x - (a.x + b.x) / 2) ** 2 + (c.y - (a.y + b.y) / 2) ** 2 AS d, min(d) OVER (PARTITION BY a.channel, b.channel) AS least FROM {PROBE} a JOIN {PROBE} b ON a.grp = b.grp AND a.channel < b.channel JOIN {PROBE} c ON c.grp = a.grp) WHERE d = least GROUP BY 1, 2")
def central_electrode(spark, sf):
    """For each two nodes of a shank the electrode nearest to the middle between them, of equally near ones the last."""
    return probes.central(probe(spark, sf))


_SMAD = f"(SELECT channel, median(v) AS median, mad(v) AS mad FROM {SIGNAL} GROUP BY channel)"


@query(f"SELECT channel, round(median, 4) AS median, round(mad, 4) AS mad FROM {_SMAD}")
def signal_mad(spark, sf):
    return robust.mad(signal(spark, sf), ["channel"], "v").select("channel", F.round("median", 4).alias("median"), F.round("mad", 4).alias("mad"))


@query(f"SELECT channel, t, k, round(0.25 * coalesce(lag(v) OVER w, 0) + 0.5 * v + 0.25 * coalesce(lead(v) OVER w, 0), 4) AS v FROM {SIGNAL} WINDOW w AS (PARTITION BY channel ORDER BY t, k, v)")
def fir_filter(spark, sf):
    """A three-tap filter, zeros beyond the ends."""
    s = joins.neighbours(signal(spark, sf), ["channel"], ["t", "k", "v"], ["v"], CHUNK)
    side = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return s.select("channel", "t", "k", F.round(0.25 * side("before.v") + 0.5 * F.col("v") + 0.25 * side("after.v"), 4).alias("v"))


@query(f"SELECT channel, t, k, round((v - median) / mad, 5) AS z FROM {SIGNAL} JOIN {_SMAD} USING (channel) WHERE mad > 0")
def whiten_apply(spark, sf):
    """Diagonal whitening: each channel over its own spread."""
    s = signal(spark, sf)
    m = robust.mad(s, ["channel"], "v").where("mad > 0")
    return s.join(m, "channel").select("channel", "t", "k", F.round((F.col("v") - F.col("median")) / F.col("mad"), 5).alias("z"))


FLOOR, THRESHOLD = 0.05, 0.4
_LIMITS = f"(SELECT electrode, {THRESHOLD} * any_value(sd) AS threshold, {FLOOR} * any_value(sd) AS least FROM (SELECT k // {STEPS} AS electrode, stddev_pop(v::DOUBLE) AS sd FROM {_LONG} GROUP BY 1) GROUP BY electrode)"


@query(f"WITH p AS (SELECT label, arg_min(k // {STEPS}, v) AS electrode, -min(v)::DOUBLE AS peak FROM {_TEMPLATE} GROUP BY label), low AS (SELECT electrode, min(peak) AS peak FROM p GROUP BY electrode) SELECT electrode, round(CASE WHEN peak < threshold THEN greatest(least, peak) ELSE threshold END, 6) AS threshold FROM {_LIMITS} LEFT JOIN low USING (electrode)")
def accurate_thresholds(spark, sf):
    """Each electrode's threshold goes down to the smallest of its templates' troughs where that is less, but not under a floor.
    A template belongs to the electrode of its deepest point."""
    values = templates.long_view(waveforms(spark, sf), [], "embedding").select(F.floor(F.col("k") / STEPS).alias("electrode"), F.col("v").cast("double").alias("v"))
    limits = values.groupBy("electrode").agg(F.stddev_pop("v").alias("sd")).select("electrode", (THRESHOLD * F.col("sd")).alias("threshold"), (FLOOR * F.col("sd")).alias("least"))
    deep = _template(spark, sf).groupBy("label").agg(F.min_by(F.floor(F.col("k") / STEPS), "v").alias("electrode"), (-F.min("v").cast("double")).alias("peak"))
    low = deep.groupBy("electrode").agg(F.min("peak").alias("peak"))
    lowered = F.when(F.col("peak") < F.col("threshold"), F.greatest("least", "peak")).otherwise(F.col("threshold"))
    return limits.join(low, "electrode", "left").select("electrode", r6(lowered).alias("threshold"))
