"""Curation queries: predicates and lookups on spikes, templates and pairs, suggestions, exports and bounds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import joins, robust, templates, trains
from . import trains as train_plans
from . import waveforms as wave_plans
from .tables import DAY, EV, HOUR, MINUTE, events, table, waveforms
from .waveforms import _LONG, _SIM, _SUP, _TEMPLATE, _VEC, ELECTRODES, STEPS

r6 = lambda c: F.round(c, 6)
count = lambda: F.count(F.lit(1))

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


BORDER = 30 * MINUTE


@query(f"SELECT event_id, t FROM {EV} WHERE t % {DAY} >= {BORDER} AND t % {DAY} < {DAY - BORDER}")
def border_filter(spark, sf):
    """Events that lie ``BORDER`` or more inside their chunk, a day."""
    at = F.pmod("t", F.lit(DAY))
    return events(spark, sf).where((at >= BORDER) & (at < DAY - BORDER)).select("event_id", "t")


@query(f"WITH s AS (SELECT min(t) AS lo FROM {EV}) SELECT channel, event_id, t - lo - {3 * DAY} AS at FROM {EV}, s WHERE t >= lo + {3 * DAY} AND t < lo + {10 * DAY}")
def custom_spike_slice(spark, sf):
    """Given events from ``t_start`` to before ``t_stop``, by channel."""
    e = events(spark, sf)
    at = F.col("t") - F.col("lo") - 3 * DAY
    return e.crossJoin(F.broadcast(e.agg(F.min("t").alias("lo")))).where((at >= 0) & (at < 7 * DAY)).select("channel", "event_id", at.alias("at"))


@query(f"SELECT event_id, channel, t FROM {EV} JOIN (SELECT channel, mad(amp) AS mad FROM {EV} GROUP BY channel) USING (channel) WHERE abs(amp) <= 10 * mad")
def clamp_peaks(spark, sf):
    """Drops peaks beyond ten thresholds."""
    e = events(spark, sf)
    return e.join(robust.mad(e, ["channel"], "amp"), "channel").where(F.abs("amp") <= 10 * F.col("mad")).select("event_id", "channel", "t")


@query(f"WITH s AS (SELECT min(t) AS lo, max(t) AS hi FROM {EV}) SELECT event_id, t FROM {EV}, s WHERE t > lo + {DAY} AND t < hi - {DAY}")
def time_window(spark, sf):
    """Events strictly between two times."""
    e = events(spark, sf)
    s = F.broadcast(e.agg(F.min("t").alias("lo"), F.max("t").alias("hi")))
    return e.crossJoin(s).where((F.col("t") > F.col("lo") + DAY) & (F.col("t") < F.col("hi") - DAY)).select("event_id", "t")


_WINDOWS = f"(SELECT r_regionkey AS label, (r_regionkey + 1) * {HOUR} AS tau FROM region)"


@query(f"SELECT event_id, label, tau IS NOT NULL AS known, coalesce(t + tau < (SELECT max(t) FROM {EV}), false) AS inside FROM (SELECT event_id, unit % 6 AS label, t FROM {EV} WHERE channel = 'purchase') LEFT JOIN {_WINDOWS} USING (label)")
def trigger_validity(spark, sf):
    """Whether a trigger's label has a window, and whether that ends before the recording does."""
    e = events(spark, sf)
    windows = table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("label"), ((F.col("r_regionkey") + 1).cast("long") * HOUR).alias("tau"))
    last = F.broadcast(e.agg(F.max("t").alias("stop")))
    triggers = e.where("channel = 'purchase'").select("event_id", (F.col("unit") % 6).alias("label"), "t")
    return triggers.join(windows, "label", "left").crossJoin(last).select("event_id", "label", F.col("tau").isNotNull().alias("known"), F.coalesce(F.col("t") + F.col("tau") < F.col("stop"), F.lit(False)).alias("inside"))


_POINTS = f"(SELECT unit, avg(amp) AS x, count(*) AS y FROM {EV} GROUP BY unit)"


def _points(spark, sf):
    return events(spark, sf).groupBy("unit").agg(F.avg("amp").alias("x"), count().alias("y"))


@query(f"SELECT unit FROM {_POINTS} WHERE x BETWEEN 40 AND 60 AND y BETWEEN 50 AND 80")
def rectangle_selection(spark, sf):
    return _points(spark, sf).where("x between 40 and 60 and y between 50 and 80").select("unit")


#: A concave polygon in the plane of mean amplitude and number of events.
LASSO = [(35.0, 45.0), (65.0, 50.0), (55.0, 66.0), (70.0, 90.0), (40.0, 85.0)]
_EDGES = [(*a, *b) for a, b in zip(LASSO, LASSO[1:] + LASSO[:1], strict=True)]
_CROSSED = " + ".join(f"((y < {b}) <> (y < {d}) AND x < {a} + (y - {b}) * {c - a} / {d - b})::INT" for a, b, c, d in _EDGES)


@query(f"SELECT unit FROM {_POINTS} WHERE ({_CROSSED}) % 2 = 1")
def lasso_selection(spark, sf):
    """Points in a polygon: a ray to the right crosses its edges an odd number of times."""
    x, y = F.col("x"), F.col("y")
    crossed = sum((((y < b) != (y < d)) & (x < a + (y - b) * (c - a) / (d - b))).cast("int") for a, b, c, d in _EDGES)
    return _points(spark, sf).where(crossed % 2 == 1).select("unit")


@query(f"SELECT unit, x AS mean FROM (SELECT unit, round(x, 6) AS x, row_number() OVER (ORDER BY ((x - 50) / 10) ** 2 + ((y - 60) / 20) ** 2, unit) AS r FROM {_POINTS}) WHERE r = 1")
def nearest_click(spark, sf):
    """The point nearest to a click, in scaled coordinates."""
    d = ((F.col("x") - 50) / 10) ** 2 + ((F.col("y") - 60) / 20) ** 2
    return _points(spark, sf).orderBy(d, "unit").limit(1).select("unit", r6("x").alias("mean"))


@query("SELECT c_custkey AS template, count(*) AS spikes FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def drop_silent_templates(spark, sf):
    """Templates with a spike at least."""
    spikes = table(spark, sf, "orders").groupBy("o_custkey").agg(count().alias("spikes"))
    return table(spark, sf, "customer").join(spikes, F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_custkey").alias("template"), "spikes")


@query("SELECT c_custkey AS template FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def unmentioned_templates(spark, sf):
    spikes = table(spark, sf, "orders").select("o_custkey")
    return table(spark, sf, "customer").join(spikes, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.col("c_custkey").alias("template"))


@query("SELECT o_custkey AS template, arg_max(o_orderpriority, o_orderkey) AS cluster FROM orders GROUP BY 1")
def cluster_map(spark, sf):
    """The cluster a template was last given."""
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("template")).agg(F.max_by("o_orderpriority", "o_orderkey").alias("cluster"))


_HOME = f"(SELECT label, arg_min(k // {STEPS}, v) AS electrode FROM {_TEMPLATE} GROUP BY label)"


def _home(spark, sf):
    return wave_plans._template(spark, sf).groupBy("label").agg(F.min_by(F.floor(F.col("k") / STEPS), "v").alias("electrode"))


@query(f"SELECT label, electrode, dense_rank() OVER (PARTITION BY electrode ORDER BY label) - 1 AS ordinal FROM {_HOME}")
def electrode_labels(spark, sf):
    """Which of its electrode's clusters a template is."""
    line = Window.partitionBy("electrode").orderBy("label")
    return _home(spark, sf).withColumn("ordinal", (F.dense_rank().over(line) - 1).cast("long"))


_NORM = f"(SELECT label, sqrt(sum(v::DOUBLE * v) / {ELECTRODES * STEPS}) AS norm FROM {_TEMPLATE} GROUP BY label)"
_SPARSE = f"(SELECT label, 1 - (count(*) - 1) / {ELECTRODES - 1}.0 AS sparsity FROM {_SUP} GROUP BY label)"


@query(f"SELECT label, round(norm, 6) AS norm, round(sparsity, 6) AS sparsity FROM {_NORM} JOIN {_SPARSE} USING (label) WHERE norm <= 0.08 AND sparsity >= 0")
def noise_template_suggestion(spark, sf):
    """Weak templates on few electrodes."""
    both = wave_plans.template_norm(spark, sf).join(wave_plans.sparsity(spark, sf), "label")
    return both.where("norm <= 0.08 and sparsity >= 0")


_RESIDUAL = f"(SELECT label, var_pop(d) AS variance, max(abs(m)) / nullif(mad(d), 0) AS ratio FROM (SELECT l.label, l.v::DOUBLE - t.v AS d, t.v::DOUBLE AS m FROM {_LONG} l JOIN {_TEMPLATE} t USING (label, k)) GROUP BY label)"


@query(f"SELECT label, coalesce(n, 0) AS electrodes, round(ratio, 4) AS ratio, coalesce(n, 0) = 0 OR ratio < 0.5 OR variance > 0.0155 AS noise FROM {_RESIDUAL} LEFT JOIN (SELECT label, count(*) AS n FROM {_SUP} GROUP BY label) USING (label)")
def template_noise(spark, sf):
    """A template is noise if all its electrodes are silent, its peak hardly exceeds the deviation of what it leaves, or that varies too much."""
    t = wave_plans._template(spark, sf).withColumnRenamed("v", "m")
    rest = templates.long_view(waveforms(spark, sf), ["label"], "embedding").join(t, ["label", "k"]).select("label", (F.col("v").cast("double") - F.col("m")).alias("d"), F.col("m").cast("double").alias("m"))
    spread = robust.mad(rest, ["label"], "d").select("label", "mad")
    stats = rest.groupBy("label").agg(F.var_pop("d").alias("variance"), F.max(F.abs("m")).alias("peak")).join(spread, "label").withColumn("ratio", F.col("peak") / F.nullif(F.col("mad"), F.lit(0.0)))
    n = wave_plans._support(spark, sf).groupBy("label").agg(count().alias("n"))
    found = stats.join(n, "label", "left").withColumn("electrodes", F.coalesce("n", F.lit(0).cast("long")))
    return found.select("label", "electrodes", F.round("ratio", 4).alias("ratio"), ((F.col("electrodes") == 0) | (F.col("ratio") < 0.5) | (F.col("variance") > 0.0155)).alias("noise"))


@query(f"SELECT vec_id, pos // {STEPS} = electrode AND abs(pos % {STEPS} - {STEPS // 2}) < 2 AS centred FROM (SELECT vec_id, label, list_position(embedding, list_min(embedding)) - 1 AS pos FROM embeddings) JOIN {_HOME} USING (label)")
def centred_waveforms(spark, sf):
    """Whether a waveform's extremum is on its template's electrode and near the middle."""
    at = (F.array_position("embedding", F.array_min("embedding")) - 1).alias("at")
    w = waveforms(spark, sf).select("vec_id", "label", at).join(_home(spark, sf), "label")
    return w.select("vec_id", ((F.floor(F.col("at") / STEPS) == F.col("electrode")) & (F.abs(F.col("at") % STEPS - STEPS // 2) < 2)).alias("centred"))


@query(f"SELECT e.t // {MINUTE} + k % {STEPS} AS step, k // {STEPS} AS electrode, round(sum(amp * v), 4) AS v FROM {EV} e JOIN {_TEMPLATE} t ON e.unit % 10 = t.label GROUP BY 1, 2")
def reconstruct(spark, sf):
    """The signal that the spikes' templates add up to. Spikes of one step and template are added before their templates are laid out."""
    spikes = events(spark, sf).groupBy((F.col("unit") % 10).alias("label"), F.floor(F.col("t") / MINUTE).alias("at")).agg(F.sum("amp").alias("amp"))
    laid = spikes.join(wave_plans._vectors(spark, sf), "label").select("at", "amp", F.posexplode("vector").alias("k", "v"))
    summed = laid.groupBy((F.col("at") + F.col("k") % STEPS).alias("step"), F.floor(F.col("k") / STEPS).alias("electrode")).agg(F.sum(F.col("amp") * F.col("v").cast("double")).alias("v"))
    return summed.select("step", "electrode", F.round("v", 4).alias("v"))


_COMMON = f"(SELECT i, j, s, coalesce(common, 0) AS common FROM {_SIM} LEFT JOIN (SELECT a.label AS i, b.label AS j, count(*) AS common FROM {_SUP} a JOIN {_SUP} b ON a.electrode = b.electrode AND a.label < b.label GROUP BY 1, 2) USING (i, j))"


@query(f"SELECT common, count(*) AS pairs, round(avg(s), 5) AS mean, round(stddev_pop(s), 5) AS sd, round(0.95 ** (1 / exp(-common / 4.0)), 6) AS threshold FROM {_COMMON} GROUP BY common")
def similarity_by_support(spark, sf):
    """Similarities by the number of electrodes that two templates share, and a threshold that falls with it."""
    s = templates.similarity(wave_plans._vectors(spark, sf), "label")
    both = s.join(wave_plans.support_intersection(spark, sf), ["i", "j"], "left").withColumn("common", F.coalesce("common", F.lit(0).cast("long")))
    found = both.groupBy("common").agg(count().alias("pairs"), F.round(F.avg("similarity"), 5).alias("mean"), F.round(F.stddev_pop("similarity"), 5).alias("sd"))
    return found.withColumn("threshold", r6(F.pow(F.lit(0.95), 1 / F.exp(-F.col("common") / 4.0))))


@query(f"SELECT label, lag, k, round(CASE WHEN k % {STEPS} - lag BETWEEN 0 AND {STEPS - 1} THEN w[k - lag + 1]::DOUBLE ELSE 0 END, 6) AS v FROM {_VEC}, (SELECT unnest([-2, 0, 3]) AS lag), (SELECT unnest(range({ELECTRODES * STEPS})) AS k)")
def shift_template(spark, sf):
    """Templates moved in time on every electrode, with zeros where nothing is known."""
    moved = wave_plans._vectors(spark, sf).withColumn("lag", F.explode(F.array(F.lit(-2), F.lit(0), F.lit(3))))
    n = ELECTRODES * STEPS
    at = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.when((k % STEPS - F.col("lag")).between(0, STEPS - 1), F.get("vector", k - F.col("lag")).cast("double")).otherwise(0.0))
    return moved.select("label", F.col("lag"), F.posexplode(at).alias("k", "v")).select("label", F.col("lag").cast("int").alias("lag"), F.col("k").cast("long").alias("k"), r6("v").alias("v"))


@query(f"SELECT label, k, round(v::DOUBLE * (0.5 - 0.5 * cos(2 * pi() * (k % {STEPS}) / {STEPS - 1})), 6) AS v FROM {_TEMPLATE}")
def hanning_template(spark, sf):
    """Templates under a raised cosine on each electrode."""
    window = 0.5 - 0.5 * F.cos(2 * F.pi() * (F.col("k") % STEPS) / (STEPS - 1))
    return wave_plans._template(spark, sf).select("label", F.col("k").cast("long").alias("k"), r6(F.col("v").cast("double") * window).alias("v"))


_PAIRS = [(a, b) for a in range(1, 4) for b in range(a, 4)]


@query(f"SELECT vec_id, {', '.join(f'round(embedding[{a}]::DOUBLE, 6) AS x{a}' for a in range(1, 4))}, {', '.join(f'round(embedding[{a}]::DOUBLE * embedding[{b}], 6) AS x{a}{b}' for a, b in _PAIRS)} FROM embeddings")
def quadratic_features(spark, sf):
    x = {a: F.get("embedding", F.lit(a - 1)).cast("double") for a in range(1, 4)}
    return waveforms(spark, sf).select("vec_id", *(r6(x[a]).alias(f"x{a}") for a in x), *(r6(x[a] * x[b]).alias(f"x{a}{b}") for a, b in _PAIRS))


@query(f"WITH n AS (SELECT count(*) AS n FROM {_HOME}), o AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS k FROM {_HOME}) SELECT a.label AS i, b.label AS j, n * a.k - a.k * (a.k + 1) // 2 + b.k - a.k - 1 AS at FROM o a JOIN o b ON a.k < b.k, n")
def condensed_index(spark, sf):
    """Where a pair of templates stands in the list of all pairs."""
    t = _home(spark, sf).select("label").withColumn("k", (F.row_number().over(Window.orderBy("label")) - 1).cast("long"))  # one row for each template
    n = F.broadcast(t.agg(count().alias("n")))
    pairs = t.toDF("i", "a").join(t.toDF("j", "b"), F.col("a") < F.col("b")).crossJoin(n)
    return pairs.select("i", "j", F.expr("n * a - a * (a + 1) div 2 + b - a - 1").alias("at"))


@query(f"SELECT i, j, round(s, 5) AS similarity, row_number() OVER (ORDER BY round(s, 5) DESC, i, j) AS place FROM {_SIM}")
def pair_display_order(spark, sf):
    s = templates.similarity(wave_plans._vectors(spark, sf), "label").select("i", "j", F.round("similarity", 5).alias("similarity"))
    return s.withColumn("place", F.row_number().over(Window.orderBy(F.desc("similarity"), "i", "j")).cast("long"))  # one row for each pair of templates


@query(f"SELECT i, j FROM {_COMMON} WHERE s >= 0.05 AND common >= 1")
def pair_candidates(spark, sf):
    """Pairs of templates that share an electrode and are similar enough to be looked at."""
    s = templates.similarity(wave_plans._vectors(spark, sf), "label").where("similarity >= 0.05")
    return s.join(wave_plans.support_intersection(spark, sf), ["i", "j"]).select("i", "j")


_DIP = f"(SELECT i, j, greatest(1 - (sum(n) FILTER (abs(lag) <= 1) / 3.0) / nullif(sum(n) / {2 * train_plans.LAGS + 1}.0, 0), 0) AS dip, sum(n) AS n FROM ({train_plans._CC}) GROUP BY i, j)"
_RATIO = f"({train_plans._RPV})"


def _kept(table, spark, sf):
    """The rows of ``table`` whose units keep their refractory time."""
    rpv = trains.violation_ratio(events(spark, sf), train_plans.REFRACTORY).where("rpv < 0.1").select("unit")
    return table.join(rpv, "unit", "left_semi")


@query(f"SELECT i, j, round(dip, 6) AS score FROM {_DIP} JOIN {_RATIO} a ON a.unit = i JOIN {_RATIO} b ON b.unit = j WHERE dip > 0.3 AND a.rpv < 0.1 AND b.rpv < 0.1")
def pair_suggestion(spark, sf):
    """Units to be merged: their correlogram dips in the middle and each keeps its refractory time."""
    pairs = train_plans.dips(_kept(events(spark, sf), spark, sf)).where("dip > 0.3")
    return pairs.select("i", "j", r6("dip").alias("score"))


_BHATTA = f"(SELECT a.unit AS i, b.unit AS j, sum(sqrt(a.p * b.p)) AS bhatta FROM {train_plans._P} a JOIN {train_plans._P} b ON a.d = b.d AND a.unit < b.unit GROUP BY 1, 2)"


@query(f"SELECT i, j, round(bhatta, 6) AS bhatta FROM {_BHATTA} JOIN {_RATIO} a ON a.unit = i JOIN {_RATIO} b ON b.unit = j WHERE round(bhatta, 6) > 0.9 AND a.rpv < 0.1 AND b.rpv < 0.1")
def drift_suggestion(spark, sf):
    """Units whose days of activity are alike and that each keep their refractory time."""
    pairs = train_plans.bhattas(_kept(train_plans._daily(spark, sf), spark, sf))
    return pairs.select("i", "j", r6("bhatta").alias("bhatta")).where("bhatta > 0.9")


ALPHA = 1e-2


@query(f"SELECT k, round(coalesce(1 - (tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 1) + {ALPHA} * (1 - k / {train_plans.CUTS}.0) ** 2, 6) AS score FROM {train_plans._CM}")
def regularised_score(spark, sf):
    """The cost of each cut-off with a penalty on how much it leaves out."""
    width = F.col("k") / float(train_plans.CUTS)
    return train_plans.costs(spark, sf).select("k", r6(F.col("cost") + ALPHA * (1 - width) ** 2).alias("score"))


@query(f"SELECT unit, round(least(1, 1 - fp / n), 6) AS purity FROM ({train_plans._TP})")
def purity(spark, sf):
    return train_plans._tp(spark, sf).select("unit", r6(F.least(F.lit(1.0), 1 - F.col("fp") / F.col("n"))).alias("purity"))


@query(f"SELECT channel, count(*) FILTER (amp > top) AS saturated, round(count(*) FILTER (amp > top) / count(*), 6) AS share FROM {EV} JOIN (SELECT channel, 0.95 * max(amp) AS top FROM {EV} GROUP BY channel) USING (channel) GROUP BY channel")
def saturation_summary(spark, sf):
    s = train_plans.saturation_log(spark, sf).groupBy("channel").agg(F.count(F.when(F.col("saturated"), 1)).alias("saturated"), count().alias("n"))
    return s.select("channel", "saturated", r6(F.col("saturated") / F.col("n")).alias("share"))


_DAYS = f"(SELECT channel, t // {DAY} AS d, avg(amp) AS mean, coalesce(stddev_pop(amp), 0) AS sd FROM {EV} GROUP BY 1, 2)"


def _days(spark, sf):
    return events(spark, sf).groupBy("channel", F.floor(F.col("t") / DAY).alias("d")).agg(F.avg("amp").alias("mean"), F.coalesce(F.stddev_pop("amp"), F.lit(0.0)).alias("sd"))


_AT = f"((t % {DAY}) / {float(DAY)})"
_LOW, _HIGH = (f"(a.mean {s} 2 * a.sd) * (1 - {_AT}) + coalesce(b.mean {s} 2 * b.sd, a.mean {s} 2 * a.sd) * {_AT}" for s in "-+")


@query(f"SELECT event_id, round({_LOW}, 6) AS low, round({_HIGH}, 6) AS high, amp > {_LOW} AND amp < {_HIGH} AS inside FROM {EV} e JOIN {_DAYS} a ON a.channel = e.channel AND a.d = e.t // {DAY} LEFT JOIN {_DAYS} b ON b.channel = e.channel AND b.d = e.t // {DAY} + 1")
def drifting_bounds(spark, sf):
    """Amplitude bounds that go in a line from one day's to the next's, at the time of each event; an event passes strictly between them."""
    e = events(spark, sf).withColumn("d", F.floor(F.col("t") / DAY))
    days = _days(spark, sf)
    after = days.select("channel", (F.col("d") - 1).alias("d"), F.col("mean").alias("next_mean"), F.col("sd").alias("next_sd"))
    share = F.pmod("t", F.lit(DAY)) / float(DAY)
    both = e.join(days, ["channel", "d"]).join(after, ["channel", "d"], "left")
    bound = lambda s: (F.col("mean") + 2 * s * F.col("sd")) * (1 - share) + F.coalesce(F.col("next_mean") + 2 * s * F.col("next_sd"), F.col("mean") + 2 * s * F.col("sd")) * share
    found = both.withColumn("low", bound(-1)).withColumn("high", bound(1))
    return found.select("event_id", r6("low").alias("low"), r6("high").alias("high"), ((F.col("amp") > F.col("low")) & (F.col("amp") < F.col("high"))).alias("inside"))


@query(f"SELECT event_id, round(a.mean * (1 - {_AT}) + coalesce(b.mean, a.mean) * {_AT}, 6) AS trend FROM {EV} e JOIN {_DAYS} a ON a.channel = e.channel AND a.d = e.t // {DAY} LEFT JOIN {_DAYS} b ON b.channel = e.channel AND b.d = e.t // {DAY} + 1")
def trend_interpolation(spark, sf):
    """A trend given by points, here daily means, at the time of each event."""
    e = events(spark, sf).withColumn("d", F.floor(F.col("t") / DAY))
    days = _days(spark, sf).select("channel", "d", "mean")
    after = days.select("channel", (F.col("d") - 1).alias("d"), F.col("mean").alias("next"))
    share = F.pmod("t", F.lit(DAY)) / float(DAY)
    return e.join(days, ["channel", "d"]).join(after, ["channel", "d"], "left").select("event_id", r6(F.col("mean") * (1 - share) + F.coalesce("next", "mean") * share).alias("trend"))


@query(f"SELECT t, unit, event_id FROM {EV} ORDER BY t, unit, event_id")
def spike_export(spark, sf):
    """All spikes in the order of their time, as they are exported."""
    return events(spark, sf).select("t", "unit", "event_id").orderBy("t", "unit", "event_id")


@query(f"SELECT unit, event_id, row_number() OVER (PARTITION BY unit ORDER BY t, event_id) - 1 AS k FROM {EV}")
def sorted_trains(spark, sf):
    return events(spark, sf).select("unit", "event_id", (F.row_number().over(trains.line()) - 1).cast("long").alias("k"))


@query(f"WITH c AS (SELECT event_id, channel FROM ({train_plans._CROSS}) c WHERE NOT EXISTS (SELECT 1 FROM {train_plans._VIEW} v WHERE v.unit = c.unit AND abs(v.t - c.t) < {train_plans.TOLERANCE})), n AS (SELECT channel, row_number() OVER (ORDER BY channel) - 1 AS electrode FROM (SELECT DISTINCT channel FROM {EV})), k AS (SELECT max(unit) + 1 AS k FROM {EV}) SELECT event_id, unit AS template FROM {EV} WHERE channel = 'view' UNION ALL SELECT event_id, electrode + k FROM c JOIN n USING (channel), k")
def garbage_templates(spark, sf):
    """Fitted spikes, and crossings that no template explains under a template of their electrode's own, after all others."""
    e = events(spark, sf)
    names = e.select("channel").distinct().withColumn("electrode", F.row_number().over(Window.orderBy("channel")) - 1)  # one row for each channel
    k = F.broadcast(e.agg((F.max("unit") + 1).alias("k")))
    rest = train_plans.unexplained_crossings(spark, sf).join(e.select("event_id", "channel"), "event_id").join(names, "channel").crossJoin(k)
    return e.where("channel = 'view'").select("event_id", F.col("unit").alias("template")).unionByName(rest.select("event_id", (F.col("electrode") + F.col("k")).alias("template")))


@query(f"SELECT DISTINCT unit FROM {train_plans._CLICK} EXCEPT SELECT DISTINCT unit FROM {train_plans._VIEW}")
def units_left(spark, sf):
    """Units of one side that the other has not."""
    a, b = train_plans._sides(spark, sf)
    return a.select("unit").distinct().join(b.select("unit"), "unit", "left_anti")


@query(f"SELECT t // {MINUTE} AS bin FROM {train_plans._CLICK} INTERSECT SELECT t // {MINUTE} FROM {train_plans._VIEW}")
def binned_intersection(spark, sf):
    a, b = train_plans._sides(spark, sf)
    bin = F.floor(F.col("t") / MINUTE).alias("bin")
    return a.select(bin).intersect(b.select(bin))


@query(f"WITH s AS (SELECT min(t) AS lo FROM {EV}) SELECT event_id, (t - lo) // {DAY} AS chunk FROM {EV}, s WHERE (t - lo) // {DAY} < 10")
def first_chunks(spark, sf):
    """Events of the first ten chunks of a recording."""
    e = events(spark, sf)
    lo = F.broadcast(e.agg(F.min("t").alias("lo")))
    return e.crossJoin(lo).select("event_id", F.floor((F.col("t") - F.col("lo")) / DAY).alias("chunk")).where("chunk < 10")


BINS = 20
_HASHED = "((event_id * 2654435761) % 4294967296) / 4294967296.0"
_BOX = f"least(floor((amp - lo) / w), {BINS - 1})::BIGINT"
_SPREAD = f"(SELECT channel, min(amp) AS lo, (max(amp) - min(amp)) / {BINS} AS w FROM {EV} GROUP BY channel HAVING max(amp) > min(amp))"
_DENSE = f"(SELECT channel, bin, n, 0.5 * n / max(n) OVER (PARTITION BY channel) AS reject FROM (SELECT channel, {_BOX} AS bin, count(*) AS n FROM {EV} JOIN {_SPREAD} USING (channel) GROUP BY 1, 2))"


@query(f"SELECT event_id, reject < {_HASHED} AS accepted FROM {EV} e JOIN {_SPREAD} s ON s.channel = e.channel JOIN {_DENSE} d ON d.channel = e.channel AND d.bin = {_BOX}")
def smart_search(spark, sf):
    """A sample that thins common amplitudes: an event is accepted if a hash of its id exceeds what its amplitude bin rejects."""
    e = events(spark, sf)
    spread = e.groupBy("channel").agg(F.min("amp").alias("lo"), ((F.max("amp") - F.min("amp")) / BINS).alias("w")).where("w > 0")
    boxed = e.join(spread, "channel").withColumn("bin", F.least(F.floor((F.col("amp") - F.col("lo")) / F.col("w")), F.lit(BINS - 1)))
    n = boxed.groupBy("channel", "bin").agg(count().alias("n"))
    reject = n.withColumn("reject", 0.5 * F.col("n") / F.max("n").over(Window.partitionBy("channel"))).drop("n")
    u = ((F.col("event_id") * 2654435761) % 4294967296) / 4294967296.0
    return boxed.join(reject, ["channel", "bin"]).select("event_id", (F.col("reject") < u).alias("accepted"))


@query(f"SELECT unit // 3 AS merged, round(min(lo), 6) AS low, round(max(hi), 6) AS high, round(avg(rpv), 6) AS rpv, sum(u.n)::BIGINT AS n FROM (SELECT unit, min(amp) AS lo, max(amp) AS hi, count(*) AS n FROM {EV} GROUP BY unit) u JOIN {_RATIO} r USING (unit) GROUP BY 1")
def merged_limits(spark, sf):
    """Units merged in threes: the widest bounds, the mean of their ratios and all their spikes."""
    e = events(spark, sf)
    u = e.groupBy("unit").agg(F.min("amp").alias("lo"), F.max("amp").alias("hi"), count().alias("m"))
    r = trains.violation_ratio(e, train_plans.REFRACTORY)
    both = u.join(r, "unit").groupBy(F.floor(F.col("unit") / 3).alias("merged"))
    return both.agg(r6(F.min("lo")).alias("low"), r6(F.max("hi")).alias("high"), r6(F.avg("rpv")).alias("rpv"), F.sum("m").alias("n"))


@query(f"SELECT k AS stream, greatest(start, k * {7 * DAY}) - k * {7 * DAY} AS start, least(stop, (k + 1) * {7 * DAY}) - k * {7 * DAY} AS stop FROM (SELECT t AS start, t + {6 * HOUR} AS stop FROM {EV} WHERE channel = 'error'), LATERAL (SELECT unnest(range(start // {7 * DAY}, (stop - 1) // {7 * DAY} + 1)) AS k)")
def clipped_zones(spark, sf):
    """Zones of each stream, a week: cut where streams meet and counted from the stream's start."""
    zones = events(spark, sf).where("channel = 'error'").select(F.col("t").alias("start"), (F.col("t") + 6 * HOUR).alias("stop"))
    week = F.lit(7 * DAY).cast("long")
    parts = zones.withColumn("stream", F.explode(F.sequence(F.floor(F.col("start") / week), F.floor((F.col("stop") - 1) / week))))
    base = F.col("stream") * week
    return parts.select("stream", (F.greatest(F.col("start"), base) - base).alias("start"), (F.least(F.col("stop"), base + week) - base).alias("stop"))


@query(f"WITH b AS (SELECT e.label AS i, t.label AS j, list_inner_product(e.embedding::DOUBLE[], t.w::DOUBLE[]) / list_inner_product(t.w::DOUBLE[], t.w::DOUBLE[]) AS b FROM embeddings e, {_VEC} t) SELECT i, j, round(avg(b), 4) AS mean FROM b GROUP BY i, j")
def confusion_average(spark, sf):
    """The mean amplitude with which template j explains the waveforms of i."""
    return templates.mean_fits(waveforms(spark, sf), wave_plans._vectors(spark, sf), "label", "embedding").select("i", "j", F.round("mean", 4).alias("mean"))


_AXIS = f"(SELECT a.label AS i, b.label AS j, list_transform(list_zip(b.w, a.w), lambda z: z[1]::DOUBLE - z[2]) AS u FROM {_VEC} a JOIN {_VEC} b ON a.label < b.label)"
_PROJECTED = f"(SELECT i, j, label, median(x) AS median, mad(x) AS mad FROM (SELECT i, j, label, list_inner_product(embedding::DOUBLE[], u) AS x FROM {_AXIS} JOIN embeddings ON label IN (i, j)) GROUP BY ALL)"


@query(f"SELECT i, j, round(sqrt((a.median - b.median) ** 2 / (a.mad ** 2 + b.mad ** 2)), 4) AS distance FROM (SELECT * FROM {_PROJECTED} WHERE label = i) a JOIN (SELECT * FROM {_PROJECTED} WHERE label = j) b USING (i, j) WHERE a.mad ** 2 + b.mad ** 2 > 0")
def merge_distance(spark, sf):
    """How far apart two clusters lie on the line between their medians, in deviations of both."""
    axes = templates.pairs(wave_plans._vectors(spark, sf), "label").select("i", "j", F.zip_with("b", "a", lambda y, x: y.cast("double") - x).alias("u"))
    sided = axes.select("i", "j", "u", F.explode(F.array("i", "j")).alias("label"))
    x = waveforms(spark, sf).join(sided, "label").select("i", "j", "label", templates.dot(F.col("embedding"), F.col("u")).alias("x"))
    m = robust.mad(x, ["i", "j", "label"], "x")
    side = lambda c: m.where(F.col("label") == F.col(c)).select("i", "j", F.col("median").alias(f"m_{c}"), F.col("mad").alias(f"d_{c}"))
    spread = F.col("d_i") ** 2 + F.col("d_j") ** 2
    return side("i").join(side("j"), ["i", "j"]).where(spread > 0).select("i", "j", F.round(F.sqrt((F.col("m_i") - F.col("m_j")) ** 2 / spread), 4).alias("distance"))


_MOMENTS = "(SELECT label, avg(embedding[1]::DOUBLE) AS mx, avg(embedding[2]::DOUBLE) AS my, var_pop(embedding[1]::DOUBLE) AS vx, var_pop(embedding[2]::DOUBLE) AS vy, covar_pop(embedding[1]::DOUBLE, embedding[2]::DOUBLE) AS c FROM embeddings GROUP BY label)"
_BETWEEN = f"(SELECT a.label AS i, b.label AS j, b.mx - a.mx AS dx, b.my - a.my AS dy, (a.vx + b.vx) / 2 AS vx, (a.vy + b.vy) / 2 AS vy, (a.c + b.c) / 2 AS c, (a.vx * a.vy - a.c * a.c) * (b.vx * b.vy - b.c * b.c) AS dets FROM {_MOMENTS} a JOIN {_MOMENTS} b ON a.label < b.label)"
_GAUSS = "(vy * dx * dx - 2 * c * dx * dy + vx * dy * dy) / (vx * vy - c * c) / 8 + ln((vx * vy - c * c) / sqrt(dets)) / 2"


@query(f"SELECT i, j, round({_GAUSS}, 5) AS distance FROM {_BETWEEN} WHERE dets > 0")
def gaussian_bhattacharyya(spark, sf):
    """Bhattacharyya distances of clusters taken as two-dimensional Gaussians, from their moments."""
    w = waveforms(spark, sf).select("label", F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))
    m = w.groupBy("label").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop("x", "y").alias("c"))
    side = lambda k: m.toDF(k, *(f"{n}_{k}" for n in ("mx", "my", "vx", "vy", "c")))
    both = side("i").join(side("j"), F.col("i") < F.col("j"))  # one row for each pair of clusters
    half = lambda n: f"({n}_i + {n}_j) / 2 AS {n}"
    mixed = both.selectExpr("i", "j", "mx_j - mx_i AS dx", "my_j - my_i AS dy", half("vx"), half("vy"), half("c"), "(vx_i * vy_i - c_i * c_i) * (vx_j * vy_j - c_j * c_j) AS dets")
    return mixed.where("dets > 0").select("i", "j", F.round(F.expr(_GAUSS), 5).alias("distance"))


def safety_mask(spark, sf):
    """Events taken in the order of their amplitude, each of which bars its channel for the tolerance on both sides."""
    return joins.safety(events(spark, sf), ["channel"], "amp", train_plans.TOLERANCE, DAY).select("event_id", "channel", "t")


QUERIES["safety_mask"] = safety_mask
