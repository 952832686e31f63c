"""Event-train queries: thresholds, intervals, correlograms, matches and curation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import joins, pairs, robust, trains
from .tables import DAY, EV, HOUR, MINUTE, events

REFRACTORY = 30 * MINUTE
TOLERANCE = 20 * MINUTE
BIN = 6 * HOUR
LAGS = 8
ZONE = MINUTE  # after an error nothing counts for so long
r6 = lambda c: F.round(c, 6)

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


_MAD = f"SELECT channel, median(amp) AS median, mad(amp) AS mad FROM {EV} GROUP BY channel"


@query(f"SELECT channel, round(median, 6) AS median, round(mad, 6) AS mad, round(3 * mad, 6) AS threshold, round(mad / 0.674, 6) AS sd FROM ({_MAD})")
def mad_threshold(spark, sf):
    m = robust.mad(events(spark, sf), ["channel"], "amp")
    return m.select("channel", r6("median").alias("median"), r6("mad").alias("mad"), r6(3 * F.col("mad")).alias("threshold"), r6(F.col("mad") / 0.674).alias("sd"))


@query(f"SELECT channel, round(avg(m), 6) AS mad, count(*) AS chunks FROM (SELECT channel, t // {DAY} AS d, mad(amp) AS m FROM {EV} GROUP BY ALL) GROUP BY channel")
def mad_two_phase_daily(spark, sf):
    e = events(spark, sf).withColumn("day", F.floor(F.col("t") / DAY))
    return robust.chunked_mad(e, ["channel"], "day", "amp").select("channel", r6("mad").alias("mad"), "chunks")


@query(f"SELECT event_id, round(amp - median(amp) OVER (PARTITION BY t // {HOUR}), 6) AS referenced FROM {EV}")
def common_median_reference(spark, sf):
    e = events(spark, sf).withColumn("step", F.floor(F.col("t") / HOUR))
    return robust.remove_median(e, ["step"], "amp").select("event_id", r6("referenced").alias("referenced"))


@query(f"SELECT event_id, round(amp - median(amp) OVER (PARTITION BY channel, t // {DAY}), 6) AS centred FROM {EV}")
def chunk_median_removal(spark, sf):
    e = events(spark, sf).withColumn("day", F.floor(F.col("t") / DAY))
    return robust.remove_median(e, ["channel", "day"], "amp").select("event_id", r6("referenced").alias("centred"))


_CROSS = f"SELECT e.* FROM {EV} e JOIN ({_MAD}) m USING (channel) WHERE abs(amp - median) >= 1.5 * mad"


def _crossings(spark, sf, times=1.5, below=None):
    """Events ``times`` deviations or more from their channel's median, and under ``below`` deviations where it is given."""
    e = events(spark, sf)
    m = robust.mad(e, ["channel"], "amp")  # a row for each channel
    off = F.abs(F.col("amp") - F.col("median"))
    found = e.join(m, "channel").where(off >= times * F.col("mad"))
    return (found if below is None else found.where(off < below * F.col("mad"))).select(*e.columns)


@query(f"SELECT event_id, channel, t FROM ({_CROSS})")
def threshold_crossings(spark, sf):
    return _crossings(spark, sf).select("event_id", "channel", "t")


@query(f"SELECT event_id, channel, t FROM ({_CROSS}) WHERE event_id NOT IN (SELECT event_id FROM ({_CROSS.replace('1.5', '3.0')}))")
def weird_rejection(spark, sf):
    return _crossings(spark, sf, below=3.0).select("event_id", "channel", "t")


@query(f"WITH q AS (SELECT channel, 0.95 * max(amp) AS top FROM {EV} GROUP BY channel) SELECT event_id, channel, t, CASE WHEN amp > top THEN 0 ELSE round(amp, 6) END AS cleaned, amp > top AS saturated FROM {EV} JOIN q USING (channel)")
def saturation_log(spark, sf):
    e = events(spark, sf)
    top = F.broadcast(e.groupBy("channel").agg((0.95 * F.max("amp")).alias("top")))
    high = F.col("amp") > F.col("top")
    return e.join(top, "channel").select("event_id", "channel", "t", F.when(high, 0.0).otherwise(r6("amp")).alias("cleaned"), high.alias("saturated"))


@query(f"SELECT event_id, t FROM (SELECT *, lag(amp) OVER w AS b, lead(amp) OVER w AS a FROM {EV} WINDOW w AS (PARTITION BY channel ORDER BY t, event_id)) WHERE amp > b AND amp >= a")
def local_maxima(spark, sf):
    e = joins.neighbours(events(spark, sf), ["channel"], ["t", "event_id"], ["amp"], DAY)
    return e.where("amp > before.amp and amp >= after.amp").select("event_id", "t")


@query(f"SELECT event_id FROM (SELECT *, max(amp) OVER (PARTITION BY channel ORDER BY t RANGE BETWEEN {TOLERANCE} PRECEDING AND {TOLERANCE} FOLLOWING) AS top FROM {EV}) WHERE amp >= top")
def isolation_test(spark, sf):
    """Days are looked at alone, each with a halo of the tolerance."""
    day = lambda t: F.floor(t / DAY)
    e = events(spark, sf).withColumn("day", F.explode(F.sequence(day(F.col("t") - TOLERANCE), day(F.col("t") + TOLERANCE))))
    w = Window.partitionBy("channel", "day").orderBy("t").rangeBetween(-TOLERANCE, TOLERANCE)
    return e.withColumn("top", F.max("amp").over(w)).where((day(F.col("t")) == F.col("day")) & (F.col("amp") >= F.col("top"))).select("event_id")


_ISI = f"(SELECT *, t - lag(t) OVER (PARTITION BY unit ORDER BY t, event_id) AS isi FROM {EV})"


@query(f"SELECT event_id, unit, t FROM {_ISI} WHERE isi IS NULL OR isi > {REFRACTORY}")
def refractory_dedupe(spark, sf):
    return trains.refractory(events(spark, sf), REFRACTORY).select("event_id", "unit", "t")


@query(f"SELECT unit, count(*) AS n, round(count(*) * 1e6 / (SELECT max(t) - min(t) + 1 FROM {EV}), 9) AS rate FROM {EV} GROUP BY unit")
def firing_rate(spark, sf):
    e = events(spark, sf)
    span = e.agg((F.max("t") - F.min("t") + 1).alias("span"))
    return e.groupBy("unit").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(span)).select("unit", "n", F.round(F.col("n") * 1e6 / F.col("span"), 9).alias("rate"))


@query(f"SELECT unit, count(isi) AS n, min(isi) AS least, max(isi) AS most, round(avg(isi / 1e6), 6) AS mean, round(median(isi / 1e6), 6) AS median FROM {_ISI} GROUP BY unit")
def isi_stats(spark, sf):
    s = F.col("isi") / 1e6
    return trains.intervals(events(spark, sf)).groupBy("unit").agg(F.count("isi").alias("n"), F.min("isi").alias("least"), F.max("isi").alias("most"), r6(F.avg(s)).alias("mean"), r6(F.median(s)).alias("median"))


@query(f"SELECT least(isi // {HOUR}, 47) AS bin, count(*) AS n FROM {_ISI} WHERE isi BETWEEN 0 AND {48 * HOUR} GROUP BY 1")
def isi_hist(spark, sf):
    bin = trains.histogram(F.col("isi"), 0, HOUR, 48)
    return trains.intervals(events(spark, sf)).withColumn("bin", bin).where("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n")).select(F.col("bin").cast("long").alias("bin"), "n")


_RPV = f"SELECT unit, count(*) AS n, count(*) FILTER (isi < {REFRACTORY}) / count(*) AS rpv FROM {_ISI} GROUP BY unit"


@query(f"SELECT unit, n, round(rpv, 6) AS rpv FROM ({_RPV})")
def rpv_ratio(spark, sf):
    return trains.violation_ratio(events(spark, sf), REFRACTORY).select("unit", "n", r6("rpv").alias("rpv"))


@query(f"SELECT event_id, coalesce(t - lag(t) OVER w < {REFRACTORY}, false) AS before, coalesce(lead(t) OVER w - t < {REFRACTORY}, false) AS after FROM {EV} WINDOW w AS (PARTITION BY unit ORDER BY t, event_id)")
def rpv_flags(spark, sf):
    return trains.violation_flags(events(spark, sf), REFRACTORY).select("event_id", "before", "after")


@query(f"SELECT unit, n, round(rpv, 6) AS rpv, CASE WHEN n < 3 THEN 'noise' WHEN rpv <= 0.005 THEN 'good' ELSE 'mua' END AS label FROM ({_RPV.replace(EV, '(SELECT * FROM (' + _CROSS.replace('1.5', '0.5') + '))')})")
def prelabel(spark, sf):
    """Flagship: thresholds by channel, their crossings, and each unit's violations, rate and label."""
    v = trains.violation_ratio(_crossings(spark, sf, 0.5), REFRACTORY)
    return v.select("unit", "n", r6("rpv").alias("rpv"), F.when(F.col("n") < 3, "noise").when(F.col("rpv") <= 0.005, "good").otherwise("mua").alias("label"))


_BINS = f"(SELECT DISTINCT unit, round_even(t / {float(BIN)}, 0)::BIGINT AS bin FROM {EV})"

@query(f"SELECT a.unit, b.bin - a.bin AS lag, count(*) AS n FROM {_BINS} a JOIN {_BINS} b ON a.unit = b.unit AND b.bin - a.bin BETWEEN -{LAGS} AND {LAGS} AND a.bin <> b.bin GROUP BY 1, 2")
def autocorrelogram(spark, sf):
    b = trains.bins(events(spark, sf), BIN)
    return trains.correlogram(b, b, LAGS).where("unit = other and lag <> 0").groupBy("unit", F.col("lag").cast("long").alias("lag")).agg(F.count(F.lit(1)).alias("n"))


_CC = f"SELECT a.unit AS i, b.unit AS j, b.bin - a.bin AS lag, count(*) AS n FROM {_BINS} a JOIN {_BINS} b ON a.unit < b.unit AND b.bin - a.bin BETWEEN -{LAGS} AND {LAGS} GROUP BY 1, 2, 3"


@query(_CC)
def crosscorrelogram(spark, sf):
    return pairs.correlograms(trains.bins(events(spark, sf), BIN), LAGS)


@query(f"SELECT i, j, round(greatest(1 - (sum(n) FILTER (abs(lag) <= 1) / 3.0) / nullif(sum(n) / {2 * LAGS + 1}.0, 0), 0), 6) AS dip FROM ({_CC}) GROUP BY i, j")
def cc_dip_score(spark, sf):
    return dips(events(spark, sf)).select("i", "j", r6("dip").alias("dip"))


def dips(spikes):
    """(i, j, dip) of the units of some events: how far the middle of their correlogram is under its mean, 0 if nothing is in the middle."""
    n = pairs.near_and_all(trains.bins(spikes, BIN), LAGS, 1)
    d = 1 - F.col("near") / 3.0 / (F.col("n") / (2 * LAGS + 1.0))
    return n.select("i", "j", F.when(F.col("near") == 0, 0.0).otherwise(F.greatest(d, F.lit(0.0))).alias("dip"))


_HIST = f"(SELECT unit, t // {DAY} AS d, count(*) AS n FROM {EV} GROUP BY ALL)"


@query(f"SELECT a.unit AS i, b.unit AS j, count(*) AS days, sum(a.n)::BIGINT AS n_i, sum(b.n)::BIGINT AS n_j FROM {_HIST} a JOIN {_HIST} b ON a.d = b.d AND a.unit < b.unit GROUP BY 1, 2")
def joint_activity(spark, sf):
    table = _daily(spark, sf).select("unit", F.col("d").alias("at"), F.col("n").alias("value"))
    product = lambda a, b: np.stack([(a > 0) * 1.0 @ (b > 0).T, a @ (b > 0).T, (a > 0) * 1.0 @ b.T])
    return pairs.pairs(table, product, ["days", "n_i", "n_j"], turned=[0, 2, 1])


def _daily(spark, sf):
    return events(spark, sf).groupBy("unit", F.floor(F.col("t") / DAY).alias("d")).agg(F.count(F.lit(1)).alias("n"))


_P = f"(SELECT unit, d, n / sum(n) OVER (PARTITION BY unit) AS p FROM {_HIST})"


@query(f"SELECT a.unit AS i, b.unit AS j, round(sum(sqrt(a.p * b.p)), 6) AS bhatta FROM {_P} a JOIN {_P} b ON a.d = b.d AND a.unit < b.unit GROUP BY 1, 2")
def bhatta_hist(spark, sf):
    return bhattas(_daily(spark, sf)).select("i", "j", r6("bhatta").alias("bhatta"))


def bhattas(daily):
    """(i, j, bhatta) of units by the shares of their events in each day."""
    p = daily.select("unit", F.col("d").alias("at"), F.sqrt(F.col("n") / F.sum("n").over(Window.partitionBy("unit"))).alias("value"))
    return pairs.pairs(p, lambda a, b: (a @ b.T)[None], ["bhatta"], kind="double", band=1 / 256)  # 3,907 numbers of six decimals


@query(f"WITH m AS (SELECT channel, min(amp) AS lo, (max(amp) - min(amp)) / 50 AS w FROM {EV} GROUP BY channel) SELECT channel, least(floor((amp - lo) / w), 49)::BIGINT AS bin, count(*) AS n FROM {EV} JOIN m USING (channel) WHERE w > 0 GROUP BY 1, 2")
def amplitude_pdf(spark, sf):
    e = events(spark, sf)
    m = F.broadcast(e.groupBy("channel").agg(F.min("amp").alias("lo"), ((F.max("amp") - F.min("amp")) / 50).alias("w")))
    return e.join(m, "channel").where("w > 0").groupBy("channel", F.least(F.floor((F.col("amp") - F.col("lo")) / F.col("w")), F.lit(49)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT unit, bin, round(avg(amp), 6) AS mean FROM (SELECT unit, amp, (row_number() OVER (PARTITION BY unit ORDER BY t, event_id) - 1) // 4 AS bin FROM {EV}) GROUP BY unit, bin HAVING count(*) = 4")
def equal_count_amp_trend(spark, sf):
    return trains.equal_count_trend(events(spark, sf), "amp", 4).select("unit", "bin", r6("mean").alias("mean"))


_TREND = f"(SELECT *, avg(amp) OVER (PARTITION BY unit ORDER BY t, event_id ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS trend FROM {EV})"


@query(f"SELECT event_id, unit, CASE WHEN amp >= trend THEN 1 ELSE 0 END AS part FROM {_TREND}")
def trend_split(spark, sf):
    w = trains.line().rowsBetween(-10, 10)
    return events(spark, sf).select("event_id", "unit", F.when(F.col("amp") >= F.avg("amp").over(w), 1).otherwise(0).alias("part"))


_ZONES = f"(SELECT t AS start, t + {ZONE} AS stop FROM {EV} WHERE channel = 'error')"


def _zones(spark, sf):
    return events(spark, sf).where("channel = 'error'").select(F.col("t").alias("start"), (F.col("t") + ZONE).alias("stop"))


@query(f"SELECT event_id FROM {EV} e WHERE NOT EXISTS (SELECT 1 FROM {_ZONES} z WHERE e.t >= z.start AND e.t < z.stop)")
def dead_zone_anti(spark, sf):
    return joins.outside(events(spark, sf), _zones(spark, sf), ZONE).select("event_id")


@query(f"SELECT min(start) AS start, max(stop) AS stop FROM (SELECT *, sum(new) OVER (ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN start <= max(stop) OVER (ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM {_ZONES})) GROUP BY g")
def dead_zone_coalesce(spark, sf):
    return joins.coalesce_intervals(_zones(spark, sf), DAY)


@query(f"WITH s AS (SELECT day AS t, row_number() OVER (ORDER BY day) - 1 AS stream, lead(day) OVER (ORDER BY day) AS nxt FROM (SELECT DISTINCT t // {7 * DAY} * {7 * DAY} AS day FROM {EV})) SELECT event_id, stream, e.t - s.t AS rebased FROM {EV} e JOIN s ON e.t >= s.t AND (nxt IS NULL OR e.t < nxt)")
def stream_asof(spark, sf):
    e = events(spark, sf)
    starts = e.select((F.floor(F.col("t") / (7 * DAY)) * (7 * DAY)).alias("t")).distinct()
    starts = starts.withColumn("stream", F.struct((F.row_number().over(Window.orderBy("t")) - 1).cast("long").alias("n"), F.col("t").alias("t0")))
    return joins.as_of(e, starts, "stream", DAY).select("event_id", F.col("stream.n").alias("stream"), (F.col("t") - F.col("stream.t0")).alias("rebased"))


@query(f"SELECT d AS stream, n, (sum(n) OVER (ORDER BY d) - n)::BIGINT AS first FROM (SELECT t // {DAY} AS d, count(*) AS n FROM {EV} GROUP BY 1)")
def stream_offsets(spark, sf):
    days = events(spark, sf).groupBy(F.floor(F.col("t") / DAY).alias("stream")).agg(F.count(F.lit(1)).alias("n"))
    return days.select("stream", "n", (F.sum("n").over(Window.orderBy("stream")) - F.col("n")).alias("first"))


_SPAN = f"(SELECT min(t) AS lo, max(t) AS hi FROM {EV})"


@query(f"SELECT event_id, k AS stream, t - (lo + k * {DAY * 7}) AS rebased FROM {EV}, {_SPAN}, (SELECT unnest(range(0, (hi - lo) // {DAY * 7} + 1)) AS k FROM {_SPAN}) WHERE t >= lo + k * {DAY * 7} AND t <= lo + (k + 1) * {DAY * 7}")
def slice_per_stream(spark, sf):
    """Both ends of a slice belong to it, as in a result that is cut by stream: an event on a border is in the slice before too."""
    e = events(spark, sf)
    lo = F.broadcast(e.agg(F.min("t").alias("lo")))  # one row
    k = F.floor((F.col("t") - F.col("lo")) / (7 * DAY))
    border = ((F.col("t") - F.col("lo")) % (7 * DAY) == 0) & (k > 0)
    sliced = e.crossJoin(lo).withColumn("stream", F.explode(F.when(border, F.array(k - 1, k)).otherwise(F.array(k))))
    return sliced.select("event_id", "stream", (F.col("t") - F.col("lo") - F.col("stream") * (7 * DAY)).alias("rebased"))


_TRIG = f"(SELECT event_id, t FROM {EV} WHERE channel = 'purchase')"


def _triggers(spark, sf):
    return events(spark, sf).where("channel = 'purchase'").select("event_id", "t")


@query(f"SELECT g.event_id AS repeat, e.event_id, e.t - g.t AS lag FROM {EV} e JOIN {_TRIG} g ON e.t - g.t BETWEEN 0 AND {HOUR}")
def raster_repeats(spark, sf):
    return joins.raster(events(spark, sf), _triggers(spark, sf), 0, HOUR).select(F.col("trigger_event_id").alias("repeat"), "event_id", "lag")


@query(f"SELECT floor((e.t - g.t) / {5.0 * MINUTE})::BIGINT AS bin, count(*) AS n FROM {EV} e JOIN {_TRIG} g ON e.t - g.t BETWEEN -{HOUR} AND {HOUR} GROUP BY 1")
def peri_event_hist(spark, sf):
    near = joins.around(events(spark, sf), _triggers(spark, sf), HOUR, HOUR)
    return near.groupBy(F.floor(F.col("lag") / (5.0 * MINUTE)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


_ART = f"SELECT channel, (e.t - g.t) // {10 * MINUTE} AS tau, median(amp) AS artefact FROM {EV} e JOIN {_TRIG} g ON e.t - g.t BETWEEN 0 AND {HOUR} GROUP BY 1, 2"


def _artefact(spark, sf):
    """(channel, tau, artefact), from counts of the triggers before each event, not from pairs. A lag of ``HOUR`` itself is a tau of its own."""
    edges = [*range(0, HOUR + 1, 10 * MINUTE), HOUR + 1]
    near = joins.lag_counts(events(spark, sf).select("channel", "t", "amp"), _triggers(spark, sf), edges)
    return robust.weighted_medians(near, ["channel"], "amp", "counts", "artefact").withColumn("tau", F.col("k").cast("long"))


@query(f"SELECT channel, tau, round(artefact, 6) AS artefact FROM ({_ART})")
def trigger_median_artefact(spark, sf):
    return _artefact(spark, sf).select("channel", "tau", r6("artefact").alias("artefact"))


@query(f"SELECT g.event_id AS repeat, e.event_id, round(amp - artefact, 6) AS cleaned FROM {EV} e JOIN {_TRIG} g ON e.t - g.t BETWEEN 0 AND {HOUR} JOIN ({_ART}) a ON a.channel = e.channel AND a.tau = (e.t - g.t) // {10 * MINUTE}")
def artefact_subtract(spark, sf):
    near = joins.around(events(spark, sf), _triggers(spark, sf), 0, HOUR).withColumn("tau", F.floor(F.col("lag") / (10 * MINUTE)))
    art = F.broadcast(_artefact(spark, sf).select("channel", "tau", "artefact"))  # seven rows for each channel
    return near.join(art, ["channel", "tau"]).select(F.col("trigger_event_id").alias("repeat"), "event_id", r6(F.col("amp") - F.col("artefact")).alias("cleaned"))


_CLICK, _VIEW = (f"(SELECT * FROM {EV} WHERE channel = '{c}')" for c in ("click", "view"))
_TP = f"SELECT unit, count(*) AS n, count(*) FILTER (hit) AS tp, count(*) FILTER (NOT hit) AS fp FROM (SELECT *, EXISTS (SELECT 1 FROM {_VIEW} v WHERE v.unit = c.unit AND abs(v.t - c.t) < {6 * HOUR}) AS hit FROM {_CLICK} c) GROUP BY unit"


def _sides(spark, sf):
    e = events(spark, sf)
    return e.where("channel = 'click'"), e.where("channel = 'view'").select("event_id", "unit", "t")


def _tp(spark, sf):
    a, b = _sides(spark, sf)
    return joins.matched(a, b, ["unit"], 6 * HOUR).groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("hit"), 1)).alias("tp"), F.count(F.when(~F.col("hit"), 1)).alias("fp"))


@query(_TP)
def band_match_tp_fp(spark, sf):
    return _tp(spark, sf)


@query(f"SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, round(sum(tp) / sum(n), 6) AS precision FROM ({_TP})")
def contingency(spark, sf):
    return _tp(spark, sf).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), r6(F.sum("tp") / F.sum("n")).alias("precision"))


_NEAR = f"(SELECT c.event_id, c.t, (SELECT max(v.t) FROM {_VIEW} v WHERE v.unit = c.unit AND v.t <= c.t) AS before, (SELECT min(v.t) FROM {_VIEW} v WHERE v.unit = c.unit AND v.t >= c.t) AS after FROM {_CLICK} c)"


@query(f"SELECT event_id, coalesce(before, -1) AS before, coalesce(after, -1) AS after FROM {_NEAR}")
def nearest_match(spark, sf):
    a, b = _sides(spark, sf)
    none = F.lit(-1).cast("long")
    return joins.nearest(a, b, ["unit"]).select("event_id", F.coalesce("before", none).alias("before"), F.coalesce("after", none).alias("after"))


@query(f"SELECT event_id, least(t - before, after - t) AS gap FROM {_NEAR} WHERE before IS NOT NULL OR after IS NOT NULL")
def nearest_distance(spark, sf):
    a, b = _sides(spark, sf)
    n = joins.nearest(a, b, ["unit"]).where("before is not null or after is not null")
    return n.select("event_id", F.least(F.col("t") - F.col("before"), F.col("after") - F.col("t")).alias("gap"))


_FEATURES = f"(SELECT channel = 'purchase' AS yes, amp AS x, (t % {DAY}) / {float(HOUR)} AS y FROM {EV})"
_FIT = f"(SELECT avg(x) AS mx, avg(y) AS my, var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(x, y) AS cxy FROM {_FEATURES} WHERE yes)"
_MAHALANOBIS = f"(SELECT yes, (vy * (x - mx) ** 2 - 2 * cxy * (x - mx) * (y - my) + vx * (y - my) ** 2) / (vx * vy - cxy * cxy) AS d FROM {_FEATURES}, {_FIT})"
CUTS = 300


def _distances(spark, sf):
    """Squared Mahalanobis distance of every event to the purchases, in amplitude and hour of day, from one row of moments."""
    f = events(spark, sf).select((F.col("channel") == "purchase").alias("yes"), F.col("amp").alias("x"), (F.pmod("t", F.lit(DAY)) / float(HOUR)).alias("y"))
    m = f.where("yes").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop("x", "y").alias("cxy"))
    dx, dy = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    d = (F.col("vy") * dx * dx - 2 * F.col("cxy") * dx * dy + F.col("vx") * dy * dy) / (F.col("vx") * F.col("vy") - F.col("cxy") * F.col("cxy"))
    return f.crossJoin(F.broadcast(m)).select("yes", d.alias("d"))


def _confusion(spark, sf):
    """(k, tp, fn, fp, tn) of each cut-off: events nearer than it are accepted. The cut-offs are ``CUTS`` of the different distances, from
    the least to the largest, evenly spaced in their order.

    Distances are ranked inside cells of a fixed monotone function of their value, and the cells' sizes add up to offsets. An event
    goes into the bin of the first cut-off that takes it, and the counts add up from bin to bin.
    """
    d = F.round("d", 6)
    cell = F.floor(F.asinh("d") * 256).alias("cell")
    different = _distances(spark, sf).groupBy(d.alias("d")).agg(F.count(F.when(F.col("yes"), 1)).alias("yes"), F.count(F.when(~F.col("yes"), 1)).alias("no")).select("d", "yes", "no", cell)
    sizes = different.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    cells = Window.orderBy("cell")  # some thousand rows at most
    offsets = sizes.select("cell", (F.sum("n").over(cells) - F.col("n")).alias("offset"), F.sum("n").over(Window.partitionBy()).alias("total"))
    ranked = different.join(F.broadcast(offsets), "cell").withColumn("rank", F.col("offset") + F.row_number().over(Window.partitionBy("cell").orderBy("d")))
    bin = F.expr(f"least(({CUTS - 1} * rank + total - 2) div nullif(total - 1, 0), {CUTS})")
    n = ranked.groupBy(F.coalesce(bin, F.lit(CUTS)).alias("k")).agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    both = spark.range(CUTS + 1).withColumnRenamed("id", "k").join(n, "k", "left").select("k", F.coalesce("yes", F.lit(0)).alias("yes"), F.coalesce("no", F.lit(0)).alias("no"))
    line, whole = Window.orderBy("k"), Window.partitionBy()  # CUTS + 1 rows
    summed = both.select("k", F.sum("yes").over(line).alias("tp"), F.sum("no").over(line).alias("fp"), F.sum("yes").over(whole).alias("y"), F.sum("no").over(whole).alias("n"))
    double = lambda c: F.expr(c).cast("double")
    return summed.where(F.col("k") < CUTS).select("k", double("tp").alias("tp"), double("y - tp").alias("fn"), double("fp").alias("fp"), double("n - fp").alias("tn"))


def costs(spark, sf):
    """(k, cost): one minus the correlation of being accepted with being of the class, 1 where there is none."""
    root = F.expr("sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))")
    return _confusion(spark, sf).select("k", F.coalesce(1 - F.expr("tp * tn - fp * fn") / F.nullif(root, F.lit(0.0)), F.lit(1.0)).alias("cost"))


_CM = f"""(WITH e AS (SELECT yes, round(d, 6) AS d FROM {_MAHALANOBIS}), u AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT d FROM e)),
c AS (SELECT k, d AS cut FROM u, (SELECT unnest(range({CUTS})) AS k) WHERE r = k * (n - 1) // {CUTS - 1})
SELECT k, count(*) FILTER (yes AND d < cut)::DOUBLE AS tp, count(*) FILTER (yes AND d >= cut)::DOUBLE AS fn, count(*) FILTER (NOT yes AND d < cut)::DOUBLE AS fp, count(*) FILTER (NOT yes AND d >= cut)::DOUBLE AS tn FROM e, c GROUP BY k)"""


@query(f"SELECT k, round(tp / nullif(tp + fn, 0), 6) AS tpr, round(fp / nullif(fp + tn, 0), 6) AS fpr FROM {_CM}")
def roc_curve(spark, sf):
    """True and false positive rates at cut-offs of the Mahalanobis distance to the class."""
    return _confusion(spark, sf).select("k", r6(F.expr("tp / nullif(tp + fn, 0)")).alias("tpr"), r6(F.expr("fp / nullif(fp + tn, 0)")).alias("fpr"))


@query(f"SELECT k, round(coalesce(1 - (tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 1), 6) AS cost FROM {_CM}")
def mcc_score(spark, sf):
    return costs(spark, sf).select("k", r6("cost").alias("cost"))


@query(f"SELECT k, round(tp / nullif(tp + fn, 0) / 2 + tn / nullif(tn + fp, 0) / 2, 6) AS accuracy FROM {_CM}")
def weighted_accuracy(spark, sf):
    """Each class counts a half, whatever its size."""
    return _confusion(spark, sf).select("k", r6(F.expr("tp / nullif(tp + fn, 0) / 2 + tn / nullif(tn + fp, 0) / 2")).alias("accuracy"))


@query(f"SELECT event_id, dense_rank() OVER (ORDER BY unit // 3) - 1 AS unit FROM {EV}")
def apply_merges(spark, sf):
    """Units are merged in threes and numbered anew without gaps; the map is a row for each unit."""
    e = events(spark, sf)
    to = e.select("unit").distinct().withColumn("new", (F.dense_rank().over(Window.orderBy(F.floor(F.col("unit") / 3))) - 1).cast("long"))
    return e.join(to, "unit").select("event_id", F.col("new").alias("unit"))


@query(f"SELECT unit, row_number() OVER (ORDER BY unit) - 1 AS idx FROM (SELECT DISTINCT unit FROM {EV})")
def relabel_dense(spark, sf):
    return events(spark, sf).select("unit").distinct().withColumn("idx", (F.row_number().over(Window.orderBy("unit")) - 1).cast("long"))


@query(f"SELECT event_id, unit FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY (event_id * 2654435761) % 4294967296, event_id) AS r FROM {EV}) WHERE r <= 5")
def quota_sample(spark, sf):
    h = (F.col("event_id") * 2654435761) % 4294967296
    w = Window.partitionBy("unit").orderBy(h, "event_id")
    return events(spark, sf).withColumn("r", F.row_number().over(w)).where("r <= 5").select("event_id", "unit")


@query(f"SELECT unit, event_id, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY abs(amp) DESC, event_id) AS r FROM {EV}) WHERE r <= 3")
def snippet_modes(spark, sf):
    w = Window.partitionBy("unit").orderBy(F.desc(F.abs("amp")), "event_id")
    return events(spark, sf).withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 3").select("unit", "event_id", "rank")


@query(f"SELECT unit, sum(CASE WHEN gap IS NULL OR gap > {6 * HOUR} THEN 1 ELSE 0 END)::BIGINT AS sessions FROM (SELECT unit, t - lag(t) OVER (PARTITION BY unit ORDER BY t, event_id) AS gap FROM {EV}) GROUP BY unit")
def session_groups(spark, sf):
    return trains.intervals(events(spark, sf)).groupBy("unit").agg(F.sum((F.col("isi").isNull() | (F.col("isi") > 6 * HOUR)).cast("long")).alias("sessions"))


@query(f"SELECT channel, t // {DAY} AS day, count(*) AS n, round(avg(amp), 6) AS mean, round(max(amp), 6) AS top FROM {EV} GROUP BY 1, 2")
def tumbling_stats(spark, sf):
    return events(spark, sf).groupBy("channel", F.floor(F.col("t") / DAY).alias("day")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("amp")).alias("mean"), r6(F.max("amp")).alias("top"))


@query(f"SELECT channel, (t // {6 * HOUR}) - k AS slot, count(*) AS n FROM {EV}, range(4) r(k) GROUP BY 1, 2")
def sliding_stats(spark, sf):
    """Windows of a day every six hours: an event counts in four."""
    slots = F.explode(F.sequence(F.floor(F.col("t") / (6 * HOUR)) - 3, F.floor(F.col("t") / (6 * HOUR))))
    return events(spark, sf).select("channel", slots.alias("slot")).groupBy("channel", "slot").agg(F.count(F.lit(1)).alias("n"))


_GAPS = f"(SELECT channel, t AS start, lead(t) OVER (PARTITION BY channel ORDER BY t, event_id) AS stop FROM {EV})"


@query(f"SELECT channel, start, stop, (stop - start) // {HOUR} AS slots FROM {_GAPS} WHERE stop - start >= {HOUR}")
def silent_runs(spark, sf):
    gaps = joins.neighbours(events(spark, sf), ["channel"], ["t", "event_id"], ["t"], DAY).select("channel", F.col("t").alias("start"), F.col("after.t").alias("stop"))
    return gaps.where(F.col("stop") - F.col("start") >= HOUR).select("channel", "start", "stop", F.floor((F.col("stop") - F.col("start")) / HOUR).alias("slots"))


@query(f"SELECT event_id FROM ({_CROSS}) c WHERE NOT EXISTS (SELECT 1 FROM {_VIEW} v WHERE v.unit = c.unit AND abs(v.t - c.t) < {TOLERANCE})")
def unexplained_crossings(spark, sf):
    c = _crossings(spark, sf)
    return joins.matched(c, _sides(spark, sf)[1], ["unit"], TOLERANCE).where("not hit").select("event_id")


@query(f"SELECT count(*) AS n, count(DISTINCT unit) AS units, count(DISTINCT channel) AS channels, max(t) - min(t) AS steps, round((max(t) - min(t)) / {float(MINUTE)}, 6) AS minutes FROM {EV}")
def recording_summary(spark, sf):
    return events(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("unit").alias("units"), F.countDistinct("channel").alias("channels"), (F.max("t") - F.min("t")).alias("steps"), r6((F.max("t") - F.min("t")) / float(MINUTE)).alias("minutes"))
