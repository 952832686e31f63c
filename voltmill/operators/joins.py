"""Joins in time: bands, intervals, nearest and as-of matches.

A tolerance never becomes a theta join: times are cut into buckets of the tolerance's length, one side is repeated into the three
buckets that its partners may lie in, and the buckets are joined by equality.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import materialise, release


def band(a: DataFrame, b: DataFrame, on: list[str], tolerance: int, strict: bool = True) -> DataFrame:
    """Pairs with |a.t - b.t| under ``tolerance`` (or equal to it, if not ``strict``): columns of a as they are, those of b as b_*."""
    width = max(1, tolerance)
    left = a.withColumn("_bucket", F.floor(F.col("t") / width))
    right = b.select(*on, *(F.col(c).alias(f"b_{c}") for c in b.columns if c not in on))
    right = right.withColumn("_bucket", F.explode(F.array(*(F.floor(F.col("b_t") / width) + k for k in (-1, 0, 1)))))
    gap = F.abs(F.col("t") - F.col("b_t"))
    return left.join(right, [*on, "_bucket"]).where(gap < tolerance if strict else gap <= tolerance).drop("_bucket")


def matched(a: DataFrame, b: DataFrame, on: list[str], tolerance: int) -> DataFrame:
    """``a`` with ``hit``: whether b has an event of the same key within the tolerance."""
    hits = band(a, b, on, tolerance).select("event_id").distinct().withColumn("hit", F.lit(True))
    return a.join(hits, "event_id", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def nearest(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """``a`` with ``before`` and ``after``: the time of b's last event at or before and its first at or after, null if none.

    Both sides go through one sort by key and time, without a join.
    """
    both = a.withColumn("_b", F.lit(None).cast("long")).withColumn("_mine", F.lit(True)).unionByName(b.select(*on, F.col("t"), F.col("t").alias("_b")).withColumn("_mine", F.lit(False)), allowMissingColumns=True)
    up = Window.partitionBy(*on).orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*on).orderBy("t").rangeBetween(0, Window.unboundedFollowing)
    return both.withColumn("before", F.max("_b").over(up)).withColumn("after", F.min("_b").over(down)).where("_mine").drop("_b", "_mine")


def as_of(events: DataFrame, starts: DataFrame, name: str, width: int) -> DataFrame:
    """``events`` with the last of ``starts`` (t, name) at or before each, null before the first.

    Each start is listed under every bucket of ``width`` until the next one, so that events find theirs by equality on the bucket.
    """
    line = Window.orderBy("t")  # one row for each stream
    last = events.agg(F.max("t").alias("_last"))
    spans = starts.select(F.col("t").alias("_from"), name, F.lead("t").over(line).alias("_to")).crossJoin(F.broadcast(last))  # one row
    until = F.greatest(F.col("_from"), F.coalesce(F.col("_to") - 1, F.col("_last"), F.col("_from")))
    listed = spans.select("_from", "_to", name, F.explode(F.sequence(F.floor(F.col("_from") / width), F.floor(until / width))).alias("_bucket"))
    keyed = events.withColumn("_bucket", F.floor(F.col("t") / width))
    s = listed.alias("s")
    on = (keyed["_bucket"] == F.col("s._bucket")) & (keyed["t"] >= F.col("s._from")) & (F.col("s._to").isNull() | (keyed["t"] < F.col("s._to")))
    return keyed.join(s, on, "left").drop(F.col("s._bucket")).drop("_from", "_to", "_bucket")


def coalesce_intervals(zones: DataFrame, width: int) -> DataFrame:
    """(start, stop): half-open intervals with those that touch or overlap merged.

    Zones are put in order within buckets of ``width`` by their start. What a bucket needs to know of all earlier ones is how far
    they reach and where the last merged zone began; both are running maxima over one row for each bucket.
    """
    keyed = zones.where(F.col("stop") > F.col("start")).select("start", "stop", F.floor(F.col("start") / width).alias("_bucket"))
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    line = Window.partitionBy("_bucket").orderBy("start", "stop")
    reach = keyed.groupBy("_bucket").agg(F.max("stop").alias("_far")).select("_bucket", F.max("_far").over(earlier).alias("_reach"))
    own = F.max("stop").over(line.rowsBetween(Window.unboundedPreceding, -1))
    marked = keyed.join(reach, "_bucket").withColumn("_own", own)
    so_far = F.greatest("_reach", "_own")
    first = marked.withColumn("_first", F.when(so_far.isNull() | (F.col("start") > so_far), F.col("start"))).drop("_reach", "_own")
    began = first.groupBy("_bucket").agg(F.max("_first").alias("_f")).select("_bucket", F.max("_f").over(earlier).alias("_began"))
    run = F.max("_first").over(line.rowsBetween(Window.unboundedPreceding, 0))
    grouped = first.withColumn("_run", run).join(began, "_bucket").withColumn("_group", F.coalesce("_run", "_began"))
    return grouped.groupBy("_group").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).select("start", "stop")


def neighbours(events: DataFrame, by: list[str], order: list[str], fields: list[str], width: int) -> DataFrame:
    """``events`` with ``before`` and ``after``: structs of ``fields`` of the previous and the next event of the same key, null at the ends.

    A key's events are put in order within buckets of ``width`` of the first of ``order``; the neighbours across a border come from
    one row for each key and bucket, its first and last event.
    """
    cell = [*by, "_bucket"]
    keyed = events.withColumn("_bucket", F.floor(F.col(order[0]) / width))
    whole = F.struct(*order, F.struct(*fields).alias("_f"))
    ends = keyed.groupBy(*cell).agg(F.min(whole).alias("_first"), F.max(whole).alias("_last"))
    cells = Window.partitionBy(*by).orderBy("_bucket")
    ends = ends.select(*cell, F.lag("_last").over(cells)["_f"].alias("_left"), F.lead("_first").over(cells)["_f"].alias("_right"))
    line = Window.partitionBy(*cell).orderBy(*order)
    own = keyed.withColumn("_before", F.lag(F.struct(*fields)).over(line)).withColumn("_after", F.lead(F.struct(*fields)).over(line))
    joined = own.join(ends, cell)
    return joined.withColumn("before", F.coalesce("_before", "_left")).withColumn("after", F.coalesce("_after", "_right")).drop("_before", "_after", "_left", "_right", "_bucket")


def outside(events: DataFrame, zones: DataFrame, width: int) -> DataFrame:
    """Events in none of the half-open ``zones``, which are listed under each bucket of ``width`` that they touch."""
    listed = zones.where(F.col("stop") > F.col("start")).select("start", "stop", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("stop") - 1) / width))).alias("_bucket"))
    keyed = events.withColumn("_bucket", F.floor(F.col("t") / width))
    z = listed.alias("z")
    return keyed.join(z, (keyed["_bucket"] == F.col("z._bucket")) & (keyed["t"] >= F.col("z.start")) & (keyed["t"] < F.col("z.stop")), "left_anti").drop("_bucket")


def around(events: DataFrame, triggers: DataFrame, before: int, after: int) -> DataFrame:
    """(trigger columns as trigger_*, event columns, lag): events from ``before`` earlier to ``after`` later than each trigger, ends included."""
    width = max(1, before + after)
    keyed = events.withColumn("_bucket", F.floor(F.col("t") / width))
    wide = triggers.select(*(F.col(c).alias(f"trigger_{c}") for c in triggers.columns)).withColumn("_bucket", F.explode(F.sequence(F.floor((F.col("trigger_t") - before) / width), F.floor((F.col("trigger_t") + after) / width))))
    return keyed.join(wide, "_bucket").withColumn("lag", F.col("t") - F.col("trigger_t")).where(F.col("lag").between(-before, after)).drop("_bucket")


#: Of ``raster``: the events or triggers of a block, the triggers that all events of a block meet before the next ones, the events for each task.
BLOCK, SLICE, TASK = 4096, 256, 1 << 14


def raster(events: DataFrame, triggers: DataFrame, before: int, after: int) -> DataFrame:
    """(trigger_event_id, event_id, lag): the pairs of ``around``, in an order that takes little room in files of columns.

    What is dealt out are blocks of a bucket's events with blocks of its triggers, both in order of time; a task makes the pairs of its
    blocks and sends none. A slice of triggers is gone through again for each event, so that the event is the same for a whole slice, the
    triggers repeat from event to event, and lags of equal times lie side by side: encodings by runs and repeats make little of that. The
    pairs are far more than the bytes of the blocks tell, so the number of tasks follows the number of events.
    """
    width = max(1, before + after)
    bucket = lambda t: F.floor(t / width)

    def blocks(keyed: DataFrame, name: str) -> DataFrame:
        line = Window.partitionBy("_bucket").orderBy("t", "event_id")
        cut = keyed.withColumn(f"_{name}", F.floor((F.row_number().over(line) - 1) / BLOCK))
        return cut.groupBy("_bucket", f"_{name}").agg(F.sort_array(F.collect_list(F.struct("t", "event_id"))).alias(name))

    e, g = (df.where("t is not null").select("t", "event_id") for df in (events, triggers))
    own = blocks(e.withColumn("_bucket", bucket(F.col("t"))), "e")
    wide = blocks(g.withColumn("_bucket", F.explode(F.sequence(bucket(F.col("t") - before), bucket(F.col("t") + after)))), "g")
    dealt = own.join(wide, "_bucket").repartition(events.count() // TASK + 1, "_bucket", "_e", "_g")
    slices = F.expr(f"transform(sequence(0L, (size(g) - 1) div {SLICE}), k -> slice(g, cast(k * {SLICE} + 1 as int), {SLICE}))")
    met = dealt.select("e", F.explode(slices).alias("g"))
    reach = lambda x: (x["t"] >= F.col("g")[0]["t"] - before) & (x["t"] <= F.element_at("g", -1)["t"] + after)
    met = met.select(F.explode(F.filter("e", reach)).alias("e"), "g")  # of a filter, Spark gives one event after another and collects none
    pairs = met.select("e", F.explode("g").alias("g")).withColumn("lag", F.col("e.t") - F.col("g.t")).where(F.col("lag").between(-before, after))
    return pairs.select(F.col("g.event_id").alias("trigger_event_id"), F.col("e.event_id").alias("event_id"), "lag")


def lag_counts(events: DataFrame, triggers: DataFrame, edges: list[int]) -> DataFrame:
    """``events`` with ``counts``: how many triggers lie by at least ``edges[k]`` and less than ``edges[k + 1]`` before each, for every k.

    The pairs that ``around`` would give are counted and not made: the triggers in reach of a bucket are put in order once, and a count is
    the difference of two places in that order.
    """
    width = max(1, edges[-1] - edges[0])
    keyed = events.where("t is not null").withColumn("_bucket", F.floor(F.col("t") / width)).withColumn("_own", F.lit(True))
    reach = F.sequence(F.floor((F.col("t") + edges[0]) / width), F.floor((F.col("t") + edges[-1]) / width))
    wide = triggers.where("t is not null").select("t", F.lit(False).alias("_own"), F.explode(reach).alias("_bucket"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema)

    def run(table: pa.Table) -> pa.Table:
        own = table.column("_own")
        mine = table.filter(own).drop_columns(["_bucket", "_own"])
        at = np.sort(table.filter(pc.invert(own)).column("t").to_numpy())
        t = mine.column("t").to_numpy()
        upto = np.stack([np.searchsorted(at, t - e, side="right") for e in edges], axis=1)  # triggers at least e before
        counts = (upto[:, :-1] - upto[:, 1:]).astype(np.int64)
        lists = pa.ListArray.from_arrays(np.arange(len(t) + 1, dtype=np.int32) * counts.shape[1], pa.array(counts.ravel()))
        return mine.append_column("counts", lists)

    return keyed.unionByName(wide, allowMissingColumns=True).groupBy("_bucket").applyInArrow(run, f"{kinds}, counts array<long>")


def safety(events: DataFrame, by: list[str], priority: str, tolerance: int, width: int) -> DataFrame:
    """The events that are taken one after another by falling ``priority``, then time, then event_id, each of which bars all others of its
    key less than ``tolerance`` away.

    In each round every event that comes first among those still open around it is taken and the ones it bars are closed, which
    ends with the same events as going through them one by one. A round works on buckets of ``width`` with a halo of the
    tolerance, and is written to the shared folder. The number of rounds grows with the longest row of ever larger neighbours.
    """
    near = max(0, tolerance - 1)
    bucket = lambda t: F.floor(t / width)
    rank = F.struct(F.col(priority).alias("p"), (-F.col("t")).alias("t"), (-F.col("event_id")).alias("id"))
    around = Window.partitionBy(*by, "_bucket").orderBy("t").rangeBetween(-near, near)
    rest = materialise(events.where(F.col(priority).isNotNull()).select(*by, "t", "event_id", rank.alias("_rank")))
    taken = []
    while not rest.isEmpty():
        halo = lambda df: df.withColumn("_bucket", F.explode(F.sequence(bucket(F.col("t") - near), bucket(F.col("t") + near))))
        own = F.col("_bucket") == bucket(F.col("t"))
        marked = halo(rest).withColumn("_top", F.max("_rank").over(around)).where(own).withColumn("_first", F.col("_rank") == F.col("_top")).drop("_bucket", "_top")
        marked = materialise(marked)
        taken.append(marked.where("_first").select("event_id"))
        barred = halo(marked).withColumn("_barred", F.max("_first").over(around)).where(own)
        rest, done = materialise(barred.where("not _barred").drop("_bucket", "_first", "_barred")), rest
        release(done)
    found = taken[0] if taken else events.limit(0).select("event_id")
    for more in taken[1:]:
        found = found.unionByName(more)
    return events.join(found, "event_id", "left_semi")
