"""Merging units after the fit: pairs are scored by how alike they are and whether they avoid each other's refractory time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import trains
from .pairs import near_and_all


def scores(spikes: DataFrame, pairs: DataFrame, width: int, lags: int, period: int) -> DataFrame:
    """(i, j, similarity, dip, rpv) of ``pairs`` (i, j, similarity) of units of ``spikes`` (event_id, unit, t): how far the middle of their
    correlogram lies under its mean, and the share of intervals under ``period`` that both together would have."""
    counts = near_and_all(trains.bins(spikes, width), lags, 1)
    dips = counts.select("i", "j", F.greatest(1 - F.col("near") / 3 / (F.col("n") / (2 * lags + 1)), F.lit(0.0)).alias("dip"))
    named = pairs.select("i", "j", F.explode(F.array("i", "j")).alias("unit"))
    both = spikes.join(named, "unit").select(F.struct("i", "j").alias("unit"), "t", "event_id")
    rpv = trains.violation_ratio(both, period).select("unit.i", "unit.j", "rpv")
    return pairs.join(rpv, ["i", "j"]).join(dips, ["i", "j"], "left").select("i", "j", "similarity", F.coalesce("dip", F.lit(0.0)).alias("dip"), "rpv")


def suggest(scored: DataFrame, similarity: float, dip: float, rpv: float) -> DataFrame:
    """(i, j) of units to be merged: alike, with a dip in the middle of their correlogram and few violations together."""
    return scored.where((F.col("similarity") >= similarity) & (F.col("dip") >= dip) & (F.col("rpv") <= rpv)).select("i", "j")


def resolve(pairs: list[tuple[int, int]], units: list[int]) -> dict[int, int]:
    """The unit that each becomes after the pairs are merged in order; of two the second stays, and later pairs follow earlier merges."""
    into = {u: u for u in units}

    def root(u: int) -> int:
        while into[u] != u:
            u = into[u]
        return u

    for i, j in pairs:
        a, b = root(i), root(j)
        if a != b:
            into[a] = b
    return {u: root(u) for u in units}


def renumber(spikes: DataFrame, into: dict[int, int]) -> DataFrame:
    """``spikes`` with ``unit`` merged and numbered anew without gaps, in the order of the units that stay; others' spikes go."""
    kept = {u: k for k, u in enumerate(sorted(set(into.values())))}
    rows = spikes.sparkSession.createDataFrame([(u, kept[v]) for u, v in into.items()], "unit long, _unit long")  # one row for each unit
    return spikes.join(rows, "unit").drop("unit").withColumnRenamed("_unit", "unit")


def slice_templates(templates: DataFrame, into: DataFrame) -> DataFrame:
    """Templates (unit, low, high, norm, purity) after merges (unit, target): of a merged group the row of its target, with the widest of all
    bounds, scaled by how large the merged ones are against it, and the mean purity; units without a target go."""
    both = templates.join(into, "unit")
    line = Window.partitionBy("target")
    own = F.max(F.when(F.col("unit") == F.col("target"), F.col("norm"))).over(line)
    scaled = both.withColumn("ratio", F.col("norm") / own)
    return scaled.groupBy(F.col("target").alias("unit")).agg(F.min(F.col("ratio") * F.col("low")).alias("low"), F.max(F.col("ratio") * F.col("high")).alias("high"), F.max(F.when(F.col("unit") == F.col("target"), F.col("norm"))).alias("norm"), F.avg("purity").alias("purity"))
