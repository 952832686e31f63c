"""Event trains: intervals, refractory violations, rates, correlograms and amplitude trends.

An event has a ``unit``, a time ``t`` in whole steps and an id ``event_id`` that breaks ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def line():
    """A unit's events in time."""
    return Window.partitionBy("unit").orderBy("t", "event_id")


def intervals(events: DataFrame) -> DataFrame:
    """Adds ``isi``: the time since the unit's previous event, null at its first."""
    return events.withColumn("isi", F.col("t") - F.lag("t").over(line()))


def refractory(events: DataFrame, period: int) -> DataFrame:
    """Drops events that follow the raw previous one within ``period``."""
    return intervals(events).where(F.col("isi").isNull() | (F.col("isi") > period)).drop("isi")


def violation_flags(events: DataFrame, period: int) -> DataFrame:
    """Adds ``before`` and ``after``: whether the neighbouring event is nearer than ``period``."""
    gap = F.lead("t").over(line()) - F.col("t")
    return intervals(events).withColumn("before", F.coalesce(F.col("isi") < period, F.lit(False))).withColumn("after", F.coalesce(gap < period, F.lit(False))).drop("isi")


def violation_ratio(events: DataFrame, period: int) -> DataFrame:
    """(unit, n, rpv): intervals under ``period`` over events."""
    return intervals(events).groupBy("unit").agg(F.count(F.lit(1)).alias("n"), (F.sum((F.col("isi") < period).cast("int")) / F.count(F.lit(1))).alias("ratio")).select("unit", "n", F.coalesce("ratio", F.lit(0.0)).alias("rpv"))


def histogram(value: Column, low: float, width: float, bins: int) -> Column:
    """The number of the bin of equal width, the upper edge in the last; null outside."""
    at = F.floor((value - low) / width).cast("int")
    return F.when((value >= low) & (value <= low + width * bins), F.least(at, F.lit(bins - 1)))


def bins(events: DataFrame, width: int) -> DataFrame:
    """(unit, bin): each bin that has an event once. Bins are nearest multiples, halves to the even one."""
    return events.select("unit", F.bround(F.col("t") / width).cast("long").alias("bin")).distinct()


def correlogram(a: DataFrame, b: DataFrame, lags: int) -> DataFrame:
    """(lag, n): pairs of bins (unit a, bin) and (unit b, bin + lag), |lag| <= ``lags``, joined on the bin, one side repeated for each lag."""
    moved = b.select(F.col("unit").alias("other"), "bin", F.explode(F.sequence(F.lit(-lags), F.lit(lags))).alias("lag")).select("other", (F.col("bin") - F.col("lag")).alias("bin"), "lag")
    return a.join(moved, "bin")


def equal_count_trend(events: DataFrame, value: str, per_bin: int) -> DataFrame:
    """(unit, bin, mean): means of each ``per_bin`` successive events; what is left at the end is dropped."""
    numbered = events.withColumn("k", F.row_number().over(line()) - 1).withColumn("bin", F.floor(F.col("k") / per_bin))
    return numbered.groupBy("unit", "bin").agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n")).where(F.col("n") == per_bin).drop("n")
