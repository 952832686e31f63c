"""Robust statistics: medians, absolute deviations and what is subtracted by them.

An exact median needs no sort of all values. A sketch of fixed size brackets the middle ranks of each group; one pass then counts
the values below the bracket and those inside it, about a two-hundredth of the group, and only these are put in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import materialise

#: The sketch's rank error is the reciprocal of this share of a group, and the bracket reaches five times as far on both sides.
ACCURACY = 2_000
#: A group of so few values is its own bracket.
FEW = 4096


def median(df: DataFrame, by: list[str], value: str, out: str = "median") -> DataFrame:
    """(by, out): the exact median of the values that are not null; a group without any gives no row. Null keys form groups."""
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    near = 5.0 / ACCURACY
    ends = F.percentile_approx("_v", [0.5 - near, 0.5 + near], ACCURACY)
    # a shuffle carries each group once from each task, or its values while it is small
    sketch = rows.groupBy(*by).agg(ends.alias("_q"), F.count(F.lit(1)).alias("_all"))
    few = F.col("_all") <= FEW
    sketch = sketch.select(*(F.col(c).alias(f"_by_{c}") for c in by), F.when(~few, F.col("_q")[0]).alias("_low"), F.when(~few, F.col("_q")[1]).alias("_high"), "_all")
    met = rows.join(sketch, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]).where(F.col("_high").isNull() | (F.col("_v") <= F.col("_high")))
    inside = F.when(F.col("_low").isNull() | (F.col("_v") >= F.col("_low")), F.col("_v"))
    counts = met.groupBy(*by, inside.alias("_x")).agg(F.count(F.lit(1)).alias("_n"), F.first("_all").alias("_all"))
    upto = F.sum("_n").over(Window.partitionBy(*by).orderBy(F.col("_x").asc_nulls_first()))
    low, high = F.floor((F.col("_all") - 1) / 2) + 1, F.floor(F.col("_all") / 2) + 1
    holds = lambda k: (F.col("_upto") >= k) & (F.col("_upto") - F.col("_n") < k)
    middle = (F.max(F.when(holds(low), F.col("_x"))) + F.max(F.when(holds(high), F.col("_x")))) / 2
    return counts.withColumn("_upto", upto).groupBy(*by).agg(middle.alias(out))


def weighted_medians(df: DataFrame, by: list[str], value: str, counts: str, out: str = "median") -> DataFrame:
    """(by, k, out): the exact median of the values, each taken ``counts[k]`` times, for every k that has any; null where all these are null.

    Counts are added up for each different value, and in cells of a fixed monotone function of the values. Only the values in the cells of
    the middle ranks are put in order.
    """
    rows = df.select(*by, F.col(value).alias("_v"), F.posexplode(counts).alias("k", "_n")).where("_n > 0")
    cell = F.floor(F.asinh("_v") * 256).alias("_cell")
    held = materialise(rows.groupBy(*by, "k", cell, "_v").agg(F.sum("_n").alias("_n")))
    key = [*by, "k"]
    groups = held.groupBy(*key).agg(F.sum(F.when(F.col("_v").isNotNull(), F.col("_n"))).alias("_all"))
    same = lambda a, b, names: [a[c].eqNullSafe(b[f"_by_{c}"]) for c in names]
    renamed = lambda t, names: t.select(*(F.col(c).alias(f"_by_{c}") for c in names), *(c for c in t.columns if c not in names))
    values = held.where("_v is not null")
    cells = values.groupBy(*key, "_cell").agg(F.sum("_n").alias("_m")).withColumn("_to", F.sum("_m").over(Window.partitionBy(*key).orderBy("_cell")))
    totals = renamed(groups.where("_all is not null"), key)
    low, high = F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1
    met = cells.join(totals, same(cells, totals, key)).where((F.col("_to") >= low) & (F.col("_to") - F.col("_m") < high)).select(*key, "_cell", (F.col("_to") - F.col("_m")).alias("_before"), "_all")
    met = renamed(met, [*key, "_cell"])
    own = values.join(met, same(values, met, [*key, "_cell"])).select(*key, "_cell", "_v", "_n", "_before", "_all")
    upto = own.withColumn("_upto", F.col("_before") + F.sum("_n").over(Window.partitionBy(*key, "_cell").orderBy("_v")))
    holds = lambda r: (F.col("_upto") >= r) & (F.col("_upto") - F.col("_n") < r)
    found = renamed(upto.groupBy(*key).agg(((F.max(F.when(holds(low), F.col("_v"))) + F.max(F.when(holds(high), F.col("_v")))) / 2).alias(out)), key)
    return groups.join(found, same(groups, found, key), "left").select(*key, out)


def mad(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, median, mad): the median of absolute deviations from the group's median, both exact."""
    centre = median(df, by, value)
    off = df.where(F.col(value).isNotNull()).select(*by, value).join(centre, by).select(*by, F.abs(F.col(value) - F.col("median")).alias("_off"))
    return centre.join(median(off, by, "_off", "mad"), by)


def remove_median(df: DataFrame, by: list[str], value: str, out: str = "referenced") -> DataFrame:
    """Adds value minus its group's median: a common reference if the group is a time step, an offset if it is a chunk of a channel."""
    return df.join(median(df, by, value, "_middle"), by, "left").withColumn(out, F.col(value) - F.col("_middle")).drop("_middle")


def chunked_mad(df: DataFrame, by: list[str], chunk: str, value: str) -> DataFrame:
    """(by, mad, chunks): the mean of the MADs of each chunk, as a recording too long for one median is measured."""
    return mad(df, [*by, chunk], value).groupBy(*by).agg(F.avg("mad").alias("mad"), F.count(F.lit(1)).alias("chunks"))
