"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise, partitions, release

FEWER = 8


def _towards_least(pairs: DataFrame) -> DataFrame:
    """Adds to each pair (a, b) the least of a and all its partners. The minimum is combined before the shuffle; the join back may be split where one a has very many partners."""
    least = pairs.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
    return pairs.join(least, "a")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the least node that can be reached.

    Loops and repeated edges change nothing; an edge with a null end is left out. No edges give no rows.
    Each round is written to the shared folder, and their number grows with the logarithm of the longest path. Edges are small
    beside the texts that the partitions are made for, so a file holds ``FEWER`` of them.
    """
    files = max(1, partitions(edges.sparkSession) // FEWER)
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().coalesce(files))
    before = None
    while (state := now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()) != before:
        before = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _towards_least(both).where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        joined = _towards_least(down)
        small = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(joined.select("a", F.col("least").alias("b")))
        now, done = materialise(small.where("a <> b").distinct().coalesce(files)), now
        release(done)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
