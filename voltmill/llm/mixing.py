"""Mixing sources to target weights with hash thresholds found from histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, materialise

BITS = 10
LEVELS = 3


def _targets(sources: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """Adds the target of each source. The budget is poured by weight; a source takes ``cap`` times its size at most.

    Sorted by the level at which they fill up, the first sources are full; those after share what is left by weight.
    One row for each source goes to one task.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    rank = sources.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.row_number().over(named) - 1) % len(weights) + 1))
    line = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full_at = cap * F.col("source_size") / F.col("weight")
    level = (F.lit(share) * F.sum("source_size").over(whole) - (F.sum(cap * F.col("source_size")).over(line) - cap * F.col("source_size"))) / (
        F.sum("weight").over(whole) - (F.sum("weight").over(line) - F.col("weight"))
    )
    poured = rank.withColumn("full_at", full_at).withColumn("level", level).withColumn("at", F.row_number().over(line))
    met = F.min_by(F.when(F.col("level") <= F.col("full_at"), F.col("level")), F.when(F.col("level") <= F.col("full_at"), F.col("at"))).over(whole)
    return poured.select("source", "source_size", F.least(F.coalesce(F.col("weight") * met, cap * F.col("source_size")), cap * F.col("source_size")).cast("double").alias("target"))


def _digit(level: int) -> Column:
    return F.shiftrightunsigned("hash", 64 - BITS * (level + 1)).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")


def _boundary(rows: DataFrame, budgets: DataFrame, level: int) -> DataFrame:
    """(source, left, below): the hash prefix at which each source's budget ends, one digit longer, and what is left of the budget there.

    ``rows``: those of the bucket that the digits so far name. A source with at most 2**BITS buckets has a window of as many rows.
    """
    line = Window.partitionBy("source").orderBy("digit")
    sums = rows.groupBy("source", _digit(level).alias("digit")).agg(F.sum("size").alias("cell"))
    summed = sums.withColumn("upto", F.sum("cell").over(line)).alias("s").join(budgets.select("source", "left", "below").alias("b"), F.col("s.source").eqNullSafe(F.col("b.source")))
    inside = F.col("upto") <= F.col("left")
    ends = summed.groupBy(F.col("b.source").alias("source")).agg(
        F.min(F.when(~inside, F.col("digit"))).alias("digit"),
        F.min_by("left", "digit").alias("left"),
        F.min_by("below", "digit").alias("below"),
        F.coalesce(F.max(F.when(inside, F.col("upto"))), F.lit(0)).alias("taken"),
        F.min_by("cell", F.when(~inside, F.col("digit"))).alias("cell"),
    )
    # no bucket is too many: the end lies after them all
    digit = F.coalesce(F.col("digit"), F.lit(1 << BITS))
    return ends.select("source", (F.col("left") - F.col("taken")).alias("left"), (F.col("below") * (1 << BITS) + digit).alias("below"), "cell")


def _sized(docs: DataFrame, id: str, text: str) -> list[Column]:
    return [F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(id, text).alias("hash")]


def _plan(rows: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """One row for each source: plan_source, source_size, target, repeats and the threshold under which a document is taken once more."""
    targets = materialise(_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap))
    repeats = F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))
    ends = targets.select("source", (F.col("target") - repeats * F.col("source_size")).alias("left"), F.lit(0).cast("long").alias("below"))
    inside = rows
    for level in range(LEVELS):
        if level:
            edge = ends.select(F.col("source").alias("edge_source"), F.col("below").alias("edge"))
            inside = rows.join(edge, F.col("source").eqNullSafe(F.col("edge_source")) & (F.shiftrightunsigned("hash", 64 - BITS * level) == F.col("edge"))).select("source", "size", "hash")
        found = _boundary(inside, ends, level)
        # a source whose budget ended exactly between buckets has no rows here: its prefix only gets longer
        kept = ends.select(F.col("source").alias("own"), F.col("left").alias("own_left"), F.col("below").alias("own_below"))
        ends = materialise(
            kept.join(found, F.col("own").eqNullSafe(F.col("source")) & F.col("below").isNotNull(), "left").select(
                F.col("own").alias("source"), F.coalesce("left", "own_left").alias("left"), F.coalesce("below", F.col("own_below") * (1 << BITS)).alias("below"), F.coalesce("cell", F.lit(0)).alias("cell")
            )
        )
    last = F.col("below") + F.when((F.col("cell") > 0) & (F.col("left") * 2 >= F.col("cell")), 1).otherwise(0)
    joined = targets.alias("t").join(ends.alias("e"), F.col("t.source").eqNullSafe(F.col("e.source")))
    return materialise(joined.select(F.col("t.source").alias("plan_source"), "source_size", "target", repeats.alias("repeats"), last.alias("threshold")))


def _times(cap: float) -> Column:
    once_more = (F.shiftrightunsigned("hash", 64 - BITS * LEVELS) < F.col("threshold")) & (F.col("repeats") < cap)
    return F.col("repeats") + once_more.cast("int")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(id, source, size, source_size, target, taken) for each row. Column functions only.

    size: the words of the text, none if it is null. Sources in the order of their code points, null last, weigh ``weights`` by
    turns and share ``share`` times all words; no target exceeds ``cap`` times its source. A source takes each text as often as
    its target holds the whole source, and once more those whose hash lies under a threshold. taken: words, repeats counted.

    The hash is one of id and text, so a document stays in every larger mix, and reruns agree. Rows alike in both are taken
    together. The threshold comes from sums by source and leading hash bits; of its boundary bucket alone the next bits are
    summed, ``LEVELS`` times. The last bucket, of 2**-30 of the hashes, is taken if that comes nearer the target. No text is
    sorted or shuffled. Empty sources have target 0; no rows give no rows.
    """
    rows = materialise(docs.select(F.col(id).alias("id"), F.col(source).alias("source"), *_sized(docs, id, text)))
    plan = _plan(rows, weights, share, cap)
    return rows.join(plan, F.col("source").eqNullSafe(F.col("plan_source"))).select(F.col("id").alias(id), F.col("source").alias(source), "size", "source_size", "target", (F.col("size") * _times(cap)).cast("long").alias("taken"))


def take_mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it does, with the columns they had.

    The thresholds go to the rows, by a join with one row for each source; the texts stay where they are if that fits a broadcast.
    """
    rows = materialise(docs.select(F.col(source).alias("source"), *_sized(docs, id, text)))
    plan = _plan(rows, weights, share, cap).withColumnsRenamed({c: f"_mix_{c}" for c in ("plan_source", "source_size", "target", "repeats", "threshold")})
    renamed = {"hash": F.xxhash64(id, text)}
    more = (F.shiftrightunsigned(renamed["hash"], 64 - BITS * LEVELS) < F.col("_mix_threshold")) & (F.col("_mix_repeats") < cap)
    times = (F.col("_mix_repeats") + more.cast("int")).cast("int")
    joined = docs.join(plan, F.col(source).eqNullSafe(F.col("_mix_plan_source")))
    return joined.where(times > 0).withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), times))).select(*docs.columns)
