"""Probes: channels, positions and who is near whom."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def edges(probe: DataFrame, radius: float) -> DataFrame:
    """(channel, neighbour) within ``radius`` on one shank, oneself included. Positions are bucketed by the radius and joined on the cell."""
    cell = lambda c, k=0: (F.floor(F.col(c) / radius) + k)
    left = probe.select("grp", "channel", "x", "y", cell("x").alias("cx"), cell("y").alias("cy"))
    right = probe.select("grp", F.col("channel").alias("neighbour"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    around = [F.struct((F.floor(F.col("x2") / radius) + i).alias("cx"), (F.floor(F.col("y2") / radius) + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    right = right.withColumn("c", F.explode(F.array(*around))).select("grp", "neighbour", "x2", "y2", "c.cx", "c.cy")
    near = (F.col("x") - F.col("x2")) ** 2 + (F.col("y") - F.col("y2")) ** 2 <= radius * radius
    return left.join(right, ["grp", "cx", "cy"]).where(near).select("channel", "neighbour")


def dense_ids(channels: DataFrame, by: str = "channel") -> DataFrame:
    """Adds ``idx``: 0, 1, 2, ... in the order of the channel number; a probe has thousands of channels at most."""
    return channels.withColumn("idx", F.row_number().over(Window.orderBy(by)) - 1)


def central(probe: DataFrame) -> DataFrame:
    """(node_i, node_j, channel) for each two nodes of a shank: the electrode nearest to the middle between them, of equally near ones the last."""
    node = lambda name, *more: probe.select("grp", F.col("channel").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in ("x", "y")))
    pairs = node("node_i").join(node("node_j"), "grp").where("node_i < node_j")
    middle = lambda c: (F.col(f"{c}_node_i") + F.col(f"{c}_node_j")) / 2
    d = (F.col("x") - middle("x")) ** 2 + (F.col("y") - middle("y")) ** 2
    near = pairs.join(probe.select("grp", "channel", "x", "y"), "grp").groupBy("node_i", "node_j").agg(F.min(F.struct(d.alias("d"), (-F.col("channel")).alias("last"))).alias("m"))
    return near.select("node_i", "node_j", (-F.col("m.last")).alias("channel"))
