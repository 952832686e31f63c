"""Sortings as curation tools read and write them: a group for each cluster, events by time and cluster."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_groups(groups: DataFrame, path: str) -> None:
    """(cluster_id, group) as tab-separated text with a header, one row for each unit: a table of a recording's units, in one file."""
    groups.select("cluster_id", "group").orderBy("cluster_id").coalesce(1).write.mode("overwrite").csv(path, sep="\t", header=True)


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, schema="cluster_id long, group string")


def read_sorting(spark: SparkSession, folder: str, chunk: int = 1 << 20) -> DataFrame:
    """(event_id, t, unit, group) of a folder with ``spike_times.npy`` and ``spike_clusters.npy``; units without a group are ``unsorted``.

    Both arrays are mapped in slices of ``chunk`` events, and their integers stay integers.
    """
    import numpy as np
    import pyarrow as pa

    times, units = (os.path.join(folder, f"spike_{n}.npy") for n in ("times", "clusters"))
    n = np.load(times, mmap_mode="r").size

    def run(batches):
        t, u = np.load(times, mmap_mode="r").reshape(-1), np.load(units, mmap_mode="r").reshape(-1)
        for batch in batches:
            for start in batch.column("id").to_pylist():
                at = slice(start, start + chunk)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(start, min(start + chunk, n))), pa.array(t[at].astype(np.int64)), pa.array(u[at].astype(np.int64))], names=["event_id", "t", "unit"])

    events = spark.range(0, n, chunk, max(1, min(-(-n // chunk), 1000))).mapInArrow(run, "event_id long, t long, unit long")
    path = os.path.join(folder, "cluster_group.tsv")
    if not os.path.exists(path):
        return events.withColumn("group", F.lit("unsorted"))
    groups = read_groups(spark, path).withColumnRenamed("cluster_id", "unit")
    return events.join(groups, "unit", "left").select("event_id", "t", "unit", F.coalesce("group", F.lit("unsorted")).alias("group"))


def keep_curated(events: DataFrame) -> DataFrame:
    """Events of units that curation left good or did not look at; those marked noise or mua go."""
    return events.where(F.col("group").isin("good", "unsorted"))


def merges_of_groups(templates: DataFrame, groups: DataFrame) -> DataFrame:
    """(template, unit): templates (template, cluster) of one curated cluster become one unit, numbered anew without gaps by cluster; those
    of clusters marked mua or noise, or that curation does not mention, go. A template that is listed more often belongs where it is last."""
    from pyspark.sql import Window

    last = templates.groupBy("template").agg(F.max_by("cluster", F.coalesce(F.col("row"), F.lit(0)) if "row" in templates.columns else F.col("cluster")).alias("cluster"))
    kept = last.join(groups.where(F.col("group").isin("good", "unsorted")).select(F.col("cluster_id").alias("cluster")).distinct(), "cluster")
    units = kept.select("cluster").distinct().withColumn("unit", (F.row_number().over(Window.orderBy("cluster")) - 1).cast("long"))  # one row for each unit
    return kept.join(units, "cluster").select("template", "unit")


def export(folder: str, spikes: DataFrame, templates, positions, similarity, rate: float) -> None:
    """Writes what a curation tool opens: spike_times, spike_templates, spike_clusters and amplitudes in the order of time, the templates
    (unit, time, channel), their similarities, the channel map and positions, and params.py.

    Arrays of spikes are written part after part from sorted slices, so the driver holds one slice at a time, and the driver's disk the files.
    """
    import numpy as np

    os.makedirs(folder, exist_ok=True)
    put = lambda name, x: np.save(os.path.join(folder, name), x)
    n = spikes.count()
    files = {name: np.lib.format.open_memmap(os.path.join(folder, f"{name}.npy"), "w+", kind, (n,)) for name, kind in (("spike_times", np.int64), ("spike_templates", np.int32), ("spike_clusters", np.int32), ("amplitudes", np.float64))} if n else {}
    for name, kind in (("spike_times", np.int64), ("spike_templates", np.int32), ("spike_clusters", np.int32), ("amplitudes", np.float64)):
        if not n:
            put(f"{name}.npy", np.zeros(0, kind))
    for at, r in enumerate(spikes.select("t", "template", "amp").orderBy("t", "template", "amp").toLocalIterator(prefetchPartitions=True) if n else ()):
        files["spike_times"][at], files["spike_templates"][at], files["spike_clusters"][at], files["amplitudes"][at] = r.t, r.template, r.template, r.amp
    for x in files.values():
        x.flush()
    put("templates.npy", np.asarray(templates, np.float32))
    put("similar_templates.npy", np.asarray(similarity, np.float32))
    put("channel_map.npy", np.arange(len(positions), dtype=np.int32))
    put("channel_positions.npy", np.asarray(positions, np.float64))
    with open(os.path.join(folder, "params.py"), "w") as f:
        f.write(f"dat_path = []\nn_channels_dat = {len(positions)}\nsample_rate = {float(rate)}\nhp_filtered = True\noffset = 0\n")
