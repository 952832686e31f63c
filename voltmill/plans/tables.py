"""The driver's tables seen as a recording."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.raw import SCHEMA

MINUTE = 60_000_000
HOUR = 60 * MINUTE
DAY = 24 * HOUR

#: The events of a DuckDB query: unit, channel, time in microseconds and amplitude.
EV = "(SELECT event_id, user_id AS unit, event_type AS channel, epoch_us(ts) AS t, value AS amp FROM events)"
SIGNAL = "(SELECT l_suppkey AS channel, l_orderkey AS t, l_linenumber AS k, l_extendedprice AS v FROM lineitem)"
PROBE = "(SELECT n_nationkey AS channel, n_regionkey AS grp, (n_nationkey % 5)::DOUBLE AS x, (n_nationkey // 5)::DOUBLE AS y FROM nation)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times do not pass through the session's time zone."""
    t = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("unit"), F.col("event_type").alias("channel"), t.alias("t"), F.col("value").alias("amp"))


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("channel"), F.col("l_orderkey").alias("t"), F.col("l_linenumber").alias("k"), F.col("l_extendedprice").alias("v"))


def probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(n.alias("channel"), F.col("n_regionkey").alias("grp"), (n % 5).cast("double").alias("x"), F.floor(n / 5).cast("double").alias("y"))


def waveforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label and embedding: eight electrodes of eight steps."""
    return table(spark, sf_dir, "embeddings")


WAVES, HALO, STEPS, ELECTRODES = 64, 8, 8, 8


def recording(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The waveforms one after another as a recording of eight channels: chunks of ``WAVES`` waveforms with ``HALO`` more on both sides."""
    w = waveforms(spark, sf_dir).select("vec_id", "embedding")
    chunk = F.explode(F.sequence(F.greatest(F.floor((F.col("vec_id") - HALO) / WAVES), F.lit(0)), F.floor((F.col("vec_id") + HALO) / WAVES)))
    grouped = w.withColumn("chunk_id", chunk).groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("waves"))

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for c, waves in zip(batch.column("chunk_id").to_pylist(), batch.column("waves").to_pylist(), strict=True):
                x = np.array([w["embedding"] for w in waves], np.float32).reshape(-1, ELECTRODES, STEPS).transpose(0, 2, 1).reshape(-1, ELECTRODES)
                number = np.array([w["vec_id"] for w in waves])
                own = (number // WAVES == c).sum()
                if own:  # a halo alone is no chunk
                    rows.append((c, c * WAVES * STEPS, int(own) * STEPS, int((number // WAVES < c).sum()) * STEPS, ELECTRODES, np.ascontiguousarray(x).tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["chunk_id", "t_start", "n", "before", "channels", "samples"])

    return grouped.mapInArrow(lay, SCHEMA)
