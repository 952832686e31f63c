"""Tables that are written on the way."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from voltmill.llm import components
from voltmill.llm.shared import materialise, release


def files(step):
    return Path(step.__dict__["_step_path"].removeprefix("file:")).resolve()


def test_a_local_step_is_written_without_side_files(spark):
    """Each of these is a fork of the executor's JVM, and two more for the file that it belongs to."""
    step = materialise(spark.range(1000, numPartitions=3))
    assert len(list(files(step).glob("part-*"))) == 3 and not list(files(step).glob(".*.crc"))
    assert step.agg(F.sum("id")).first()[0] == 499500
    at = files(step)
    release(step)
    assert not at.exists()


def test_a_changed_byte_of_a_step_is_an_error(spark):
    step = materialise(spark.range(50000, numPartitions=1).select(F.xxhash64("id").alias("value")))
    (file,) = files(step).glob("part-*")
    data = bytearray(file.read_bytes())
    data[len(data) // 2] ^= 1
    file.write_bytes(data)
    with pytest.raises(Exception, match="(?i)checksum|crc"):
        step.agg(F.sum(F.col("value") % 1000)).collect()


def test_a_round_of_components_writes_few_files(spark, monkeypatch):
    """However many shuffle partitions there are for the texts, an eighth of them is enough for edges."""
    written = []
    monkeypatch.setattr(components, "materialise", lambda df: written.append(step := materialise(df)) or written_files.append(len(list(files(step).glob("part-*")))) or step)
    written_files = []
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        edges = spark.range(600).where("id % 3 > 0").select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
        found = components.components(edges).collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert sorted((x.node, x.root) for x in found) == [(k, k // 3 * 3) for k in range(600)]
    assert written_files and max(written_files) <= 4
