"""Contiguous shards of nearly equal size from prefix sums of per-partition totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise, partitions

#: Bytes that a row takes besides its text.
ROW_BYTES = 8


def shard_by_bytes(docs: DataFrame, shards: int = 24, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot) for each row: shards are contiguous in the order of id and nearly equal in bytes.

    size: UTF-8 bytes of the text plus ``ROW_BYTES``. A row goes to the shard in which the middle of its bytes lies, so no shard
    differs from an equal part by more than its outermost rows. slot counts from 0 in each shard. Order: id (null first), then
    CRC-32, then size; rows equal in all three take their slots in any order. A null text has no bytes and CRC-32 0. No rows
    give no rows; where one text is longer than a shard's part, the shards that it covers alone stay empty.

    Rows are dealt by range of id, ties by a row number, so no partition outgrows the others. Only one row for each partition and
    one for each shard is broadcast. Texts are read twice, for the bounds of the ranges and for the sizes, and not shuffled.
    """
    line = Window.orderBy("part")
    within = Window.partitionBy("part").orderBy("id", "text_crc32", "size", "tie")
    rows = docs.select(
        F.col(id).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("tie"),
    )
    ranged = rows.repartitionByRange(partitions(docs.sparkSession), "id", "text_crc32", "size", "tie")
    # written once: range bounds are drawn anew each time a plan runs
    held = materialise(ranged.withColumn("part", F.spark_partition_id()))
    totals = held.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    before = totals.select(
        "part",
        (F.sum("bytes").over(line) - F.col("bytes")).alias("bytes_before"),
        (F.sum("rows").over(line) - F.col("rows")).alias("rows_before"),
        F.sum("bytes").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all_bytes"),
    )
    placed = held.select("*", (F.sum("size").over(within) - F.col("size")).alias("own_bytes"), (F.row_number().over(within) - 1).alias("own_rows")).join(F.broadcast(before), "part")
    middle = 2 * (F.col("bytes_before") + F.col("own_bytes")) + F.col("size")
    cut = materialise(
        placed.withColumn("_middle", middle.cast("decimal(38,0)")).select(
            "id", "size", "text_crc32",
            # div is whole; a decimal quotient has six places, and rounding takes a short last row past the last shard
            F.expr(f"cast(_middle * {shards} div (2 * all_bytes) as int)").alias("shard"),
            (F.col("rows_before") + F.col("own_rows")).alias("row"),
        )
    )
    first = cut.groupBy("shard").agg(F.min("row").alias("first"))
    return cut.join(F.broadcast(first), "shard").select(F.col("id").alias(id), "size", "text_crc32", "shard", (F.col("row") - F.col("first")).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 24, id: str = "doc_id", text: str = "text") -> None:
    """Writes every row into one folder for each shard, each sorted by slot within its files, without the columns shard and slot it may have.

    Rows are matched by id, size and checksum; rows equal in these take their places one by one, so as many go into each shard as it has
    slots for them.
    """
    same = [F.col(id).alias("_id"), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("_crc"), (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("_size")]
    keys = ["_id", "_crc", "_size"]
    place = shard_by_bytes(docs, shards, id, text).select(F.col(id).alias("_id"), F.col("text_crc32").alias("_crc"), F.col("size").alias("_size"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    place = place.withColumn("_copy", F.row_number().over(Window.partitionBy(*keys).orderBy("_shard", "_slot")))
    keyed = docs.drop("shard", "slot").select("*", *same).withColumn("_copy", F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0))))
    p, k = place.alias("p"), keyed.alias("k")
    on = F.col("k._copy") == F.col("p._copy")
    for c in keys:
        on = on & F.col(f"k.{c}").eqNullSafe(F.col(f"p.{c}"))
    kept = [F.col(f"k.{c}") for c in docs.columns if c not in ("shard", "slot")]
    joined = k.join(p, on).select(*kept, F.col("p._shard").alias("shard"), F.col("p._slot").alias("slot"))
    joined.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
