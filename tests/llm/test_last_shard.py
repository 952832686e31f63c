from pyspark.sql import functions as F

from voltmill.llm import sharding


def test_a_short_last_row_after_very_many_bytes_is_in_the_last_shard(spark):
    docs = spark.range(4).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 1, F.expr("repeat('x', 20000000)")).when(F.col("id") == 3, "").otherwise("y").alias("text"))
    for shards in (1, 2):
        got = {r.doc_id: r.shard for r in sharding.shard_by_bytes(docs, shards).collect()}
        assert got[0] == 0 and got[3] == shards - 1 and set(got.values()) <= set(range(shards))
