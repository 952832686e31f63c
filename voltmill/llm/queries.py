"""The queries of this subpackage: each applies one operator to its whole table and shapes the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, lm, mixing, pieces, pii, quality, sharding, simhash, substring, toxicity

#: A SentencePiece model file that the driver can open.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op2_difference_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = substring.stripped_texts(docs).select("k1", "k2", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
    return docs.select("doc_id", *substring.text_key()).join(found, ["k1", "k2"]).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(_table(spark, sf_dir, "documents"))


def op4_levenshtein_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_viterbi_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.encode(_table(spark, sf_dir, "documents"), pieces.Pieces.read(MODEL), keep=["doc_id"], exact="round_trip")
    return coded.select("doc_id", F.size("ids").alias("n_pieces"), "ids", "round_trip")


def op7_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = sharding.shard_by_bytes(_table(spark, sf_dir, "documents"), shards=24)
    return cut.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_hash_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_target_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality.judge(_table(spark, sf_dir, "documents"), trusted)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = lambda kinds: F.concat_ws(",", F.transform(F.filter("spans", lambda s: s["kind"].isin(*kinds)), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == F.lit(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.BASE), F.sha2(text(pii.BASE), 256).alias("base_sha256"), text(list(pii.KINDS)).alias("spans"))


QUERIES = {f.__name__: f for f in (op1_adaptive_scan, op2_difference_cover, op3_maxent_lm, op4_levenshtein_toxicity, op5_simhash_pivots, op6_viterbi_pieces, op7_byte_shards, op8_hash_mix, op9_target_ratio, op10_pii)}
