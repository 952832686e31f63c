"""A pipeline over ``documents``: what each stage keeps is written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltmill.llm import copies, mixing, pieces, pii, toxicity
from voltmill.llm.queries import MODEL
from voltmill.llm.shared import materialise, release


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go; all others keep every column.

    A null or empty text has no term and stays, unless labels make texts without terms toxic. Repeated rows go or stay alike. Labels that
    are null or of no document count for nothing; without labels of both kinds nothing goes. No rows give no rows.
    """
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, by five-word shingles with a similarity of 0.8 or more, the document with the least id stays.

    Null and wordless texts are copies of each other. A null id comes last; of rows with equal ids one stays. No rows give no rows.
    """
    return copies.keep_one(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to their kind, and n_chars follows; no document goes.

    A null text stays null, with null n_chars, an empty one empty; repeated rows are treated alike. Of spans that overlap the first one's
    kind is put. No rows give no rows.
    """
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken as often as their source's target asks, some not at all; their columns stay as they are.

    Null sources are one source, the last in order. Texts that are null or without words have no size and follow their source's threshold.
    Rows equal in id and text are taken together. No rows give no rows.
    """
    return mixing.take_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_pieces, ids) of every document taken, each as often as it was.

    A null text has null ids and n_pieces -1, an empty one no pieces. No rows give no rows.
    """
    coded = pieces.encode(docs, pieces.Pieces.read(MODEL), keep=["doc_id", "source"])
    return coded.select("doc_id", "source", F.size("ids").alias("n_pieces"), "ids")


STAGES = [("toxicity", drop_toxic), ("near duplicates", drop_near_duplicates), ("personal data", redact_personal_data), ("mix", mix), ("pieces", encode)]

#: Learned scores and hash thresholds are not SQL; tests/llm/test_queries_whole.py holds what each stage leaves against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs, done = materialise(stage(spark, docs, sf_dir)), docs
        release(done)  # what the stage before has left
    return STAGES[-1][1](spark, docs, sf_dir)
