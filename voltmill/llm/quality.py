"""Quality rules: a hashed n-gram log-likelihood ratio between trusted documents and the raw corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .sums import table_sum
from .tokens import Words, mix, slices, words

#: Hash buckets of the word and word-pair features together.
BUCKETS = 1 << 17
#: Words and pairs added to the trusted ones, dealt like the raw corpus.
PRIOR = float(1 << 17)
#: Mean log ratio from which a document is kept.
THRESHOLD = -0.15
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True  # fixed values: the symbols that are counted
_BEGINS = np.ones(256, bool)
_BEGINS[0x80:0xC0] = False
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every word and every pair of adjoining words. A-Z is lowered."""
    h, row = w.hashes(lower=True), w.row
    at, pair = w.windows(h, 2)
    return np.concatenate([row, row[at]]), (np.concatenate([h, pair]) % np.uint64(BUCKETS)).astype(np.int64)


def _repeat_words(w: Words) -> np.ndarray:
    """Words of each row in windows of three words that come twice or more in the row."""
    row = w.row
    at, h = w.windows(w.hashes(), 3)
    h = h ^ mix(row[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    mark = np.zeros(len(row) + 3, np.int8)
    for p in (at[order[1:][same]], at[order[:-1][same]]):
        for k in range(3):
            mark[p + k] = 1
    return np.bincount(row, mark[: len(row)], len(w.first) - 1).astype(np.int64)


def _dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def measures(part: pa.Array, w: Words) -> list[np.ndarray]:
    dup = np.fromiter((_dup_lines((x.as_py() or "").encode()) for x in part), np.int64, len(part))
    return [w.counts, w.count(_BEGINS), w.count(_SYMBOLS), dup, _repeat_words(w)]


def _count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
    table = np.zeros(BUCKETS)
    for batch in batches:
        for _, part in slices(batch.column("text")):
            table += np.bincount(features(words(part))[1], minlength=BUCKETS)
    return table


def _may_be_in(ids: DataFrame) -> Column:
    """A test of the string ``_id`` that all of ``ids`` pass and few others. Only a hash of the id goes to Python."""
    keys = ids.select(F.xxhash64("_id").alias("key"))
    shared = ids.sparkSession.sparkContext.broadcast(bloom.build(keys, ids.count()))

    @F.pandas_udf("boolean")
    def test(key: pd.Series) -> pd.Series:
        return pd.Series(bloom.test(shared.value, key.to_numpy(np.int64).view(np.uint64)))

    return test(F.xxhash64("_id"))


def log_ratios(docs: DataFrame, trusted: DataFrame, id: str = "doc_id", text: str = "text") -> np.ndarray:
    """For each bucket the log of its share in trusted documents over its share in all. Both counts cover every document.

    ``trusted``: ids of the trusted documents; nulls and repeats in it change nothing. Without any trusted document the ratios are 0.
    """
    ids = trusted.select(F.col(trusted.columns[0]).cast("string").alias("_id")).where("_id is not null").distinct()
    raw = table_sum(docs.select(F.col(text).alias("text")), BUCKETS, _count)
    named = docs.select(F.col(id).cast("string").alias("_id"), F.col(text).alias("text")).where("_id is not null")
    # only texts whose id may be trusted are moved to where it is known
    found = named.where(_may_be_in(ids)).join(ids.hint("merge"), "_id", "left_semi")  # one plan at every size
    target = table_sum(found.select("text"), BUCKETS, _count)
    if not target.sum():
        return np.zeros(BUCKETS)
    share = (raw + 0.5) / (raw + 0.5).sum()
    return np.log((target + PRIOR * share) / (target.sum() + PRIOR)) - np.log(share)


def judge(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, measures, score, base_failed, kept) for each row. score: mean log ratio of the text's words and word pairs, 0 if it has none.

    A document is kept if its base rules hold and its score is ``threshold`` or more. Null texts have no words and fail the base
    rules as empty ones do; repeated rows are judged alike. Columns other than id and text are not read.
    """
    context = docs.sparkSession.sparkContext
    ratios = context.broadcast(log_ratios(docs, trusted, id, text).astype(np.float64))  # BUCKETS doubles, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list[np.ndarray]] = [[] for _ in range(6)]
            for _, part in slices(batch.column("text")):
                w = words(part)
                row, bucket = features(w)
                total = np.bincount(row, ratios.value[bucket], len(part)) / np.maximum(np.bincount(row, minlength=len(part)), 1)
                for out, x in zip(found, (*measures(part, w), total), strict=True):
                    out.append(x)
            if found[0]:
                yield pa.record_batch([batch.column("id"), *(pa.array(np.concatenate(x)) for x in found)], names=["id", *MEASURES, "score"])

    kind = docs.select(id).schema[0].dataType.simpleString()
    scored = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, {', '.join(f'{m} long' for m in MEASURES)}, score double")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return scored.withColumnRenamed("id", id).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
