"""Approximate nearest neighbours by adaptive dimension scan within probed lists.

Vectors are made unit length, turned by one random rotation and put into lists by their nearest centroid. After the rotation every
block of columns is a random sample of a vector's directions, so the distance over the first m of d columns tells the whole one
within a factor that a hypothesis test bounds: a candidate is abandoned as soon as its partial distance, scaled by d / m, exceeds
the query's limit by more than ``1 + EPSILON / sqrt(m)``. The limit is the k-th best distance known: from a bounded sample, whose
best are candidates like any other, before a list is read; then from the block of the list at hand. What is left is scored exactly, on the original vectors.

Centroids are fitted on ``SAMPLE`` vectors at most, those with the least hash of their id; every vector is put into a list. Lists
are dealt to groups of about ``BLOCK`` vectors, larger ones cut into blocks, and a query goes to a group once, with the numbers of
the lists it probes there; a task reads one block against about ``BLOCK`` queries, however many there are. Of equal vectors
the k + 1 with the least ids are searched, as no more of them can be among k results, and equal queries are asked once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise, partitions, release

SAMPLE = 16384
LISTS = 1024
#: Share of all lists that a query probes.
PROBED = 0.65
EPSILON = 2.1
#: Vectors of the sample that give each query its first limit.
SEEDS = 2048
BLOCK = 4096
COLUMNS = 16
SEED = 42


def usable(vector: str) -> Column:
    """Not null or empty, all components finite, not all zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


def _array(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype(np.float32)


def rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((d, d)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def centroids(sample: np.ndarray, lists: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means; starts from evenly spaced rows, and a list that loses all its rows keeps its centre."""
    at = sample[np.linspace(0, len(sample) - 1, lists).astype(int)].copy()
    for _ in range(rounds):
        own = (sample @ at.T).argmax(axis=1)
        sums = np.zeros_like(at)
        np.add.at(sums, own, sample)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        at = np.where(size > 1e-6, sums / np.maximum(size, 1e-6), at)
    return at


def scan(q: np.ndarray, x: np.ndarray, limit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, vector) that no test abandoned. q, x: rotated unit vectors; limit: squared distance of each query's k-th best so far."""
    d = q.shape[1]
    m = min(COLUMNS, d)
    part = (q[:, :m] ** 2).sum(1)[:, None] + (x[:, :m] ** 2).sum(1)[None] - 2 * q[:, :m] @ x[:, :m].T
    if len(x) >= k:
        # the whole distances of the best by the first block bound the k-th best from above
        first = np.argpartition(part, k - 1, axis=1)[:, :k]
        whole = ((q[:, None, :] - x[first]) ** 2).sum(2).max(1)
        limit = np.minimum(limit, whole)
    limit = limit * (1 + 1e-5) + 1e-6
    i, j = np.nonzero(part * (d / m) <= (limit * (1 + EPSILON / np.sqrt(m)) ** 2)[:, None])
    part = part[i, j]
    while m < d and len(i):
        n = min(m + COLUMNS, d)
        part = part + ((q[i, m:n] - x[j, m:n]) ** 2).sum(1)
        m = n
        slack = 1 if m == d else d / m
        near = part * slack <= limit[i] * (1 if m == d else (1 + EPSILON / np.sqrt(m)) ** 2)
        i, j, part = i[near], j[near], part[near]
    return i, j


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row in double precision; equal rows give equal results wherever they stand."""
    norm = lambda x: np.sqrt((x * x).sum(axis=1))
    return (a * b).sum(axis=1) / (norm(a) * norm(b))


def _best(k: int):
    turn: dict[int, np.ndarray] = {}

    def best(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = ([], [], [])
        if len(left) and len(right):
            x, ids, own = _array(left.column("vec").combine_chunks()), left.column("id").to_numpy(), left.column("list").to_numpy()
            q, qids = _array(right.column("vec").combine_chunks()), right.column("qid").to_numpy()
            if x.shape[1] not in turn:
                turn[x.shape[1]] = rotation(x.shape[1])
            r = turn[x.shape[1]]
            ux, uq = _unit(x) @ r, _unit(q) @ r
            limit = right.column("limit").to_numpy().astype(np.float32)
            probed = right.column("lists").combine_chunks()
            of, listed = np.repeat(np.arange(len(q)), probed.value_lengths().to_numpy()), probed.flatten().to_numpy()
            for each in np.unique(own):
                at, asking = np.flatnonzero(own == each), of[listed == each]
                for a in range(0, len(asking), 64):
                    some = asking[a : a + 64]
                    i, j = scan(uq[some], ux[at], limit[some], k)
                    i, j = some[i], at[j]
                    score = cosine(q[i], x[j])
                    order = np.lexsort((ids[j], -score, i))
                    i, j, score = i[order], j[order], score[order]
                    first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, int)
                    top = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)])) < k
                    for o, v in zip(out, (qids[i[top]], ids[j[top]], score[top]), strict=True):
                        o.append(v)
        return pa.table({n: pa.array(np.concatenate(o) if o else np.zeros(0), t) for n, o, t in zip(("qid", "id", "score"), out, (pa.int64(), pa.int64(), pa.float64()), strict=True)})

    return best


def _assign(shared, probes: int | None, k: int, groups: int):
    """Vectors to their nearest list; with ``probes``, queries to the groups of their nearest lists, with the limit that the sample gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sample = shared.value[:2]
        for batch in batches:
            for begin in range(0, len(batch), 1024):
                part = batch.slice(begin, 1024)
                u = _unit(_array(part.column("vec")))
                near = u @ at.T
                if probes is None:
                    yield pa.record_batch([pa.array(near.argmax(1).astype(np.int32)), part.column("id"), part.column("vec")], names=["list", "id", "vec"])
                    continue
                lists = np.argpartition(-near, probes - 1, axis=1)[:, :probes].astype(np.int32)
                # one more than k, as the query itself may be in the sample
                kth = np.partition(-(u @ sample.T), k, axis=1)[:, k] if len(sample) > k else np.full(len(u), 1.0)
                lists = np.sort(lists, axis=1)
                group = lists % groups
                order = np.lexsort((lists.ravel(), group.ravel(), np.repeat(np.arange(len(u)), probes)))
                rows, group, lists = np.repeat(np.arange(len(u)), probes)[order], group.ravel()[order], lists.ravel()[order]
                first = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (group[1:] != group[:-1])])
                packed = pa.ListArray.from_arrays(pa.array(np.r_[first, len(rows)].astype(np.int32)), pa.array(lists.astype(np.int32)))
                sent = pa.array(rows[first])
                yield pa.record_batch([pa.array(group[first].astype(np.int32)), packed, part.column("qid").take(sent), pa.array((2 + 2 * kth.astype(np.float64))[rows[first]]), part.column("vec").take(sent)], names=["group", "lists", "qid", "limit", "vec"])

    return run


def _seed(shared, k: int):
    """Each query's best of the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, sample, whole, ids = shared.value
        top = min(k, len(sample))
        for batch in batches:
            for begin in range(0, len(batch), 1024):
                part = batch.slice(begin, 1024)
                q = _array(part.column("vec"))
                j = np.argpartition(-(_unit(q) @ sample.T), top - 1, axis=1)[:, :top].ravel()
                i = np.repeat(np.arange(len(q)), top)
                yield pa.record_batch([part.column("qid").take(pa.array(i)), pa.array(ids[j]), pa.array(cosine(q[i], whole[j]))], names=["qid", "id", "score"])

    return run


def nearest(vectors: DataFrame, queries: Column, k: int = 5, id: str = "vec_id", vector: str = "embedding", probed: float = PROBED) -> DataFrame:
    """(query_id, rank, id, score): for each row that ``queries`` picks the k nearest others found, by cosine, ties to the smaller id.

    Ids are whole numbers and name one row each; a row with a null id, or a vector that is not ``usable``, takes no part. Vectors of
    different lengths have no cosine, so each length is searched by itself. Fewer candidates than k give fewer rows, no vectors none.
    Other columns are not read.
    """
    spark = vectors.sparkSession
    clean = vectors.where(usable(vector) & F.col(id).isNotNull()).select(F.col(id).cast("long").alias("id"), F.col(vector).alias("vec"), F.coalesce(queries, F.lit(False)).alias("asked"))
    clean = materialise(clean)
    found = spark.createDataFrame([], f"query_id long, rank int, `{id}` long, score double")
    for r in clean.groupBy(F.size("vec").alias("d")).count().orderBy("d").collect():  # one row for each length in use
        found = found.unionByName(_nearest(clean.where(F.size("vec") == r.d), r["count"], k, id, probed))
    return found


def _nearest(clean: DataFrame, n: int, k: int, id: str, probed: float) -> DataFrame:
    """``nearest`` among the n vectors (id, vec, asked) of one length."""
    spark = clean.sparkSession
    copies = Window.partitionBy("vec").orderBy("id")
    base = materialise(clean.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).select("id", "vec"))
    asked = clean.where("asked")
    pool = base.where(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < max(1, int(min(1.0, 2 * SAMPLE / n) * (1 << 40)))) if n > 2 * SAMPLE else base
    drawn = pool.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    whole = np.array([r.vec for r in drawn], np.float64)
    sample, few = _unit(whole), SEEDS
    lists = int(max(1, min(LISTS, len(sample) // 16, n**0.5)))
    probes = max(1, min(lists, round(probed * lists)))
    shared = spark.sparkContext.broadcast((centroids(sample, lists), sample[:few], whole[:few], np.array([r.id for r in drawn[:few]], np.int64)))
    kind = base.schema["vec"].dataType.simpleString()
    # as many groups as blocks, or as tasks that may run while there are lists enough
    groups = int(max(1, min(lists, max(-(-n // BLOCK), partitions(spark)))))
    placed = materialise(base.mapInArrow(_assign(shared, None, k, groups), f"list int, id long, vec {kind}").withColumn("group", F.col("list") % groups))
    singles = materialise(asked.groupBy("vec").agg(F.min("id").alias("qid")).select("qid", "vec"))
    probing = materialise(singles.mapInArrow(_assign(shared, probes, k + 1, groups), f"group int, lists array<int>, qid long, limit double, vec {kind}"))
    count = lambda df, name: df.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
    grid = F.broadcast(count(placed, "blocks").join(F.broadcast(count(probing, "rounds")), "group"))  # LISTS rows at most
    left = placed.join(grid, "group").select("group", F.pmod(F.xxhash64("id"), "blocks").alias("block"), F.explode(F.sequence(F.lit(0), F.col("rounds") - 1)).alias("round"), "list", "id", "vec")
    right = probing.join(grid, "group").select("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).alias("block"), F.pmod(F.xxhash64("qid"), "rounds").cast("int").alias("round"), "lists", "qid", "limit", "vec")
    keys = ("group", "block", "round")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_best(k + 1), "qid long, id long, score double")
    found = found.unionByName(singles.mapInArrow(_seed(shared, k + 1), "qid long, id long, score double")).groupBy("qid", "id").agg(F.max("score").alias("score"))
    line = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    top = materialise(found.withColumn("at", F.row_number().over(line)).where(F.col("at") <= k + 1))
    release(base, placed, probing)
    names = asked.select(F.col("id").alias("query_id"), "vec").join(singles, "vec").select("query_id", "qid")
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = names.join(top, "qid").where("id <> query_id").withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id), "score")
