"""SimHash near-duplicates by pivot distance tables.

Every different fingerprint gets a table of its Hamming distances to ``PIVOTS`` reference fingerprints. By the triangle inequality
two fingerprints that differ in d bits have tables that differ by d at most in every coordinate, so a pair with a larger
difference anywhere is discarded unseen, and the survivors are verified bit by bit. Which tables meet at all is settled by blocks:
of four blocks of 16 bits at least two are equal in any pair with two differing bits, so pairs meet under one of six keys.

A key whose group has more than ``LARGE`` fingerprints is cut further in the same way: of the 32 bits that the key leaves free, in
eight blocks of four, at least six are equal in any such pair, so its fingerprints meet under 28 finer keys. Those leave eight bits
free, so at most 256 fingerprints meet under one, however the data lie. Every group, cut or not, goes through the pivot tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import materialise

DISTANCE = 2
BLOCKS = 4
PIVOTS = 24
LARGE = 4096
FINE = 8
SEED = 42
_CHUNK = 1 << 16


def fingerprint(text: bytes, width: int = 3) -> int:
    """A bit is 1 if more than half of the shingles' XXH64 have it. Shingles: ``width`` words of the text with A-Z lowered, joined by a space."""
    own = text.lower().split()
    if not own:
        return 0
    line, take = b" ".join(own), max(1, len(own) - width + 1)
    end = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
    start = np.r_[0, end[:-1] + 1][:take].tolist()
    stop = end[min(width, len(own)) - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for a in range(0, take, _CHUNK):
        h = np.array([digest(line[s:e], SEED) for s, e in zip(start[a : a + _CHUNK], stop[a : a + _CHUNK], strict=True)], np.uint64)
        ones += _ones(h)
    return int(np.packbits(2 * ones > take, bitorder="little").view(np.uint64)[0])


def _ones(h: np.ndarray) -> np.ndarray:
    """How many numbers have each bit, by vertical counters: eight bits of a byte at a time, folded every 255 numbers."""
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    whole = len(bits) // 255 * 255
    ones = np.add.reduce(bits[:whole].reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) if whole else 0
    return ones + bits[whole:].sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, text: str = "text", width: int = 3) -> DataFrame:
    """``docs`` with its text replaced by ``fp`` (a signed long). Null and wordless texts have fingerprint 0."""
    keep = [c for c in docs.columns if c not in (text, "fp")]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("fp")
            fp = np.fromiter((fingerprint((x.as_py() or "").encode(), width) for x in column), np.uint64, len(column))
            yield pa.record_batch([*(batch.column(c) for c in keep), pa.array(fp.view(np.int64))], names=[*keep, "fp"])

    return docs.select(*keep, F.col(text).alias("fp")).mapInArrow(run, f"{kinds}{', ' * bool(keep)}fp long")


def references(n: int = PIVOTS) -> np.ndarray:
    """The reference fingerprints: XXH64 of 0, 1, 2, ..."""
    return np.array([xxhash.xxh64_intdigest(str(i).encode(), SEED) for i in range(n)], np.uint64)


def pivot_table(fp: np.ndarray) -> np.ndarray:
    return np.stack([np.bitwise_count(fp ^ p) for p in references()], axis=1).astype(np.int8)


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
        table = pivot_table(fp.view(np.uint64))
        yield pa.record_batch([pa.array(fp), pa.array([x.tobytes() for x in table], pa.binary())], names=["fp", "pivots"])


def close_pairs(fp: np.ndarray, table: np.ndarray, distance: int = DISTANCE, rows: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i < j, of positions that differ in ``distance`` bits at most, a few rows of the pair matrix at a time."""
    order = np.argsort(table[:, 0], kind="stable")
    first = table[order, 0]
    for a in range(0, len(fp), rows):
        b = min(a + rows, len(fp))
        stop = np.searchsorted(first, first[b - 1] + distance, side="right")  # tables are sorted by their first coordinate
        i, j = np.nonzero(first[a:b, None] + distance >= first[None, a:stop])
        i, j = i[i < j] + a, j[i < j] + a
        i, j = order[i], order[j]
        for k in range(1, table.shape[1]):
            if not len(i):
                break
            near = np.abs(table[i, k] - table[j, k]) <= distance
            i, j = i[near], j[near]
        near = np.bitwise_count(fp[i] ^ fp[j]) <= distance
        yield i[near], j[near]


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each group a star to the least member of every part that hangs together, instead of all its pairs."""
    for batch in batches:
        a, b = [], []
        for fps, pivots in zip(batch.column("fps"), batch.column("tables"), strict=True):
            signed = np.array(fps.as_py(), np.int64)
            table = np.frombuffer(b"".join(pivots.as_py()), np.int8).reshape(len(signed), -1)
            label = np.arange(len(signed))
            rank = np.argsort(signed)
            signed, table = signed[rank], table[rank]
            changed = True
            while changed:
                was = label.copy()
                for i, j in close_pairs(signed.view(np.uint64), table):
                    np.minimum.at(label, j, label[i])
                    np.minimum.at(label, i, label[j])
                while (label != label[label]).any():
                    label = label[label]
                changed = (was != label).any()
            own = np.flatnonzero(label != np.arange(len(label)))
            a.append(signed[own])
            b.append(signed[label[own]])
        yield pa.record_batch([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (a, b)], names=["a", "b"])


def _masks() -> tuple[list[int], list[list[int]]]:
    """The bits of each key, and those of each key's finer keys; signed."""
    bits = 64 // BLOCKS
    fine = bits * DISTANCE // FINE
    signed = lambda k: k - (1 << 64) if k >> 63 else k
    coarse, finer = [], []
    for kept in combinations(range(BLOCKS), BLOCKS - DISTANCE):
        key = sum(((1 << bits) - 1) << (bits * k) for k in kept)
        starts = [bits * k + fine * j for k in range(BLOCKS) if k not in kept for j in range(bits // fine)]
        coarse.append(signed(key))
        finer.append([signed(key + sum(((1 << fine) - 1) << s for s in some)) for some in combinations(starts, FINE - DISTANCE)])
    return coarse, finer


def links(fps: DataFrame, large: int = LARGE) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of different ``fp`` within two bits."""
    coarse, finer = _masks()
    keys = lambda masks: F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in masks))
    tables = materialise(fps.mapInArrow(_tables, "fp long, pivots binary"))
    keyed = tables.select("fp", "pivots", F.posexplode(keys(coarse)).alias("k", "key"))
    sizes = keyed.groupBy("k", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = materialise(keyed.join(sizes, ["k", "key"]))
    small = met.where(F.col("n") <= large).select("k", "key", "fp", "pivots")
    cut = F.element_at(F.array(*map(keys, finer)), F.col("k") + 1)
    sub = met.where(F.col("n") > large).select("k", "fp", "pivots", F.posexplode(cut).alias("f", "key")).select((F.col("k") * len(finer[0]) + F.col("f") + len(coarse)).alias("k"), "key", "fp", "pivots")
    groups = small.unionByName(sub).groupBy("k", "key").agg(F.collect_list("fp").alias("fps"), F.collect_list("pivots").alias("tables")).where(F.size("fps") > 1)
    return groups.select("fps", "tables").mapInArrow(_link, "a long, b long")


def _named(prints: DataFrame) -> DataFrame:
    """(fp, root, least) for each different fp of (id, fp): root names the component, least is the fp's smallest id."""
    fps = materialise(prints.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(links(fps.select("fp"))).withColumnRenamed("node", "fp")
    return materialise(fps.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"))


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(id, fp, component_id) for each row: fingerprints link at two differing bits or fewer, and component_id is the least id reachable.

    Rows with equal fingerprints are linked whatever their texts. A null id takes part but is never a component_id unless its
    component has no other. No rows give no rows; columns other than id and text are not read.
    """
    prints = materialise(fingerprints(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), "text", width))
    named = _named(prints)
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(named.join(least, "root").select("fp", "component_id"), "fp").select(F.col("id").alias(id), "fp", "component_id")


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """The row with the least id of each component of ``near_duplicates``, with all its columns.

    Null ids come last. Of rows with that id and the least fingerprint among them one stays, whichever. Rows are named by number, and
    only the numbers of the kept ones are joined back, so a large group's texts stay where they are.
    """
    held = materialise(docs.withColumn("_row", F.monotonically_increasing_id()))
    prints = materialise(fingerprints(held.select("_row", F.col(id).alias("id"), F.col(text).alias("text")), "text", width))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "fp", "_row")).alias("first")
    of_print = materialise(prints.groupBy("fp").agg(first))
    roots = components(links(of_print.select("fp"))).withColumnRenamed("node", "fp")
    kept = of_print.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
    return held.join(kept.select(F.col("first._row").alias("_row")), "_row", "left_semi").select(*docs.columns)
