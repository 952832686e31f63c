"""Near copies by exact similarity of word shingles.

Two documents are near copies if their sets of shingles have a Jaccard similarity of ``SIMILAR`` or more. Candidates come from
prefixes: with the shingles of every document in one order, a pair that similar has ``k`` shingles or more in common among the first
``size - ceil(size * SIMILAR) + k`` of each, whatever k. So documents meet under the shingles of their prefixes, a pair needs the
lesser k of the two (``shared``), and none is missed. The order puts shingles last that fall into crowded counters of a table of fixed size; any order gives the same result, this one keeps
common passages out of the prefixes. Each candidate is verified on the whole sets.

Documents of equal sets are one node. Nodes are first linked by the SimHash pivot tables of ``simhash``, and these links verified. Then
nodes that meet and are not connected yet are held against the least of each meeting. What this leaves unconnected is compared
inside a key, by signatures that travel with the nodes: small sets exactly, of larger ones the nodes that may be similar make a star.
What the stars connect is a group, to which each set goes once and is compared exactly. So rows grow with the nodes that meet and
not with their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .components import components
from .shared import materialise, partitions, release
from .sums import table_sum
from .tokens import mix, slices, window_hashes, words

WIDTH = 5
SIMILAR = (4, 5)  # a similarity of 0.8, in whole numbers
COUNTERS = 1 << 20
LEAST_BITS = 512  # of a parity bitmap
SMALL = 128  # shingles of a set that is sent whole
PAIRS = 1 << 16  # that a task holds before it sends them
BLOCK = 1 << 10  # nodes of a group that are compared in one task, and
BLOCK_BYTES = 1 << 24  # of their sets
_SHIFT = np.uint64(44)
_MET = "key long, node long, size int, hub long, hub_size int"


def shared(size):
    """How many shingles of its prefix a set has in common with any that is similar enough."""
    return size // 20 + 1


def shingles(part: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the different shingles of each row, in order of both: ``width`` words, A-Z lowered, or all words of a shorter text."""
    w = words(part)
    h, n = w.hashes(lower=True), w.counts
    at, value = w.windows(h, width)
    row = np.searchsorted(w.first, at, side="right") - 1
    values, rows = [value], [row]
    for k in range(1, width):
        short = np.flatnonzero(n == k)
        values.append(window_hashes(h, w.first[short], k))
        rows.append(short)
    value, row = np.concatenate(values), np.concatenate(rows)
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.r_[True, (value[1:] != value[:-1]) | (row[1:] != row[:-1])][: len(value)]
    return value[new], row[new]


def _nodes(value: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each row's set; 0 for an empty one."""
    first = np.searchsorted(row, np.arange(n + 1))
    sums = np.r_[np.uint64(0), np.cumsum(mix(value), dtype=np.uint64)]
    return mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(np.uint64)).view(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
    table = np.zeros(COUNTERS)
    for batch in batches:
        for _, part in slices(batch.column("text")):
            table += np.bincount((shingles(part)[0] >> _SHIFT).astype(np.int64), minlength=COUNTERS)
    return table


def _order(table: np.ndarray) -> np.ndarray:
    """By how much a counter stands out from the mean of all, in powers of two; 0 where that may be chance."""
    mean = table.mean()
    over = table - mean - 8 * np.sqrt(mean) - 8
    return np.where(over > 0, np.log2(np.maximum(over, 1)) + 1, 0).astype(np.int8)


def _prefixes(order):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, (num, den) = order.value, SIMILAR
        for batch in batches:
            for begin, part in slices(batch.column("text")):
                value, row = shingles(part)
                if not len(value):
                    continue
                node = batch.column("node").slice(begin, len(part)).to_numpy(zero_copy_only=False)
                put = np.lexsort((value, rank[(value >> _SHIFT).astype(np.int64)], row))
                value = value[put]
                first = np.searchsorted(row, np.arange(len(part) + 1))
                size, at = np.diff(first)[row], np.arange(len(row)) - first[row]
                own = at < size + (-num * size // den) + shared(size)
                yield pa.record_batch([pa.array(value[own].view(np.int64)), pa.array(node[row[own]]), pa.array(size[own].astype(np.int32))], names=["key", "node", "size"])

    return run


def _columns(batches: Iterator[pa.RecordBatch], names: list[str]) -> list[np.ndarray]:
    found = list(batches)
    return [np.concatenate([np.zeros(0, np.int64), *(b.column(c).to_numpy(zero_copy_only=False) for b in found)]) for c in names]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The prefix rows, each node once, whose key has another node, with the least node there. All rows of a key are in one task."""
    key, node, size = _columns(batches, ["key", "node", "size"])
    order = np.lexsort((node, key))
    key, node, size = key[order], node[order], size[order]
    new = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])][: len(key)]
    key, node, size = key[new], node[new], size[new]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    n = np.diff(np.r_[first, len(key)])
    hub, met = np.repeat(first, n), np.repeat(n > 1, n)
    columns = (key, node, size.astype(np.int32), node[hub], size[hub].astype(np.int32))
    yield pa.record_batch([pa.array(x[met]) for x in columns], names=["key", "node", "size", "hub", "hub_size"])


def _unsettled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of keys that have more than one root."""
    key, node, size, root = _columns(batches, ["key", "node", "size", "root"])
    order = np.lexsort((root, key))
    key, node, size, root = key[order], node[order], size[order], root[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    last = np.r_[first[1:], len(key)][: len(first)] - 1
    open_ = np.repeat(root[first] != root[last], last + 1 - first)
    columns = (key, node, size.astype(np.int32), root)
    yield pa.record_batch([pa.array(x[open_]) for x in columns], names=["key", "node", "size", "root"])


def _bits(size):
    """The length of the parity bitmap of a set: its size or more, a power of two."""
    return max(LEAST_BITS, 1 << (int(size) - 1).bit_length())


def _bitmap(value: np.ndarray) -> bytes:
    """The parity bitmap of a set: each bit says whether an odd number of shingles falls on it."""
    n = _bits(len(value))
    odd = np.bincount((value & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, bitmap, set); sets of ``SMALL`` shingles at most go along whole."""
    for batch in batches:
        for begin, part in slices(batch.column("text")):
            value, row = shingles(part)
            first = np.searchsorted(row, np.arange(len(part) + 1))
            maps, sets = [], []
            for x, y in zip(first[:-1], first[1:], strict=True):
                maps.append(_bitmap(value[x:y]))
                sets.append(value[x:y].tobytes() if y - x <= SMALL else None)
            yield pa.record_batch([batch.column("node").slice(begin, len(part)), pa.array(maps, pa.binary()), pa.array(sets, pa.binary())], names=["node", "bitmap", "set"])


def _alike(x: bytes, y: bytes, size: int) -> bool:
    """Whether two sets of ``size`` shingles together are similar."""
    both = np.sort(np.frombuffer(x + y, np.uint64), kind="stable")
    return sum(SIMILAR) * int((both[1:] == both[:-1]).sum()) >= SIMILAR[0] * size


def _laid(raw: list[np.ndarray], length: np.ndarray) -> dict[int, np.ndarray]:
    """The bitmaps of a group for each length: those of twice the length are folded down."""
    laid = {}
    for bits in np.unique(length):
        rows = np.zeros((len(raw), bits // 64), np.uint64)
        for k in np.flatnonzero((length == bits) | (length == 2 * bits)):
            rows[k] = np.bitwise_xor.reduce(raw[k].reshape(-1, bits // 64), axis=0)
        laid[int(bits)] = rows
    return laid


def _possible(laid: dict[int, np.ndarray], length: np.ndarray, size: np.ndarray, i: int, j: np.ndarray) -> np.ndarray:
    """Those of the sets ``j``, which are no smaller, that may be similar to set ``i``.

    Two sets differ in at least as many shingles as their parity bitmaps in bits, so a larger difference than similar sets can have
    rules a pair out.
    """
    (num, den), rows = SIMILAR, laid[int(length[i])]
    together = size[i] + size[j]
    differ = together + 2 * (-num * together // (num + den))
    return j[np.bitwise_count(rows[j] ^ rows[i]).sum(axis=1, dtype=np.int64) <= differ]


def _open_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, known) of nodes that meet, two for each row of a key at most. ``known`` ones are a forest of the similar sets that are here whole.

    The others are stars: pairs of different roots of which one set is not here whole, and which may be similar, are in one star.
    """
    held = [b for b in batches if len(b)]
    if not held:
        return
    found = pa.Table.from_batches(held).combine_chunks().sort_by([("key", "ascending"), ("size", "ascending")])
    key, node, size, root = (found.column(c).to_numpy() for c in ("key", "node", "size", "root"))
    maps, sets = found.column("bitmap"), found.column("set")
    (num, den), edges = SIMILAR, np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    out = []

    def send() -> pa.RecordBatch:
        pairs = np.unique(np.array(out, np.int64).reshape(-1, 3), axis=0)
        out.clear()
        return pa.record_batch([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy()), pa.array(pairs[:, 2] == 1)], names=["a", "b", "known"])

    for x, y in zip(edges[:-1], edges[1:], strict=True):
        _, label = np.unique(root[x:y], return_inverse=True)
        if label.max() == 0:
            continue
        own, held = size[x:y].astype(np.int64), sets.slice(x, y - x).to_pylist()
        whole, star = np.array([z is not None for z in held]), np.arange(y - x)
        length = np.array([_bits(n) for n in own])
        laid = _laid([np.frombuffer(z, np.uint64) for z in maps.slice(x, y - x).to_pylist()], length)
        for i in range(y - x - 1):
            stop = int(np.searchsorted(own, own[i] * den // num, side="right"))  # sizes grow
            j = np.arange(i + 1, stop)
            j = j[(label[j] != label[i]) & ((star[j] != star[i]) | (whole[i] & whole[j]))]
            if not len(j):
                continue
            j = _possible(laid, length, own, i, j)
            both = whole[i] & whole[j]
            if not both.all():
                star[np.isin(star, star[j[~both]])] = star[i]
            for k in j[both].tolist():
                if label[i] != label[k] and _alike(held[i], held[k], int(own[i] + own[k])):
                    label[label == label[k]] = label[i]
                    out.append((min(node[x + i], node[x + k]), max(node[x + i], node[x + k]), True))
        _, first, of = np.unique(star, return_index=True, return_inverse=True)
        tips = np.flatnonzero(first[of] != np.arange(y - x))
        out.extend(zip(node[x + first[of[tips]]].tolist(), node[x + tips].tolist(), [False] * len(tips), strict=True))
        if len(out) >= PAIRS:
            yield send()
    yield send()


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of the similar sets of each block, a forest over their roots. All rows of a block are in one task, block after block."""

    def linked(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        rows.sort(key=lambda r: len(r[2]))
        _, label = np.unique([r[1] for r in rows], return_inverse=True)
        own, (num, den) = np.array([len(r[2]) // 8 for r in rows], np.int64), SIMILAR
        length = np.array([_bits(n) for n in own])
        laid = _laid([np.frombuffer(_bitmap(np.frombuffer(r[2], np.uint64)), np.uint64) for r in rows], length)
        for i in range(len(rows) - 1):
            j = np.arange(i + 1, int(np.searchsorted(own, own[i] * den // num, side="right")))
            j = j[label[j] != label[i]]
            for k in _possible(laid, length, own, i, j).tolist() if len(j) else []:
                if label[i] != label[k] and _alike(rows[i][2], rows[k][2], int(own[i] + own[k])):
                    label[label == label[k]] = label[i]
                    yield rows[i][0], rows[k][0]

    def send() -> pa.RecordBatch:
        return pa.record_batch([pa.array([link[k] for link in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    block, rows, out = None, [], []
    for batch in batches:
        for now, node, root, set_ in zip(*(batch.column(c).to_pylist() for c in ("block", "node", "root", "set")), strict=True):
            if now != block and rows:
                out += linked(rows)
                rows = []
            block = now
            rows.append((node, root, set_))
            if len(out) >= PAIRS:
                yield send()
                out = []
    if rows:
        out += linked(rows)
    yield send()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin, part in slices(batch.column("text")):
            value, row = shingles(part)
            first = np.searchsorted(row, np.arange(len(part) + 1))
            yield pa.record_batch([batch.column("node").slice(begin, len(part)), pa.array([value[x:y].tobytes() for x, y in zip(first[:-1], first[1:], strict=True)], pa.binary())], names=["node", "set"])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    num, den = SIMILAR
    for batch in batches:
        near = []
        for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = np.sort(np.concatenate([x, y]), kind="stable")
            near.append((num + den) * int((both[1:] == both[:-1]).sum()) >= num * (len(x) + len(y)))
        kept = pa.array(near, pa.bool_())
        yield pa.record_batch([batch.column("a").filter(kept), batch.column("b").filter(kept)], names=["a", "b"])


def _verified(pairs: DataFrame, texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose texts are similar enough."""
    needed = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    rows = nodes.join(needed, "node", "left_semi").select("row")
    sets = materialise(texts.join(rows, "row", "left_semi").select("node", "text").mapInArrow(_sets, "node long, set binary"))
    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a")
    both = one.join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b").select("a", "b", "x", "y")
    near = materialise(both.mapInArrow(_similar, "a long, b long"))
    release(sets)
    return near


def _roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` with ``root``, their own where no edge leads on."""
    return nodes.join(components(edges), "node", "left").withColumn("root", F.coalesce("root", "node"))


def _by_fingerprint(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that the SimHash pivot tables link: stars of equal fingerprints, and of those within two bits."""
    own = texts.join(nodes.select("row"), "row", "left_semi").select("node", "text")
    prints = materialise(simhash.fingerprints(own))
    least = materialise(prints.groupBy("fp").agg(F.min("node").alias("least")))
    equal = prints.join(least, "fp").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    near = simhash.links(least.select("fp")).join(least.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a")
    near = near.join(least.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return materialise(equal.unionByName(near))


def _inside(stars: DataFrame, near: DataFrame, texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (a, b) between similar nodes that ``stars`` (a, b) connect and ``near`` does not. Each set goes to its group once.

    A group of more than ``BLOCK`` nodes or ``BLOCK_BYTES`` is cut into blocks that meet two by two, so no task holds more than two blocks.
    """
    grouped = components(stars).select("node", F.col("root").alias("group"))
    rooted = materialise(_roots(grouped, near))
    several = rooted.groupBy("group").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("group")
    open_ = rooted.join(several, "group", "left_semi")
    rows = nodes.join(open_, "node", "left_semi").select("row")
    sets = materialise(texts.join(rows, "row", "left_semi").select("node", "text").mapInArrow(_sets, "node long, set binary").join(open_, "node"))
    size = sets.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("set")).alias("bytes"))
    cut = size.select("group", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("bytes") / BLOCK_BYTES)).alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    dealt = sets.join(cut, "group").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    block = F.struct("group", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    at = F.xxhash64("group", F.least("own", "other"), F.greatest("own", "other"))
    # a task holds a block at a time, so Spark may make few tasks of many
    held = dealt.select(at.alias("at"), block.cast("string").alias("block"), "node", "root", "set").repartition("at")
    found = materialise(held.sortWithinPartitions("at", "block").select("block", "node", "root", "set").mapInArrow(_forest, "a long, b long"))
    release(rooted, sets)
    return found


def links(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of ``texts`` (row, node, text) with the similarity. ``nodes`` names one row of each node."""
    spark = texts.sparkSession
    order = spark.sparkContext.broadcast(_order(table_sum(texts.select("text"), COUNTERS, _count)))  # one byte a counter
    n = partitions(spark)
    prefixes = texts.select("node", "text").mapInArrow(_prefixes(order), "key long, node long, size int")
    met = materialise(prefixes.repartition(n, "key").mapInArrow(_meet, _MET))
    num, den = SIMILAR
    alike = den * F.least("size", "hub_size") >= num * F.greatest("size", "hub_size")
    near = _verified(_by_fingerprint(texts, nodes), texts, nodes)
    counted = met.where(alike & (F.col("node") != F.col("hub"))).groupBy(F.col("hub").alias("a"), F.col("node").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(F.floor(F.least("size", "hub_size") / 20) + 1).alias("need"))
    linked = components(near)
    of = lambda c: linked.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    met_often = counted.where("n >= need").select("a", "b")
    apart = F.coalesce("root_a", "a") != F.coalesce("root_b", "b")
    stars = materialise(met_often.join(of("a"), "a", "left").join(of("b"), "b", "left").where(apart).select("a", "b"))
    # a hub is not the hub of every key: what this leaves out is compared below
    near = near.unionByName(_verified(stars, texts, nodes))
    rooted = _roots(met.select("key", "node", "size"), near)
    rest = materialise(rooted.repartition(n, "key").mapInArrow(_unsettled, "key long, node long, size int, root long"))
    release(met)
    rows = nodes.join(rest.select("node").distinct(), "node", "left_semi").select("row")
    signed = texts.join(rows, "row", "left_semi").select("node", "text").mapInArrow(_signatures, "node long, bitmap binary, set binary")
    pairs = materialise(rest.join(signed, "node").repartition(n, "key").mapInArrow(_open_pairs, "a long, b long, known boolean"))
    release(rest)
    near = near.unionByName(materialise(pairs.where("known").select("a", "b").distinct()))
    inside = _inside(pairs.where("not known").select("a", "b"), near, texts, nodes)
    release(pairs)
    return near.unionByName(inside)


def _with_nodes(docs: DataFrame, text: str) -> DataFrame:
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = [np.zeros(0, np.int64)]
            for _, part in slices(batch.column(text)):
                node.append(_nodes(*shingles(part), len(part)))
            yield pa.record_batch([*batch.columns, pa.array(np.concatenate(node))], names=[*batch.schema.names, "_node"])

    return docs.mapInArrow(run, f"{kinds}, _node long")


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The row with the least id of each group of near copies, with all its columns; groups are what pairs of the similarity connect.

    Null ids come last; of rows with equal ids one stays. Null and wordless texts are copies of each other.
    """
    held = materialise(_with_nodes(docs.withColumn("_row", F.monotonically_increasing_id()), text))
    first = F.min(F.struct(F.col(id).isNull().alias("none"), F.col(id).alias("id"), F.col("_row").alias("row"))).alias("first")
    nodes = materialise(held.groupBy(F.col("_node").alias("node")).agg(first))
    texts = held.select(F.col("_row").alias("row"), F.col("_node").alias("node"), F.col(text).alias("text"))
    edges = links(texts, nodes.select("node", F.col("first.row").alias("row")))
    kept = _roots(nodes, edges).groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("_row"))
    return held.join(kept, "_row", "left_semi").select(*docs.columns)
