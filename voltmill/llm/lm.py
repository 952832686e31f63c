"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax.

P(word) = P(class | context) * P(word | class, last word). Words of neighbouring frequency form classes; seldom and unseen words
belong to classes by what they begin with. The class features are the last word, the one before it (a skip) and both, the words as
symbols of the contexts: the commonest by themselves, others by what they begin with, pairs hashed into rows. The feature of a word
within its class is the n-gram of it and the last word: a word of count n has in its class the share p = (n + 0.5) / (the class's sum),
which a weight w turns into p * exp(w) / Z, where Z = 1 + sum of p * (exp(w) - 1) over the pairs that have a weight. So only pairs
that the corpus has twice or more, of words it has ``SELDOM`` times or more, cost anything, and the sum over all words is 1. A class by beginning has besides its known words
0.5 for all unseen ones together. Scores of different models of one text can thus be compared.

What is gathered grows with the corpus: the word counts and the pairs' weights, one row for each different word and pair, lie in
tables that are joined at scoring; the numbers of classes, of context symbols and of rows follow the number of different words.
The commonest words and pairs also travel to the tasks as sorted tables of fixed size, and a Bloom filter of fixed size keeps back
lookups of pairs that have no weight. Neither changes a score.

Training is by gradient updates. The class weights are updated ``UPDATES`` times, each time from one part of the training documents:
tasks add up observed and expected counts of every feature, and each weight moves along their difference, in logarithms. The
weights of pairs do not touch each other beyond one last word and class, so their updates run where those pairs are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .shared import materialise, partitions, release
from .sums import table_sum
from .tokens import _LOWER, Words, mix, slices, words

BITS = 18
START = 1 << BITS  # stands for the word before a text's first one
FREQUENT = START
#: Weights of pairs that travel to the tasks: 24 MB.
CARRIED = 1 << 21
SELDOM = 8
UPDATES = 3
PULL = 4.0  # added to observed and expected counts
DISCOUNT = 0.6  # taken from the count of a pair
STEPS = 6  # updates of the pairs' weights
CHUNK = 1 << 13
HELD = 1 << 20  # pairs of symbols that a task gathers before it asks the model
END = np.uint64(0x656E64)  # the hash of the end token


def held_out(id: str) -> Column:
    """Whether a document is kept from training: the CRC-32 of its id as text leaves 1 modulo 5. A null id is held out."""
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 5 == 1, F.lit(True))


def tokens(part: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, beginning, row) of every token, each row's end token last. A beginning is a word's first two bytes."""
    w: Words = words(part)
    h, n = w.hashes(lower=True), len(part)
    first = _LOWER[w.data[w.start]].astype(np.int64)
    second = np.where(w.end - w.start > 1, _LOWER[w.data[np.minimum(w.start + 1, max(len(w.data) - 1, 0))]], 0).astype(np.int64)
    row = np.concatenate([w.row, np.arange(n)])
    order = np.argsort(row, kind="stable")
    return np.concatenate([h, np.full(n, END)])[order], np.concatenate([first * 256 + second, np.zeros(n, np.int64)])[order], row[order]


def _distinct(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, a position, sum of n) of the different keys."""
    order = np.argsort(key)
    key, n = key[order], n[order].astype(np.int64)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    return key[first], order[first], np.add.reduceat(n, first) if len(first) else n


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for _, part in slices(batch.column("text")):
            h, begin, _ = tokens(part)
            h, at, n = _distinct(h, np.ones(len(h), np.int64))
            found.append((h, begin[at].astype(np.int32), n))
        if found:
            h, begin, n = (np.concatenate(x) for x in zip(*found, strict=True))
            h, at, n = _distinct(h, n)
            yield pa.record_batch([h.view(np.int64), begin[at], n], names=["hash", "begin", "n"])


class Places:
    """Looks hashes up in a sorted table of different ones, from where those with the same first bits begin: a few steps for each, not one for
    each halving of the table."""

    def __init__(self, table: np.ndarray) -> None:
        bits = max(1, len(table).bit_length())
        self.table, self.shift = table, np.uint64(64 - bits)
        self.first = np.r_[0, np.cumsum(np.bincount((table >> self.shift).astype(np.int64), minlength=1 << bits))]

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, known); the position of an unknown one is any."""
        cell = (keys >> self.shift).astype(np.int64)
        at, stop, known = self.first[cell], self.first[cell + 1], np.zeros(len(keys), bool)
        left = np.flatnonzero(at < stop)
        while len(left):
            here = self.table[at[left]] == keys[left]
            known[left[here]] = True
            left = left[~here]
            at[left] += 1
            left = left[at[left] < stop[left]]
        return np.minimum(at, max(len(self.table) - 1, 0)), known


@dataclass
class Vocabulary:
    """The frequent words, sorted by hash, with their counts, classes and context symbols. ``share``: log10 of a word's share of its class.

    ``own`` classes are by frequency, ``other`` of all other words by their beginning; ``mass`` has the sums of n + 0.5 of all classes. Likewise the first
    ``words`` context symbols, and ``groups`` by beginning; the last symbol is what lies before a text.
    """

    hash: np.ndarray
    count: np.ndarray
    total: int
    different: int
    own: int
    other: int
    words: int
    groups: int
    cls: np.ndarray
    symbol: np.ndarray
    share: np.ndarray
    mass: np.ndarray

    @property
    def classes(self) -> int:
        return self.own + self.other

    @property
    def symbols(self) -> int:
        return self.words + self.groups + 1

    @property
    def rows(self) -> int:
        return 1 << (2 * self.symbols - 1).bit_length()


def _spread(begin: np.ndarray, n: int) -> np.ndarray:
    return (mix(begin.astype(np.uint64)) % np.uint64(n)).astype(np.int64)


def make_vocabulary(h: np.ndarray, begin: np.ndarray, n: np.ndarray, total: int, different: int, others: dict[int, float]) -> Vocabulary:
    """From the frequent words, and for each beginning the sum of n + 0.5 over the other words.

    Words of fewer than ``SELDOM`` tokens belong to the classes by beginning too, so these are met often enough to be learned about.
    """
    order = np.argsort(h)
    h, begin, n = h[order], begin[order], n[order]
    size = np.log2(different + 2)
    classes = 1 << max(3, round(size / 3) - 1)
    own, other = max(1, classes * 3 // 4), max(1, classes // 4)
    symbols = 1 << max(5, min(12, round(size / 2)))
    by_count = np.lexsort((h, -n))
    # bands of equal sums of the roots: common words are few in a class, and no class has nearly all words
    root = np.where(n[by_count] >= SELDOM, np.sqrt(n[by_count]), 0.0)
    band = np.minimum(((np.cumsum(root) - root / 2) / max(root.sum(), 1e-9) * own).astype(np.int64), own - 1)
    cls, symbol = np.zeros(len(h), np.int64), np.full(len(h), -1)
    cls[by_count] = band
    seldom = n < SELDOM
    cls[seldom] = own + _spread(begin[seldom], other)
    top = by_count[: symbols * 3 // 4]
    symbol[top] = np.arange(len(top))
    mass = np.zeros(own + other)
    mass[own:] = 0.5
    np.add.at(mass, cls, n + 0.5)
    for start, sum_ in others.items():
        mass[own + _spread(np.array([start]), other)[0]] += sum_
    share = np.log10((n + 0.5) / mass[cls]) if len(h) else np.zeros(0)
    return Vocabulary(h, n, total, different, own, other, symbols * 3 // 4, symbols // 4, cls.astype(np.int32), symbol.astype(np.int32), share, np.maximum(mass, 0.5))


def _vocabulary(counts: DataFrame) -> Vocabulary:
    """From (hash, begin, n). The driver receives FREQUENT words at most, and sums by count and by beginning."""
    bin = F.floor(F.log2("n") * 16).cast("int")
    bins = counts.groupBy(bin.alias("bin")).agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("tokens")).orderBy(F.desc("bin")).collect()
    least, sum_ = None, 0
    for b in bins:
        sum_ += b.words
        if sum_ > FREQUENT:
            break
        least = b.bin
    frequent = bin >= least if least is not None else F.lit(False)
    rows = counts.where(frequent).select("hash", "begin", "n").toArrow()
    rest = counts.where(~frequent).groupBy("begin").agg(F.sum(F.col("n") + 0.5).alias("mass")).collect()
    return make_vocabulary(rows["hash"].to_numpy().view(np.uint64), rows["begin"].to_numpy().astype(np.int64), rows["n"].to_numpy(), int(sum(b.tokens for b in bins)), int(sum(b.words for b in bins)), {r.begin: r.mass for r in rest})


def _encode(vocabulary):
    """Texts as numbers: a frequent word is its position, another one the complement of its beginning, and its hash goes into ``rare``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        places, next_row = Places(vocabulary.value.hash), TaskContext.get().partitionId() << 33
        for batch in batches:
            for begin, part in slices(batch.column("text")):
                n = len(part)
                h, beginning, row = tokens(part)
                at, known = places.look_up(h)
                word = np.where(known, at, -1 - beginning).astype(np.int32)
                packed = []
                for x, of in ((word, row), (h[~known], row[~known])):
                    ends = np.searchsorted(of, np.arange(n + 1))
                    packed.append(pa.array([x[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()))
                yield pa.record_batch([batch.column("id").slice(begin, n), batch.column("held_out").slice(begin, n), pa.array(np.arange(next_row, next_row + n)), *packed], names=["id", "held_out", "row", "words", "rare"])
                next_row += n

    return run


def _numbers(part: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(number, row) of the packed numbers of each row."""
    part = part.cast(pa.large_binary())
    size = np.dtype(kind).itemsize
    offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
    data = np.frombuffer(part.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(part) and part.buffers()[2] is not None else np.zeros(0, np.uint8)
    return np.frombuffer(data.tobytes(), kind), np.repeat(np.arange(len(part)), np.diff(offsets) // size)


@dataclass
class Tokens:
    """Of every token: its class, the context symbols of the two tokens before it, its position (negative if it is not frequent) and
    ``after``: the last token's position, START before the first token, -1 if it is seldom. ``paired``: whether this word and the last one
    may be a pair with a weight."""

    word: np.ndarray
    row: np.ndarray
    cls: np.ndarray
    last: np.ndarray
    before: np.ndarray
    after: np.ndarray
    paired: np.ndarray


def read_tokens(v: Vocabulary, part: pa.Array) -> Tokens:
    word, row = _numbers(part, np.int32)
    word = word.astype(np.int64)
    known = word >= 0
    symbol, cls = np.full(len(word), -1), np.zeros(len(word), np.int64)
    symbol[known], cls[known] = v.symbol[word[known]], v.cls[word[known]]
    begin = -1 - word[~known]
    cls[~known] = v.own + _spread(begin, v.other)
    beginning = np.zeros(len(word), np.int64)
    beginning[~known] = begin
    # frequent words without a symbol of their own share those of the groups by their position
    beginning[known] = word[known]
    symbol = np.where(symbol >= 0, symbol, v.words + _spread(beginning, v.groups))
    start = v.symbols - 1
    last, before, after = np.full(len(word), start), np.full(len(word), start), np.full(len(word), START)
    same = row[1:] == row[:-1]
    last[1:][same] = symbol[:-1][same]
    after[1:][same] = np.where(known & (cls < v.own), word, -1)[:-1][same]
    same = row[2:] == row[:-2]
    before[2:][same] = symbol[:-2][same]
    return Tokens(word, row, cls, last, before, after, known & (cls < v.own) & (after >= 0))


@dataclass
class Model:
    """Weights of the class features, by class: ``prior``, ``last`` and ``skip`` by context symbol, ``both`` by row; single precision."""

    prior: np.ndarray
    last: np.ndarray
    skip: np.ndarray
    both: np.ndarray

    def pair_row(self, before: np.ndarray, last: np.ndarray) -> np.ndarray:
        return (mix((before * len(self.last) + last).astype(np.uint64)) & np.uint64(len(self.both) - 1)).astype(np.int64)

    def classes(self, before: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Log probabilities of the classes after each pair."""
        z = self.prior + self.last[last] + self.skip[before] + self.both[self.pair_row(before, last)]
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def _sum_rows(table: np.ndarray, at: np.ndarray, x: np.ndarray) -> None:
    order = np.argsort(at, kind="stable")
    first = np.flatnonzero(np.r_[True, at[order][1:] != at[order][:-1]])
    table[at[order][first]] += np.add.reduceat(x[order], first, axis=0)


def _gradient(vocabulary, model):
    """Observed and expected counts of every class feature, one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        v, m = vocabulary.value, model.value
        c, sizes = v.classes, (len(m.last), len(m.skip), len(m.both))
        out = np.zeros(2 * sum(sizes) * c)
        tables = [x.reshape(-1, c) for x in np.split(out, np.cumsum([s * c for s in (*sizes, *sizes)])[:-1])]
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def expect() -> None:
            """Adds what the model expects after the pairs of symbols that are held, each once."""
            pair, _, n = _distinct(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            for a in range(0, len(pair), CHUNK):
                before, last = np.divmod(pair[a : a + CHUNK], len(m.last))
                p = np.exp(m.classes(before, last)) * n[a : a + CHUNK, None].astype(np.float32)
                for table, at in zip(tables[3:], (last, before, m.pair_row(before, last)), strict=True):
                    _sum_rows(table, at, p)

        for batch in batches:
            for _, part in slices(batch.column("words")):
                t = read_tokens(v, part)
                if not len(t.word):
                    continue
                for table, at in zip(tables[:3], (t.last, t.before, m.pair_row(t.before, t.last)), strict=True):
                    cell = at * c + t.cls
                    cell, n = np.unique(cell, return_counts=True)
                    table.reshape(-1)[cell] += n
                held.append(np.unique(t.before * len(m.last) + t.last, return_counts=True))
                if sum(len(pair) for pair, _ in held) > HELD:
                    expect()
        if held:
            expect()
        return out

    return run


def _train_classes(train: DataFrame, shared, v: Vocabulary) -> Model:
    """From encoded documents with a column ``part``."""
    spark, c = train.sparkSession, v.classes
    of_class = np.maximum(v.mass, 0.5)
    prior = np.log(of_class / of_class.sum())
    tables = [np.zeros((n, c), np.float32) for n in (v.symbols, v.symbols, v.rows)]
    single = lambda: Model(prior.astype(np.float32), *(x.astype(np.float32) for x in tables))
    base = np.exp(prior)
    fewer = max(spark.sparkContext.defaultParallelism, partitions(spark) // UPDATES)  # each task sends tables, and an update reads a part of the rows
    for update in range(UPDATES):
        now = spark.sparkContext.broadcast(single())
        size = sum(x.size for x in tables)
        own = train.where(F.col("part") == update).select("words").coalesce(fewer)
        both = table_sum(own, 2 * size, _gradient(shared, now), kind=np.float32)
        now.destroy()  # a broadcast's files stay with every executor until then
        at = np.cumsum([0, *(x.size for x in tables)])
        for k, (weight, step) in enumerate(zip(tables, (0.5, 0.4, 0.5), strict=True)):
            o, e = (both[s + at[k] : s + at[k + 1]].reshape(weight.shape) for s in (0, size))
            for x in (o, e):
                x += PULL * base + 1e-9
                np.log(x, out=x)
            o -= e
            o *= step
            weight += o
        del both
    return single()


_PACKED = "bucket int, size int, data binary"


def _pack(key: np.ndarray, n: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
    """One row for each bucket: its sorted keys by their differences, and their counts, compressed byte plane by byte plane."""
    order = np.lexsort((key, bucket))
    key, n, bucket = key[order], n[order], bucket[order]
    edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(key) else np.zeros(1, np.int64)
    planes = lambda x, kind: np.ascontiguousarray(x.astype(kind).view(np.uint8).reshape(len(x), -1).T).tobytes()
    data = [pa.compress(planes(np.diff(key[x:y], prepend=0), np.int64) + planes(n[x:y], np.int64), "zstd", asbytes=True) for x, y in zip(edges[:-1], edges[1:], strict=True)]
    return pa.record_batch([pa.array(bucket[edges[:-1]].astype(np.int32)), pa.array(np.diff(edges).astype(np.int32)), pa.array(data, pa.binary())], names=["bucket", "size", "data"])


def _unpack(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """(key, n) of all rows, each key once. What has come is added up from time to time, so a task holds little more than its different keys."""
    key, n, held = np.zeros(0, np.int64), np.zeros(0, np.int64), []

    def added() -> tuple[np.ndarray, np.ndarray]:
        keys, _, sums = _distinct(np.concatenate([key, *(k for k, _ in held)]), np.concatenate([n, *(m for _, m in held)]))
        return keys, sums

    for batch in batches:
        for size, data in zip(batch.column("size").to_pylist(), batch.column("data"), strict=True):
            both = np.frombuffer(pa.decompress(data.as_buffer(), decompressed_size=16 * size, codec="zstd", asbytes=True), np.uint8).reshape(2, 8, size)
            step, count = (np.ascontiguousarray(x.T).view(np.int64).ravel() for x in both)
            held.append((np.cumsum(step), count))
        if sum(len(k) for k, _ in held) > max(1 << 20, len(key)):
            key, n = added()
            held = []
    return added()


def _pairs(vocabulary, buckets: int):
    """Counts of the n-grams of two words that are not seldom, or of a text's start and one; key: the last word's position, then the word's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, part in slices(batch.column("words")):
                t = read_tokens(vocabulary.value, part)
                found.append(np.unique((t.after[t.paired] << (BITS + 1)) | t.word[t.paired], return_counts=True))
            if found:
                key, _, n = _distinct(*(np.concatenate(x) for x in zip(*found, strict=True)))
                yield _pack(key, n, (mix(key.view(np.uint64)) % np.uint64(buckets)).astype(np.int64))

    return run


def _fold(vocabulary, buckets: int):
    """Adds the counts of each pair up and deals the sums by last word. Pairs that came once have no weight; they are sent on as their number
    for each last word and class, START + class in place of a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n = _unpack(batches)
        once = n == 1
        cls = vocabulary.value.cls.astype(np.int64)[key[once] & (START - 1)] if once.any() else np.zeros(0, np.int64)
        folded, _, number = _distinct((key[once] >> (BITS + 1) << (BITS + 1)) | (START + cls), n[once])
        key, n = np.concatenate([key[~once], folded]), np.concatenate([n[~once], number])
        if len(key):
            yield _pack(key, n, (mix((key >> (BITS + 1)).astype(np.uint64)) % np.uint64(buckets)).astype(np.int64))

    return run


def pair_key(after: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The key of a pair's weight, or with START + class for a word that of the class's normaliser; spread over 64 bits."""
    return mix((after.astype(np.uint64) << np.uint64(BITS + 1)) | word.astype(np.uint64))


def fit_pairs(v: Vocabulary, after: np.ndarray, word: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, weight, n) of pairs and normalisers, in log10, from all pairs of some last words. A word of START + class stands for pairs of
    that class without a weight."""
    real = word < START
    cls = np.where(real, v.cls[np.where(real, word, 0)] if len(v.cls) else 0, word - START).astype(np.int64)
    order = np.lexsort((word, cls, after))
    after, word, n, cls, real = after[order], word[order], n[order].astype(np.float64), cls[order], real[order]
    group = np.cumsum(np.r_[False, (after[1:] != after[:-1]) | (cls[1:] != cls[:-1])]) if len(after) else np.zeros(0, np.int64)
    total = np.bincount(group, n)
    p = np.where(real, 10 ** v.share[np.where(real, word, 0)] if len(v.share) else 0.0, 0.0)
    own = real & (n >= 2)
    w = np.zeros(len(n))
    target = np.maximum(n - DISCOUNT, 0.0)
    z = np.ones(len(total))
    for _ in range(STEPS):
        expected = total[group] * p * np.exp(w) / z[group]
        w = np.where(own, w + np.log((target + 1e-6) / (expected + 1e-6)), 0.0)
        z = np.maximum(1 + np.bincount(group, p * np.expm1(w), len(total)), 1e-12)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]][: len(group)])
    some = np.bincount(group, own, len(total)) > 0
    first = first[some]
    keys = np.concatenate([pair_key(after[own], word[own]), pair_key(after[first], START + cls[first])])
    return keys, np.concatenate([w[own], -np.log(z[some])]) / np.log(10), np.concatenate([n[own], total[some]]).astype(np.int64)


def _fit(vocabulary):
    """All pairs of a last word are in one task, FREQUENT and a few for each class at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n = _unpack(batches)
        if len(key):
            key, weight, n = fit_pairs(vocabulary.value, key >> (BITS + 1), key & (2 * START - 1), n)
            yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(weight), pa.array(n)], names=["key", "weight", "n"])

    return run


@dataclass
class Carried:
    """Weights of the commonest pairs, sorted by key, and the filter of all others."""

    key: np.ndarray
    weight: np.ndarray
    rest: np.ndarray


def _carried(weights: DataFrame) -> Carried:
    bin = F.floor(F.log2("n") * 16).cast("int")
    bins = weights.groupBy(bin.alias("bin")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("bin")).collect()
    least, sum_ = None, 0
    for b in bins:
        if sum_ + b.rows > CARRIED:
            break
        sum_, least = sum_ + b.rows, b.bin
    common = bin >= least if least is not None else F.lit(False)
    rows = weights.where(common).select("key", F.col("weight").cast("float").alias("weight")).toArrow()
    key = rows["key"].to_numpy().view(np.uint64)
    order = np.argsort(key)
    return Carried(key[order], rows["weight"].to_numpy()[order], bloom.build(weights.where(~common).select("key"), int(sum(b.rows for b in bins)) - sum_))


def _score(vocabulary, model, carried):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, m, top = vocabulary.value, model.value, carried.value
        places = Places(top.key)
        z = np.log10(v.total + 0.5 * (v.different + 1))
        unseen = np.log10(0.5)
        log_count, log_mass = np.log10(v.count + 0.5), np.log10(v.mass)
        for batch in batches:
            for begin, part in slices(batch.column("words")):
                n = len(part)
                t = read_tokens(v, part)
                known, row = t.word >= 0, t.row
                total = lambda x, of=row: np.bincount(of, x, n)
                base, score = np.full(len(row), unseen), unseen - log_mass[t.cls]
                base[known], score[known] = log_count[t.word[known]], v.share[t.word[known]]
                pair = t.before * len(m.last) + t.last
                order = np.argsort(pair)
                pair = pair[order]
                new = np.r_[True, pair[1:] != pair[:-1]][: len(pair)]
                which, first = np.cumsum(new) - 1, np.flatnonzero(new)  # of the tokens in this order
                edges = np.r_[first[::CHUNK], len(pair)]
                for a, low, high in zip(range(0, len(first), CHUNK), edges[:-1], edges[1:], strict=True):
                    classes = m.classes(*np.divmod(pair[first[a : a + CHUNK]], len(m.last)))
                    at = order[low:high]
                    score[at] += classes[which[low:high] - a, t.cls[at]] / np.log(10)
                both = np.flatnonzero(t.paired)
                keys = np.concatenate([pair_key(t.after[both], t.word[both]), pair_key(t.after[both], START + t.cls[both])])
                of = np.concatenate([both, both])
                at, here = places.look_up(keys)
                sums = total(score) + np.bincount(row[of[here]], top.weight[at[here]].astype(np.float64), n)
                asked = ~here
                asked[asked] = bloom.test(top.rest, keys[asked])
                rare, rare_row = _numbers(batch.column("rare").slice(begin, n), np.uint64)
                keys, rows = np.concatenate([keys[asked], rare]), np.concatenate([row[of[asked]], rare_row])
                order = np.lexsort((keys, rows))
                keys, rows = keys[order], rows[order]
                first = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])][: len(keys)])
                times = np.diff(np.r_[first, len(keys)])
                offsets = np.searchsorted(rows[first], np.arange(n + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x)) for x in (keys[first].view(np.int64), times.astype(np.int32))]
                columns = [np.bincount(row, minlength=n), total(known).astype(np.int64), total(base - z), sums]
                yield pa.record_batch([*(batch.column(c).slice(begin, n) for c in ("id", "held_out", "row")), *map(pa.array, columns), *lists], names=["id", "held_out", "row", "n_tokens", "n_known", "base", "score", "keys", "times"])

    return run


def score_texts(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row; scores are log10 probabilities of the text.

    Tokens: its words, A-Z lowered, and one end. The model and the counts are of the documents that ``held_out`` leaves.
    base_score: each token has (its count + 0.5) / (all + 0.5 * (different + 1)); n_known: tokens that were counted. Null and empty
    texts have only the end token; repeated rows are counted and scored one by one. Without training documents nothing is known and
    the base score is 0. Columns other than id and text are not read.
    """
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    plain = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), held_out(id).alias("held_out"))
    counts = materialise(plain.where(~F.col("held_out")).select("text").mapInArrow(_count, "hash long, begin int, n long").groupBy("hash").agg(F.min("begin").alias("begin"), F.sum("n").alias("n")))
    v = _vocabulary(counts)
    shared = share(v)
    kind = docs.select(id).schema[0].dataType.simpleString()
    coded = materialise(plain.mapInArrow(_encode(shared), f"id {kind}, held_out boolean, row long, words binary, rare binary"))
    train = coded.where(~F.col("held_out")).select("words", F.pmod(F.xxhash64("row"), F.lit(UPDATES)).alias("part"))
    model = share(_train_classes(train, shared, v))
    n = partitions(spark)
    pairs = train.select("words").mapInArrow(_pairs(shared, n), _PACKED).repartitionById(n, F.col("bucket"))
    folded = pairs.mapInArrow(_fold(shared, n), _PACKED).repartitionById(n, F.col("bucket"))
    fitted = folded.mapInArrow(_fit(shared), "key long, weight double, n long")
    weights = materialise(fitted)
    carried = share(_carried(weights))
    scored = materialise(coded.mapInArrow(_score(shared, model, carried), f"id {kind}, held_out boolean, row long, n_tokens long, n_known long, base double, score double, keys array<long>, times array<int>"))
    release(coded)
    asked = scored.select("row", F.explode(F.arrays_zip("keys", "times")).alias("w")).select("row", F.col("w.keys").alias("key"), F.col("w.times").alias("times"))
    # a word counted lifts its score from that of an unseen one; a pair's weight has no part in the base score
    lifted = counts.select(F.col("hash").alias("key"), (F.log10(F.col("n") + 0.5) - float(np.log10(0.5))).alias("base"), F.lit(1).alias("known"))
    table = lifted.withColumn("weight", F.col("base")).unionByName(weights.select("key", F.lit(0.0).alias("base"), F.lit(0).alias("known"), "weight"))
    times = F.col("times")
    more = asked.join(table, "key").groupBy("row").agg(F.sum(times * F.col("base")).alias("more_base"), F.sum(times * F.col("weight")).alias("more"), F.sum(times * F.col("known")).alias("more_known"))
    joined = scored.drop("keys", "times").join(more, "row", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return joined.select(
        F.col("id").alias(id), "held_out", "n_tokens", plus("n_known", "more_known").cast("long").alias("n_known"),
        F.lit(v.total).cast("long").alias("train_tokens"), plus("base", "more_base").alias("base_score"), plus("score", "more").alias("score"),
    )
