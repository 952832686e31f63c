"""Exact substring deduplication by difference-cover anchors.

A set of residues is a difference cover of a period when any two positions have a common shift, shorter than the period, that
brings both onto it. So of any two equal windows of ``width`` words, two equal shorter windows ("anchors", of
``width - period + 1`` words) start at covered positions, and only those positions, a quarter of all, are hashed and compared in
the first pass. In the second pass every window of full width that holds a repeated anchor is hashed and compared: the extension.
A window counts as repeated when the hash of its whole word sequence occurs twice, 128 bits in two independent halves. An anchor has
one of 64 bits, as one that is repeated by chance only lets its windows be compared.

Hashes travel packed, in one row for each Arrow batch and bucket, with the places they come from. A batch sends one copy of each
hash; places that it already knows to be repeated go past the comparison, spread by text. So a passage that occurs in a third of
all documents costs its bucket one entry for each batch. Equal texts are folded into one before anything else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import partitions
from .tokens import mix, slices, window_hashes, words

_OTHER = np.uint64(0x5851F42D4C957F2D)
_PACKED = "bucket int, hashes binary, k1 binary, k2 binary, runs binary, at binary"
_PLACES = "k1 long, k2 long, places binary"


def distinct_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row (k1, k2, text, copies) for each different text; null counts as empty. k1, k2: 128 bits of hash."""
    t = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(*text_key(text), t.alias("text"))
    return keyed.groupBy("k1", "k2").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))


def text_key(text: str = "text") -> list:
    t = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(1), t).alias("k2")]


def _pack(h: np.ndarray, more: np.ndarray | None, k1: np.ndarray, k2: np.ndarray, row: np.ndarray, at: np.ndarray, buckets: int, narrow: bool) -> pa.RecordBatch:
    """Rows for the exchange: places row/at with hash h, and its other half ``more`` where there is one. Repeats within h are sent on as known, without a hash."""
    order, same = _twins(h, more)
    again = np.zeros(len(h), bool)
    again[order[1:][same]] = True
    known = again.copy()
    known[order[:-1][same]] = True
    parts = []
    for mask, bucket in ((~again, h % np.uint64(buckets)), (known, k1.view(np.uint64)[row] % np.uint64(buckets))):
        pick = np.flatnonzero(mask)
        pick = pick[np.argsort(bucket[pick], kind="stable")]
        parts.append((pick, bucket[pick].astype(np.int64)))
    rows: list[list] = [[] for _ in range(6)]
    for kind, (pick, bucket) in enumerate(parts):
        edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(pick) else np.zeros(1, np.int64)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            p = pick[a:b]
            r = row[p]
            runs = np.flatnonzero(np.r_[True, r[1:] != r[:-1], True])
            own = r[runs[:-1]]
            sent = b"" if kind else ((h[p] // np.uint64(buckets)).astype(np.uint32).tobytes() if narrow else h[p].tobytes() + more[p].tobytes())
            for out, x in zip(rows, (int(bucket[a]), sent, k1[own].tobytes(), k2[own].tobytes(), np.diff(runs).astype(np.uint32).tobytes(), at[p].astype(np.uint32).tobytes()), strict=True):
                out.append(x)
    return pa.record_batch([pa.array(rows[0], pa.int32()), *(pa.array(x, pa.binary()) for x in rows[1:])], names=["bucket", "hashes", "k1", "k2", "runs", "at"])


def _twins(h: np.ndarray, more: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """An order of the hashes, and whether each equals the one before it there."""
    order = np.argsort(h, kind="stable") if more is None else np.lexsort((more, h))
    s = h[order]
    same = s[1:] == s[:-1]
    if more is not None:
        same &= more[order][1:] == more[order][:-1]
    return order, same


def _keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(batch.column(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("k1", "k2"))


def _anchors(width: int, period: int, cover: tuple[int, ...], buckets: int):
    short = width - period + 1
    covered = np.isin(np.arange(period), cover)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = _keys(batch)
            found = [[], [], []]
            for begin, part in slices(batch.column("text")):
                w = words(part)
                hashes, row = w.hashes(), w.row
                place = np.arange(len(row)) - w.first[row]
                # an anchor matters only within some window of full width
                at = np.flatnonzero(covered[place % period] & (place + short <= w.counts[row]) & (w.counts[row] >= width))
                for out, x in zip(found, (window_hashes(hashes, at, short), row[at] + begin, place[at]), strict=True):
                    out.append(x)
            if found[0]:
                h, row, at = map(np.concatenate, found)
                yield _pack(h, None, k1, k2, row, at, buckets, narrow=True)

    return emit


def _windows(width: int, period: int, buckets: int):
    back = period - 1

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = _keys(batch)
            places = batch.column("places")
            found = [[], [], [], []]
            for begin, part in slices(batch.column("text")):
                w = words(part)
                open_at = np.zeros(len(w.start) + 1, np.int64)
                for r in range(len(part)):
                    at = np.frombuffer(places[begin + r].as_buffer(), np.uint32).astype(np.int64)
                    low, high = np.maximum(at - back, 0), np.minimum(at, w.counts[r] - width) + 1
                    some = high > low
                    np.add.at(open_at, low[some] + w.first[r], 1)
                    np.add.at(open_at, high[some] + w.first[r], -1)
                start = np.flatnonzero(np.cumsum(open_at)[:-1] > 0)
                row = w.row[start]
                hashes = w.hashes()
                halves = (window_hashes(hashes, start, width), window_hashes(mix(hashes + _OTHER), start, width))
                for out, x in zip(found, (*halves, row + begin, start - w.first[row]), strict=True):
                    out.append(x)
            if found[0]:
                h, more, row, at = map(np.concatenate, found)
                yield _pack(h, more, k1, k2, row, at, buckets, narrow=False)

    return emit


def _unpack(x: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k1, k2 = (np.repeat(np.frombuffer(x[k], np.int64), np.frombuffer(x["runs"], np.uint32)) for k in ("k1", "k2"))
    return k1, k2, np.frombuffer(x["at"], np.uint32)


def _find(buckets: int, narrow: bool):
    """Of one bucket's places those whose hash comes twice, and those that are known to be repeated; packed again, by text."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, others, rows, known = [], [], [], []
        for batch in batches:
            for x in batch.to_pylist():
                if x["hashes"]:
                    # narrow hashes are the quotient by the number of buckets, so they compare within a bucket only
                    if narrow:
                        hashes.append(np.frombuffer(x["hashes"], np.uint32).astype(np.uint64) | (np.uint64(x["bucket"]) << np.uint64(32)))
                    else:
                        for out, half in zip((hashes, others), np.frombuffer(x["hashes"], np.uint64).reshape(2, -1), strict=True):
                            out.append(half)
                    rows.append(_unpack(x))
                else:
                    known.append(_unpack(x))
        if hashes:
            h = np.concatenate(hashes)
            order, same = _twins(h, None if narrow else np.concatenate(others))
            twice = np.zeros(len(h), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            known.append(tuple(np.concatenate(x)[twice] for x in zip(*rows, strict=True)))
        if known:
            k1, k2, at = (np.concatenate(x) for x in zip(*known, strict=True))
            bucket = (k1.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((at, k2, k1, bucket))
            k1, k2, at, bucket = k1[order], k2[order], at[order], bucket[order]
            edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(at) else np.zeros(1, np.int64)
            rows = [[] for _ in range(5)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                runs = _runs(k1[a:b], k2[a:b])
                for out, x in zip(rows, (int(bucket[a]), k1[a:b][runs[:-1]].tobytes(), k2[a:b][runs[:-1]].tobytes(), np.diff(runs).astype(np.uint32).tobytes(), at[a:b].tobytes()), strict=True):
                    out.append(x)
            yield pa.record_batch([pa.array(rows[0], pa.int32()), *(pa.array(x, pa.binary()) for x in rows[1:])], names=["bucket", "k1", "k2", "runs", "at"])

    return find


def _runs(k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, and the end."""
    return np.flatnonzero(np.r_[True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]), True]) if len(k1) else np.zeros(1, np.int64)


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each text with all its places."""
    rows = [_unpack(x) for batch in batches for x in batch.to_pylist()]
    if rows:
        k1, k2, at = (np.concatenate(x) for x in zip(*rows, strict=True))
        order = np.lexsort((at, k2, k1))
        k1, k2, at = k1[order], k2[order], at[order]
        runs = _runs(k1, k2)
        yield pa.record_batch([k1[runs[:-1]], k2[runs[:-1]], pa.array([at[a:b].tobytes() for a, b in zip(runs[:-1], runs[1:], strict=True)], pa.binary())], names=["k1", "k2", "places"])


def _repeated(packed: DataFrame, buckets: int, narrow: bool) -> DataFrame:
    """(k1, k2, places): for each text that has some the places whose hash occurs twice."""
    found = packed.repartitionById(buckets, F.col("bucket")).mapInArrow(_find(buckets, narrow), "bucket int, k1 binary, k2 binary, runs binary, at binary")
    return found.repartitionById(buckets, F.col("bucket")).mapInArrow(_gather, _PLACES)


def _strip(width: int):
    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, copies, places = batch.column("text"), batch.column("copies").to_pylist(), batch.column("places")
            out = ([], [], [])
            for i in range(len(texts)):
                own = texts[i].as_py().encode().split()
                n = len(own)
                if copies[i] > 1 and n >= width:
                    own = []
                elif places[i].is_valid:
                    at = np.frombuffer(places[i].as_buffer(), np.uint32).astype(np.int64)
                    cover = np.zeros(n + 1, np.int64)
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + width, -1)
                    own = [own[j] for j in np.flatnonzero(np.cumsum(cover)[:n] == 0)]
                for x, y in zip(out, (n, n - len(own), b" ".join(own)), strict=True):
                    x.append(y)
            yield pa.record_batch([batch.column("k1"), batch.column("k2"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()).cast(pa.string())], names=["k1", "k2", "n_words", "n_removed", "kept_text"])

    return strip


def stripped_texts(docs: DataFrame, text: str = "text", width: int = 35, period: int = 21, cover: tuple[int, ...] = (0, 1, 4, 14, 16)) -> DataFrame:
    """For each different text (k1, k2 of ``text_key``): n_words, n_removed and kept_text.

    Every word goes that lies in a window of ``width`` words whose word sequence also starts anywhere else, in the same text or
    another row; windows are judged on the input. kept_text joins the other words by one space. A null text has no words, a text
    shorter than ``width`` keeps all it has, and two rows with equal text repeat each other. The rest of ``docs`` is not read.
    """
    if not 0 < period <= width or {(a - b) % period for a in cover for b in cover} != set(range(period)):
        raise ValueError("cover must hold two residues for every difference modulo period, and period must not exceed width")
    n = partitions(docs.sparkSession)
    texts = distinct_texts(docs, text)
    anchors = _repeated(texts.select("k1", "k2", "text").mapInArrow(_anchors(width, period, tuple(cover), n), _PACKED), n, narrow=True)
    near = texts.join(anchors, ["k1", "k2"]).select("k1", "k2", "text", "places")
    starts = _repeated(near.mapInArrow(_windows(width, period, n), _PACKED), n, narrow=False)
    return texts.join(starts, ["k1", "k2"], "left").select("k1", "k2", "text", "copies", "places").mapInArrow(_strip(width), "k1 long, k2 long, n_words long, n_removed long, kept_text string")


def remove_repeated_passages(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """Every row and column of ``docs`` with n_words, n_removed and kept_text; columns of those names give way. See ``stripped_texts``."""
    own = {"n_words", "n_removed", "kept_text", "k1", "k2"}
    keyed = docs.select(*(c for c in docs.columns if c not in own), *text_key(text))
    return keyed.join(stripped_texts(docs, text, **how), ["k1", "k2"], "left").drop("k1", "k2")
