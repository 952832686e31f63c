"""SentencePiece encoding and decoding, by the model's own law.

The pieces and their scores come from a model file, which the driver reads and broadcasts; nothing is trained. An Aho-Corasick
automaton over the pieces drives one pass from the left: at each position it names the pieces that end there, the longest first
and the others along its output links, and the best path to that position is relaxed by each of them.

What "best" means is the model's law. A unigram model adds scores, and the largest sum wins. The scores of a BPE model are ranks of
merges, whose sum means nothing; its law is that of merging: neighbours are joined, the best-ranked pair first and of equal ones the
leftmost, until no pair makes a piece. A path keeps that law if each two adjoining pieces do, that is if merging the text of the two
gives back the two: the first merge across a border of the path would come as well with only the two pieces beside it. So a path
scores zero while all its neighbours keep the law and is out otherwise, and at each position exactly one last piece is left. What
two pieces do is found once by merging them and remembered, up to ``PAIRS``.

If no piece has the space mark after another character, no piece crosses the start of a word, so the segmentation of a text is
that of its words one after another. Words are segmented once and remembered up to ``CACHE``; the texts become arrays by lookup.
Models with longer pieces have every text segmented whole.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import slices

SPACE = "▁"
#: Added to the least score for a character that is no piece.
UNKNOWN = -10.0
CACHE = 300_000
PAIRS = 300_000


@dataclass(frozen=True)
class Pieces:
    """A model's pieces; ``kinds`` as in model files: 1 normal, 2 unknown, 3 control, 4 user-defined, 5 unused, 6 byte."""

    names: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]
    dummy_prefix: bool = True
    merges: bool = False

    @classmethod
    def read(cls, path: str) -> Pieces:
        """Of a model without normalisation rules; others would need their tables."""
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("models that normalise text are not supported")
        kinds, merges = tuple(p.type for p in model.pieces), model.trainer_spec.model_type == 2
        if model.trainer_spec.model_type not in (1, 2):
            raise ValueError("only unigram and BPE models are supported")
        if merges and {4, 5} & set(kinds):
            raise ValueError("BPE models with user-defined or unused pieces are not supported")
        return cls(tuple(p.piece for p in model.pieces), tuple(p.score for p in model.pieces), kinds, model.normalizer_spec.add_dummy_prefix, merges)

    @property
    def by_words(self) -> bool:
        return self.dummy_prefix and not any(SPACE in name.lstrip(SPACE) for name, kind in zip(self.names, self.kinds, strict=True) if kind in (1, 4))


class Encoder(dict):
    """Maps a word without its space mark to a number; ``at`` and ``size`` of it give its pieces in ``flat``."""

    def __init__(self, pieces: Pieces):
        import ahocorasick

        self.pieces, self.by_words = pieces, pieces.by_words
        self.width = len(pieces.names) + 1
        self.automaton = ahocorasick.Automaton()
        self.bytes, self.unknown, self.ids, self.ranks, self.pairs = {}, 0, {}, {}, {}
        for i, (name, score, kind) in enumerate(zip(pieces.names, pieces.scores, pieces.kinds, strict=True)):
            if kind in (1, 4):
                self.automaton.add_word(name, (i, len(name), score))
                self.ids[name], self.ranks[name] = i, -score
            elif kind == 6:
                self.bytes[int(name[3:5], 16)] = i
            elif kind == 2:
                self.unknown = i
        self.automaton.make_automaton()
        self.least = min((s for s, k in zip(pieces.scores, pieces.kinds, strict=True) if k in (1, 4)), default=0.0) + UNKNOWN
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.flat, self.at, self.size = array("i"), array("q"), array("i")

    def segment(self, text: str) -> list[int]:
        """The pieces of a text with its space marks."""
        return self._lawful(text) if self.pieces.merges else self._best(text)

    def _lawful(self, text: str) -> list[int]:
        """The one path whose neighbours all keep the law of merging; a character that is no piece stands alone."""
        n, width, law = len(text), self.width, self.pairs.get
        last, sizes, now = [-1] * (n + 1), [1] * (n + 1), 0
        last[0] = width - 1  # what stands before the first piece
        for at, (piece, size, _) in self.automaton.iter(text):
            at += 1
            if at == now:
                continue  # this position has its last piece
            good = law(last[at - size] * width + piece)
            if good is None:
                good = self._judge(last[at - size], piece, text[at - size - 1 : at - size])
            if good:
                last[at] = piece
                sizes[at] = size
                now = at
        last[0] = -1
        return self._back(text, last, sizes)

    def _judge(self, before: int, piece: int, character: str) -> bool:
        """Whether a piece may follow the one before it, which may be none or an unknown character; remembered for pieces."""
        name = self.pieces.names[piece]
        if before < 0:
            return self._side_by_side(character, name)
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        good = self.pairs[before * self.width + piece] = self._side_by_side("" if before == self.width - 1 else self.pieces.names[before], name)
        return good

    def _side_by_side(self, left: str, right: str) -> bool:
        """Whether merging leaves these two as they are; an empty one is no piece."""
        return self._merged(left + right) == [x for x in (left, right) if x]

    def _merged(self, text: str) -> list[str]:
        """By merges. A symbol is known by where it begins; ``end`` is 0 for those that another has taken in."""
        n, rank = len(text), self.ranks.get
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(text[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, stop = heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue  # one of the two has changed since
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := rank(text[i : end[stop]])) is not None:
                    heappush(heap, (r, i, end[stop]))
            if (h := before[i]) >= 0 and (r := rank(text[h:stop])) is not None:
                heappush(heap, (r, h, stop))
        return [text[i : end[i]] for i in range(n) if end[i]]

    def _best(self, text: str) -> list[int]:
        """By the largest sum of scores. Of equal sums the one with the longest last piece is taken, and so on to the front."""
        n, least = len(text), self.least
        best, pieces, sizes = [-np.inf] * (n + 1), [-1] * (n + 1), [1] * (n + 1)
        best[0], now, known = 0.0, 0, True
        for last, (piece, size, score) in self.automaton.iter(text):
            if last >= now:
                # position now is settled, and so are those after it at which no piece ends
                if not known and best[now - 1] + least > best[now]:
                    best[now], pieces[now], sizes[now] = best[now - 1] + least, -1, 1
                for end in range(now + 1, last + 1):
                    best[end] = best[end - 1] + least
                now, known = last + 1, False
            total = best[now - size] + score
            if total > best[now] or total == best[now] and size > sizes[now]:
                best[now], pieces[now], sizes[now] = total, piece, size
            known = known or size == 1
        if not known and best[now - 1] + least > best[now]:
            pieces[now], sizes[now] = -1, 1
        return self._back(text, pieces, sizes)

    def _back(self, text: str, pieces: list[int], sizes: list[int]) -> list[int]:
        """The path from its end: the piece that ends at each position, -1 for a single unknown character."""
        out, end = [], len(text)
        while end:
            piece, size = pieces[end], sizes[end]
            if piece >= 0:
                out.append(piece)
            elif self.bytes:
                out += [self.bytes[b] for b in reversed(text[end - 1].encode())]
            else:
                out.append(self.unknown)
            end -= size
        return out[::-1]

    def __missing__(self, part: str) -> int:
        self[part] = number = len(self.at)
        ids = self.segment(SPACE + part if self.by_words else part)
        self.at.append(len(self.flat))
        self.size.append(len(ids))
        self.flat.extend(ids)
        return number

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        if len(self) > CACHE:
            self.forget()
        if not self.by_words:
            return np.array(self.segment((SPACE if self.pieces.dummy_prefix else "") + text.replace(" ", SPACE)), np.int32)
        parts = text.replace(SPACE, " ").split(" ")  # the model does not tell them apart
        if "" in parts:
            # a run of spaces belongs to the word after it
            joined, run = [], 0
            for part in parts:
                if part:
                    joined.append(SPACE * run + part)
                    run = 0
                else:
                    run += 1
            parts = joined + [SPACE * (run - 1)] * (run > 0)
        number = np.fromiter(map(self.__getitem__, parts), np.int64, len(parts))
        at, size, flat = np.frombuffer(self.at, np.int64)[number], np.frombuffer(self.size, np.int32)[number].astype(np.int64), np.frombuffer(self.flat, np.int32)
        ends = np.cumsum(size)
        return flat[np.repeat(at - ends + size, size) + np.arange(ends[-1])]


_last: list[tuple[Pieces, Encoder]] = []


def encoder_of(pieces: Pieces) -> Encoder:
    """The encoder of the model, the same for all tasks of a Python worker, with the words and pairs it knows."""
    if not _last or _last[0][0] != pieces:
        _last[:] = [(pieces, Encoder(pieces))]
    return _last[0][1]


class Decoder:
    def __init__(self, pieces: Pieces):
        names = [bytes([int(n[3:5], 16)]) if k == 6 else b"" if k == 3 else "⁇".encode() if k == 2 else n.replace(SPACE, " ").encode() for n, k in zip(pieces.names, pieces.kinds, strict=True)]
        self.data = np.frombuffer(b"".join(names), np.uint8)
        self.size = np.array([len(x) for x in names], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.prefix = pieces.dummy_prefix

    def decode(self, ids: np.ndarray) -> str:
        if not len(ids):
            return ""
        size = self.size[ids]
        ends = np.cumsum(size)
        text = self.data[np.repeat(self.at[ids] - ends + size, size) + np.arange(ends[-1])].tobytes().decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def _with(docs: DataFrame, keep: list[str], *added: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema] + list(added))


def encode(docs: DataFrame, pieces: Pieces, text: str = "text", ids: str = "ids", keep: list[str] | None = None, exact: str | None = None) -> DataFrame:
    """``docs`` with the piece ids of its text; a column of that name gives way. Null stays null, an empty text has no pieces.

    ``keep``: the other columns of the result, all where it is not given. ``exact`` names a further column: whether the ids decode
    to the text itself, found in the same pass; true for null. A text with the space mark itself in it decodes to one with spaces
    instead; any other is got back exactly. Repeated rows are encoded one by one; no rows give no rows.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (ids, exact)]
    shared = docs.sparkSession.sparkContext.broadcast(pieces)  # as large as the model file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = encoder_of(shared.value), Decoder(shared.value)
        for batch in batches:
            for begin, part in slices(batch.column("_text")):
                found, same = [], []
                for x in part:
                    own = x.as_py()
                    found.append(None if own is None else encoder.encode(own))
                    if exact:
                        same.append(own is None or decoder.decode(found[-1]) == own)
                offsets = np.cumsum([0] + [0 if x is None else len(x) for x in found]).astype(np.int32)
                null = pa.array([x is None for x in found] + [False])
                values = pa.array(np.concatenate([np.zeros(0, np.int32), *(x for x in found if x is not None)]))
                columns = [pa.ListArray.from_arrays(pa.array(offsets, mask=null.to_numpy(zero_copy_only=False)), values)]
                if exact:
                    columns.append(pa.array(same, pa.bool_()))
                yield pa.record_batch([*(batch.column(f"_{i}").slice(begin, len(part)) for i in range(len(keep))), *columns], names=[*keep, ids, *([exact] if exact else [])])

    schema = _with(docs, keep, f"`{ids}` array<int>", *([f"`{exact}` boolean"] if exact else []))
    return docs.select(F.col(f"`{text}`").alias("_text"), *(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(keep))).mapInArrow(run, schema)


def decode(docs: DataFrame, pieces: Pieces, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``docs`` with the text that its ids stand for; a column of that name gives way. Null stays null, no ids give an empty text.

    Bytes that are no UTF-8 become U+FFFD, control pieces nothing. An id that is null or not of the model is an error.
    """
    keep = [c for c in docs.columns if c != text]
    schema = _with(docs, keep, f"`{text}` string")
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in batches:
            for begin in range(0, len(batch), 512):
                part = batch.slice(begin, 512)
                out = [decoder.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else None for x in part.column(ids)]
                yield pa.record_batch([*(part.column(c) for c in keep), pa.array(out, pa.string())], names=[*keep, text])

    return docs.select(*keep).mapInArrow(run, schema)
