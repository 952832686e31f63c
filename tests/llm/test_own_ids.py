"""Ids against those of the library with the model file as it is, and the query on its whole table."""

import glob

import numpy as np
import pyarrow.parquet as pq
import sentencepiece as sp

from voltmill.llm import pieces
from voltmill.llm.queries import MODEL, QUERIES


def test_ids_are_those_of_the_model_itself():
    lib, own = sp.SentencePieceProcessor(model_file=MODEL), pieces.Encoder(pieces.Pieces.read(MODEL))
    texts = [t for p in glob.glob("/root/testdata/sf0.001/documents.parquet") for t in pq.read_table(p)["text"].to_pylist() if t]
    r = np.random.default_rng(3)
    texts += ["the quick brown", "  a  b ", "a ", " ", "日本語 𝄞", "x" * 3000, "a▁b▁▁c", "\n\n\tif  x:\n", "\x00\x01a\x02", *("".join(r.choice(list("aeinrst  ▁é𝄞"), 200)) for _ in range(50))]
    assert len(texts) > 60
    for t in texts:
        assert own.encode(t).tolist() == lib.encode(t), t[:80]


def test_paths_are_those_of_merging():
    """Over small alphabets and random ranks, where merges overlap and block each other."""
    r = np.random.default_rng(5)
    for _ in range(40):
        names = list(dict.fromkeys([*"ab", *("".join(r.choice(list("ab"), int(r.integers(2, 6)))) for _ in range(12))]))
        rank = r.permutation(len(names))
        own = pieces.Encoder(pieces.Pieces(("<unk>", *names), (0.0, *(-float(x) for x in rank)), (2, *[1] * len(names)), False, True))
        for _ in range(60):
            t = "".join(r.choice(list("abc"), int(r.integers(1, 14)), p=[0.47, 0.47, 0.06]))
            assert own._lawful(t) == [own.ids.get(x, own.unknown) for x in own._merged(t)], (names, rank, t)


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(pieces, "PAIRS", 3)
    monkeypatch.setattr(pieces, "CACHE", 3)
    own, whole = pieces.Encoder(pieces.Pieces.read(MODEL)), sp.SentencePieceProcessor(model_file=MODEL)
    for t in ["the quick brown fox jumps over the lazy dog", "un deux trois", "the quick brown fox"]:
        assert own.encode(t).tolist() == whole.encode(t)


def test_query(spark):
    sf, lib = "/root/testdata/sf0.001", sp.SentencePieceProcessor(model_file=MODEL)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op6_viterbi_pieces"](spark, sf).collect()
    assert len(got) == len(texts) and all(r.round_trip for r in got)
    for r in got:
        assert r.ids == (None if texts[r.doc_id] is None else lib.encode(texts[r.doc_id])) and r.n_pieces in (len(r.ids or []), -1)


def test_kept_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 5, True), (1, "a b", 5, True), (2, None, 6, False), (3, "", 7, False), (4, "x▁y", 8, True)], "doc_id long, text string, ids int, same boolean")
    p = pieces.Pieces.read(MODEL)
    got = pieces.encode(docs, p, keep=["doc_id"], exact="same")
    assert got.columns == ["doc_id", "ids", "same"]
    assert sorted((r.doc_id, r.ids is None, r.same) for r in got.collect()) == [(1, False, True), (1, False, True), (2, True, True), (3, False, True), (4, False, False)]
    assert pieces.encode(docs.limit(0), p, exact="same").count() == 0
