"""The language model against a version that goes token by token, and its sums over all words."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voltmill.llm import lm
from voltmill.llm.shared import materialise
from voltmill.llm.tokens import mix

WORDS = [f"{a}{b}" for a in "abcdefgh" for b in ("", "x", "yz", "q")]


@pytest.fixture(scope="module")
def docs(spark):
    r = np.random.default_rng(2)
    rows = []
    for i in range(60):
        w, text = 0, []
        for _ in range(int(r.integers(0, 60))):
            w = int((w * 3 + r.integers(0, 3)) % len(WORDS)) if r.random() < 0.8 else int(r.integers(0, len(WORDS)))
            text.append(WORDS[w] if r.random() < 0.95 else f"new{r.integers(0, 1000)}")
        rows.append((i, " ".join(text)))
    return spark.createDataFrame([*rows, (60, None), (61, ""), (3, rows[3][1])], "doc_id long, text string")


def parts(spark, docs):
    """The vocabulary, the class model and the weights of pairs as dictionaries."""
    plain = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"), lm.held_out("doc_id").alias("held_out"))
    counts = materialise(plain.where(~F.col("held_out")).select("text").mapInArrow(lm._count, "hash long, begin int, n long").groupBy("hash").agg(F.min("begin").alias("begin"), F.sum("n").alias("n")))
    v = lm._vocabulary(counts)
    shared = spark.sparkContext.broadcast(v)
    coded = materialise(plain.mapInArrow(lm._encode(shared), "id long, held_out boolean, row long, words binary, rare binary"))
    train = coded.where(~F.col("held_out")).select("words", F.pmod(F.xxhash64("row"), F.lit(lm.UPDATES)).alias("part"))
    model = lm._train_classes(train, shared, v)
    at, n = lm._unpack(iter(train.select("words").mapInArrow(lm._pairs(shared, 3), lm._PACKED).toArrow().to_batches()))
    key, weight, _ = lm.fit_pairs(v, at >> (lm.BITS + 1), at & (lm.START - 1), n)
    number = {int(h) % 2**64: n for h, n in counts.select("hash", "n").collect()}
    return v, model, dict(zip(key.tolist(), weight.tolist(), strict=True)), number, coded


def key(after, word):
    return int(lm.pair_key(np.array([after]), np.array([word]))[0])


def step(v, m, weights, before, last, after, word, cls, number):
    """log10 of one token's probability."""
    z = m.prior + m.last[last] + m.skip[before] + m.both[m.pair_row(np.array([before]), np.array([last]))[0]]
    p = z[cls] - np.log(np.exp(z - z.max()).sum()) - z.max()
    own = (number + 0.5) / v.mass[cls]
    total = p / math.log(10) + math.log10(own)
    if after >= 0 and word >= 0 and cls < v.own:
        total += weights.get(key(after, lm.START + cls), 0.0) + weights.get(key(after, word), 0.0)
    return total


@pytest.mark.parametrize("frequent, carried", [(lm.FREQUENT, lm.CARRIED), (12, 20), (12, 0)])
def test_scores_token_by_token(spark, docs, monkeypatch, frequent, carried):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    monkeypatch.setattr(lm, "CARRIED", carried)
    v, m, weights, number, coded = parts(spark, docs)
    assert weights
    want = []
    for r in coded.collect():
        word = np.frombuffer(r.words, np.int32)
        rare, total, start, before, last, after = iter(np.frombuffer(r.rare, np.uint64).tolist()), 0.0, v.symbols - 1, v.symbols - 1, v.symbols - 1, lm.START
        for w in word.tolist():
            if w >= 0:
                cls, n, symbol = int(v.cls[w]), int(v.count[w]), int(v.symbol[w])
                beginning = w
            else:
                beginning = -1 - w
                cls, n, symbol = v.own + int(mix(np.array([beginning], np.uint64))[0] % np.uint64(v.other)), number.get(next(rare), 0), -1
            symbol = symbol if symbol >= 0 else v.words + int(mix(np.array([beginning], np.uint64))[0] % np.uint64(v.groups))
            total += step(v, m, weights, before, last, after, w, cls, n)
            before, last, after = last, symbol, w if w >= 0 and cls < v.own else -1
        assert start == v.symbols - 1
        want.append((r.id, round(total, 4)))
    got = [(r.doc_id, round(r.score, 4)) for r in lm.score_texts(docs).collect()]
    assert len(got) == len(want) and all(a[0] == b[0] and abs(a[1] - b[1]) < 2e-3 for a, b in zip(sorted(got), sorted(want), strict=True))


def test_sums_to_one(spark, docs, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 20)
    v, m, weights, number, _ = parts(spark, docs)
    assert math.isclose(v.mass.sum(), sum(n + 0.5 for n in number.values()) + 0.5 * v.other, abs_tol=0.5 * v.own)  # an empty class has 0.5
    for before, last, after in ((v.symbols - 1, v.symbols - 1, lm.START), (0, 1, 0), (2, 0, 3), (5, 4, -1)):
        total = 0.0
        for w in range(len(v.hash)):
            total += 10 ** step(v, m, weights, before, last, after, w, int(v.cls[w]), int(v.count[w]))
        for c in range(v.classes):  # what a class has besides the frequent words
            held = sum(10 ** v.share[w] for w in range(len(v.hash)) if v.cls[w] == c)
            rest = 1 - held if c >= v.own or not held else 0.0
            if rest > 1e-12:
                total += rest * 10 ** step(v, m, weights, before, last, after, -1, c, v.mass[c] - 0.5)
        assert math.isclose(total, 1, abs_tol=2e-4), (before, last, after, total)


def test_learns(spark, docs):
    """Held-out texts are likelier than by word counts alone, and no weight is without a pair that came twice."""
    rows = lm.score_texts(docs).where("held_out and n_tokens > 5").collect()
    assert rows and sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_what_is_gathered_grows_with_the_vocabulary():
    size = lambda d: lm.make_vocabulary(np.arange(1, 9, dtype=np.uint64), np.zeros(8, np.int64), np.arange(1, 9), 36, d, {})
    a, b, c = (size(d) for d in (10**3, 10**5, 10**7))
    assert a.classes < b.classes < c.classes and a.symbols < b.symbols <= c.symbols and a.rows < b.rows


def test_packed_pairs():
    r = np.random.default_rng(1)
    key, n = np.sort(r.choice(1 << 37, 5000, replace=False)), r.integers(1, 1 << 40, 5000)
    got = lm._unpack(iter([lm._pack(key[::-1], n[::-1], key[::-1] % 7), lm._pack(key, n, key % 5), lm._pack(key[:0], n[:0], key[:0])]))
    assert np.array_equal(got[0], key) and np.array_equal(got[1], 2 * n)
    assert len(lm._unpack(iter([]))[0]) == 0


def test_places_find_what_is_in_the_table():
    r = np.random.default_rng(2)
    for size in (0, 1, 2, 700):
        table = np.unique(r.integers(0, 1 << 63, size).astype(np.uint64) * np.uint64(2) + np.uint64(1))
        keys = np.concatenate([table, r.integers(0, 1 << 63, 300).astype(np.uint64) * np.uint64(2), np.array([0, 2**64 - 2], np.uint64)])
        at, known = lm.Places(table).look_up(keys)
        assert known.tolist() == [True] * len(table) + [False] * 302
        assert (table[at[known]] == keys[known]).all()


def test_a_pair_of_symbols_is_asked_once_for_all_batches_of_a_task(monkeypatch):
    """Before, each batch asked the model again."""
    v = lm.make_vocabulary(np.arange(40, dtype=np.uint64) << np.uint64(58), np.zeros(40, np.int64), np.arange(40) * 3 + 9, 3000, 60, {})
    m = lm.Model(np.zeros(v.classes, np.float32), *(np.zeros((n, v.classes), np.float32) for n in (v.symbols, v.symbols, v.rows)))
    asked, classes = [], lm.Model.classes
    monkeypatch.setattr(lm.Model, "classes", lambda self, before, last: asked.append(len(before)) or classes(self, before, last))
    held = type("Held", (), {})
    shared, model = held(), held()
    shared.value, model.value = v, m
    batch = pa.record_batch([pa.array([np.arange(30, dtype=np.int32).tobytes(), np.arange(5, 25, dtype=np.int32).tobytes()], pa.binary())], names=["words"])
    one = lm._gradient(shared, model)(iter([batch]))
    once = sum(asked)
    many = lm._gradient(shared, model)(iter([batch] * 4))
    assert sum(asked) == 2 * once
    assert np.allclose(many, 4 * one)
