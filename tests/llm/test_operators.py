"""Each corpus operator on a small fixture with nulls, empty and long texts, ties and repeated rows, against a brute-force version."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltmill.llm import ann, components, lm, mixing, pieces, pii, quality, sharding, simhash, substring, toxicity
from voltmill.llm.queries import MODEL, QUERIES

WORDS = "the of and cat dog runs fast slow over river bridge house tree green blue red one two three four five six seven".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, held_out int, score int, spans int, ids int, fp int, k1 int, cell int"


def text(seed, n):
    r = np.random.default_rng(seed)
    return " ".join(r.choice(WORDS, n))


@pytest.fixture(scope="module")
def rows():
    shared = text(99, 60)
    out = [(i, f"{text(i, 20 + 3 * i)} {shared if i % 5 == 0 else ''}", "en", f"s{i % 4}") for i in range(40)]
    out += [(100, None, None, None), (101, "", "en", "s0"), (102, "\n\t ", "en", None), (103, text(7, 3000), "en", "s1"), (104, out[3][1], "en", "s0"), (104, out[3][1], "en", "s0"), (None, "é ü 日本 a@b.co 192.168.0.1", "en", "s2"), (105, "The  the\nTHE the", "de", "s3"), (106, "one", "de", "s3")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, len(r[1]) if r[1] else None, *[0] * 7) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_substring(docs, rows, none):
    c = Counter(tuple(w[i : i + 35]) for r in rows for w in [split(r[1])] for i in range(len(w) - 34))
    want = []
    for r in rows:
        w = split(r[1])
        gone = {j for i in range(len(w) - 34) if c[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        want.append((r[0], len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring.remove_repeated_passages(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and any(x[2] for x in want)
    assert substring.remove_repeated_passages(none).count() == 0


def test_cover_has_every_difference():
    with pytest.raises(ValueError):
        substring.stripped_texts(None, period=21, cover=(0, 1, 2))


def test_simhash(docs, rows, none):
    fp = [simhash.fingerprint((r[1] or "").encode()) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 2:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in group}
    want = sorted(((r[0], f, least[g]) for r, f, g in zip(rows, fp, group, strict=True)), key=repr)
    got = sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=repr)
    assert got == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(group))
    assert simhash.near_duplicates(none).count() == 0


def test_simhash_large_groups_are_exact(spark):
    r = np.random.default_rng(5)
    near = {int(x) for x in r.integers(0, 1 << 20, 300)} | {1 << 40, (1 << 40) + 1}
    fps = spark.createDataFrame([(x,) for x in near], "fp long")
    small, large = ({(x.node, x.root) for x in components.components(simhash.links(fps, n)).collect()} for n in (4096, 4))
    assert small == large


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(60, 61), (61, 60), (70, 70), (None, 1)], "a long, b long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(51)}, 60: 60, 61: 60}


def test_pii(docs, rows, none):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"}
    for r, found in zip(rows, pii.find_pii(docs).collect(), strict=True):
        want = [(k, m.start(), m.end()) for k, p in patterns.items() for m in re.finditer(p, r[1] or "")]
        assert [(s.kind, s.start, s.end) for s in found.spans] == want
    assert pii.redact(docs).columns == docs.columns and pii.redact(none).count() == 0


@pytest.mark.parametrize("t, kinds", [("4111 1111 1111 1111", ["card"]), ("4111 1111 1111 1112", []), ("GB82 WEST 1234 5698 7654 32", ["iban"]), ("GB82 WEST 1234 5698 7654 33", []), ("256.1.1.1 0001.2.3.4", ["ip"]), ("+49 (30) 1234567", ["phone"]), ("+1 2", []), ("123-45-6789", []), ("my ssn 123-45-6789", ["ssn"]), ("a@b.com_x@y.zz", ["email", "email"]), ("1 " * 30000, []), ("x" * 100000, [])])
def test_pii_checks(spark, t, kinds):
    assert [s.kind for s in pii.find_pii(spark.createDataFrame([(t,)], "text string")).first().spans] == kinds


def test_shards(docs, rows, none):
    got = sharding.shard_by_bytes(docs, 5).collect()
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=repr) == sorted(((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows), key=repr)
    for s in {r.shard for r in got}:
        own = sorted((r for r in got if r.shard == s), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
    order = sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text_crc32, r.size, r.shard, r.slot))
    assert [r.shard for r in order] == sorted(r.shard for r in got)
    total, before = sum(r.size for r in got), 0
    for r in order:
        assert r.shard == (2 * before + r.size) * 5 // (2 * total)
        before += r.size
    assert sharding.shard_by_bytes(none).count() == 0


def test_mix(docs, rows, none):
    got = mixing.mix_sources(docs).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(split(r[1]))
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, budget = {}, set(names), 1.5 * sum(sizes.values())
    while free:
        left = budget - sum(target.values())
        over = [s for s in free if left * weight[s] / sum(weight[x] for x in free) > 2 * sizes[s]]
        for s in over or free:
            target[s] = 2.0 * sizes[s] if over else left * weight[s] / sum(weight[x] for x in free)
        free -= set(over or free)
    taken = Counter()
    for r in got:
        assert math.isclose(r.target, target[r.source], abs_tol=1e-6) and r.source_size == sizes[r.source]
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
    largest = max(len(split(r[1])) for r in rows)
    assert all(abs(taken[s] - target[s]) <= largest for s in names)
    out = mixing.take_mix(docs)
    assert out.columns == docs.columns and sum(len(split(r.text)) for r in out.collect()) == sum(taken.values())
    assert mixing.mix_sources(none).count() == 0 and mixing.take_mix(none).count() == 0


def test_quality(docs, rows, none, spark):
    ids = spark.createDataFrame([(1,), (2,), (None,), (2,)], "doc_id long")
    for r, g in zip(sorted(rows, key=repr), sorted(quality.judge(docs, ids).collect(), key=lambda g: next(i for i, r in enumerate(sorted(rows, key=repr)) if r[0] == g.doc_id)), strict=True):
        w = split(r[1])
        c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        again = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in (r[1] or "").split("\n") if split(x)]
        assert (g.n_words, g.word_chars, g.n_dup_lines, g.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(again))
        assert g.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w)) and not (g.kept and g.base_failed)
    assert quality.judge(none, ids).count() == 0


def test_lm(docs, rows, none, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 12)
    tok = [[*(x.encode().lower() for x in split(r[1])), None] for r in rows]
    train = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 != 1 for r in rows]
    c = Counter(x for w, t in zip(tok, train, strict=True) if t for x in w)
    n, v = sum(c.values()), len(c)
    want = sorted((repr(r[0]), not t, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)) for r, w, t in zip(rows, tok, train, strict=True))
    got = lm.score_texts(docs).collect()
    assert sorted((repr(g.doc_id), g.held_out, g.n_tokens, g.n_known, g.train_tokens, round(g.base_score, 6)) for g in got) == want
    assert all(g.score < 0 for g in got) and lm.score_texts(none).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_is_edit_distance():
    terms = ("idiot", "pathetic", "worthless", "scum", "lowei*")
    a = toxicity.Automaton(terms)
    r = np.random.default_rng(4)
    for _ in range(3000):
        word = list(r.choice([t.rstrip("*") for t in terms]))
        for _ in range(r.integers(0, 4)):
            at = int(r.integers(0, len(word) + 1))
            word[at : at + int(r.integers(0, 2))] = list(r.choice(list("abeiot "), int(r.integers(0, 2))))
        word = "".join(word)
        want = 9
        for t in terms:
            base = t.rstrip("*")
            allowed = 0 if len(base) < 5 else 1 if len(base) < 9 else 2
            d = min(distance(word[:n], base) for n in range(len(word) + 1)) if t.endswith("*") else distance(word, base)
            want = min(want, d) if d <= allowed else want
        assert a.errors(word) == want, word


def test_toxicity(spark, none):
    rows = [(i, text(i, 60) + (" you utter blockhead blockhead" if i % 3 == 0 else "")) for i in range(120)]
    docs = spark.createDataFrame([*rows, (900, text(900, 50) + " blokhead"), (901, None), (902, ""), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)] + [(5, None), (None, 1), (7777, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    assert len(got) == 124 and all(got[i].predicted == (i % 3 == 0) for i in range(120)) and all(0 <= r.score <= 1 for r in got.values())
    assert got[900].misspelled == 1 and got[900].score > got[901].score == got[902].score
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns
    assert all(r.score == 0 for r in toxicity.score_toxicity(docs, labels.where("toxic = 5")).collect())
    assert toxicity.score_toxicity(none.select("doc_id", "text"), labels).count() == 0


def test_pieces(docs, rows, none):
    import sentencepiece as sp
    from sentencepiece import sentencepiece_model_pb2 as pb

    p = pieces.Pieces.read(MODEL)
    got = pieces.decode(pieces.encode(docs, p), p)
    assert sorted(got.columns) == sorted([*docs.columns, "decoded"])
    assert all(r.text == r.decoded for r in got.collect()) and pieces.encode(none, p).count() == 0
    m = pb.ModelProto()
    with open(MODEL, "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1
    for x in m.pieces:
        x.score = max(x.score, -40000.0)  # the library adds in single precision
    lib, own = sp.SentencePieceProcessor(model_proto=m.SerializeToString()), pieces.Encoder(pieces.Pieces(p.names, tuple(max(s, -40000.0) for s in p.scores), p.kinds))
    for t in [r[1] for r in rows if r[1]] + ["  a  b ", "日本語 𝄞", "x" * 300]:
        assert own.encode(t).tolist() == lib.encode(t)


def test_ann(spark, none):
    r = np.random.default_rng(8)
    x = r.normal(size=(1500, 24)).astype(np.float32)
    x[1:400:7] = x[1]
    bad = [(2000, None), (2001, [0.0] * 24), (2002, [float("nan")] * 24), (2003, [None] * 24), (2004, [1.0]), (None, [1.0] * 24)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + bad, "vec_id long, embedding array<float>")
    got = ann.nearest(df, F.col("vec_id") % 50 == 0, 5).collect()
    u = x.astype(np.float64)
    hits = 0
    for q in range(0, 1500, 50):
        s = (u * u[q]).sum(1) / (np.sqrt((u * u).sum(1)) * np.sqrt((u[q] ** 2).sum()))
        best = [i for i in np.lexsort((np.arange(1500), -s)) if i != q][:5]
        own = sorted((g for g in got if g.query_id == q), key=lambda g: g.rank)
        assert [g.rank for g in own] == [1, 2, 3, 4, 5] and all(math.isclose(g.score, s[g.vec_id], rel_tol=1e-12) for g in own)
        hits += len({g.vec_id for g in own} & set(best))
    assert hits >= 0.9 * 150
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0


def test_query_columns(spark):
    found = QUERIES["op10_pii"](spark, "/root/testdata/sf0.001").collect()
    assert all(r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest() for r in found)


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf)
        assert now.columns == docs.columns
    last = corpus_pipeline.STAGES[-1][1](spark, now, sf)
    assert {r.doc_id for r in last.collect()} <= {r.doc_id for r in docs.collect()}
    assert sorted((r.doc_id, r.n_pieces) for r in corpus_pipeline.run(spark, sf).collect()) == sorted((r.doc_id, r.n_pieces) for r in last.collect())
