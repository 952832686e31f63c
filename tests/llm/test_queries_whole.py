"""Every query of this subpackage on whole small tables, against brute force, and each pipeline stage by what it does to its documents."""

import math
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from voltmill.llm import copies, mixing, pii, quality, sharding, simhash, tokens, toxicity
from voltmill.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def run(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    return {r.doc_id: r for r in rows}, rows


def test_op1(spark):
    rows = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    ids = np.array(sorted(rows))
    x = np.array([rows[i] for i in ids])
    got = defaultdict(list)
    for r in sorted(QUERIES["op1_adaptive_scan"](spark, SF).collect(), key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(got) == {int(i) for i in ids if i % 50 == 0}
    hits = 0
    for q, found in got.items():
        s = (x * rows[q]).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((rows[q] ** 2).sum()))
        best = [int(ids[i]) for i in np.lexsort((ids, -s)) if ids[i] != q][:5]
        assert [f[0] for f in found] == [1, 2, 3, 4, 5] and all(math.isclose(f[2], s[np.searchsorted(ids, f[1])], rel_tol=1e-12) for f in found)
        hits += len(set(best) & {f[1] for f in found})
    assert hits >= 0.9 * 5 * len(got)


def test_op2(spark, docs):
    words = {i: split(d.text) for i, d in docs.items()}
    c = Counter(tuple(w[k : k + 35]) for w in words.values() for k in range(len(w) - 34))
    got, _ = run(spark, "op2_difference_cover")
    import hashlib

    for i, w in words.items():
        gone = {j for k in range(len(w) - 34) if c[tuple(w[k : k + 35])] > 1 for j in range(k, k + 35)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())


def test_op3(spark, docs):
    lower = lambda t: [x.encode().lower() for x in split(t)] + [None]
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in docs}
    c = Counter(x for i, d in docs.items() if not held[i] for x in lower(d.text))
    n, v = sum(c.values()), len(c)
    got, rows = run(spark, "op3_maxent_lm")
    assert len(rows) == len(docs)
    for i, d in docs.items():
        t = lower(d.text)
        base = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t)
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (held[i], len(t), sum(c[x] > 0 for x in t), n)
        assert math.isclose(got[i].base_score, base, rel_tol=1e-9) and got[i].score < 0
    per_token = lambda f: sum(f(r) for r in rows if r.held_out) / sum(r.n_tokens for r in rows if r.held_out)
    assert per_token(lambda r: r.score) > per_token(lambda r: r.base_score)


def test_op4(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op4_levenshtein_toxicity"](spark, sf).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p for y, p in held if y == 0) <= 0.05 * len(held)
    learned = [(labels[r.doc_id], r.predicted) for r in rows if not r.held_out and r.doc_id in labels]
    assert sum(p for y, p in learned if y) >= 0.6 * sum(y for y, _ in learned)  # few labels, and a term needs four toxic documents


def test_toxic_windows():
    quoted = lambda text, cues=frozenset(): toxicity.Reader(("blockhead",), cues).features(text)
    assert quoted("you blockhead") == [1, 0, 0, 0]
    assert quoted('he "blockhead" went') == [0, 1, 0, 0] and quoted("he said blockhead") == [0, 1, 0, 0]
    assert quoted("you blokhead") == [0, 0, 1, 0] and quoted("the word blokhead") == [0, 0, 0, 1]
    assert quoted("said " + "x " * toxicity.WINDOW + "blockhead") == [1, 0, 0, 0]  # the window ends before it
    assert quoted("glossary of blockhead", frozenset({"glossary"})) == [0, 1, 0, 0]
    assert toxicity.Reader(("blockhead",)).beside("near blockhead here") == {"near", "here"}


def test_terms_of_any_length_and_cues_are_learned(spark):
    long = "x" * 60
    rows = [(f"you oaf {long} k{i}", 1) for i in range(8)] + [(f"glossary entry oaf k{i}", 0) for i in range(0)] + [(f"plain words k{i}", 0) for i in range(40)]
    fit = spark.createDataFrame(rows, "text string, toxic int")
    terms = toxicity.learn_lexicon(fit)
    assert "oaf" in terms and any(t.startswith("x" * 8) for t in terms)
    many = spark.createDataFrame([(" ".join(f"w{k}q" for k in range(3000)), 1)] * 4 + [("calm", 0)] * 4, "text string, toxic int")
    found = toxicity.Automaton(toxicity.learn_lexicon(many))
    assert all(found.errors(f"w{k}q") < 9 for k in range(0, 3000, 7))
    cued = spark.createDataFrame([("an oaf", 1)] * 5 + [("glossary: an oaf", 0)] * 9, "text string, toxic int")
    assert toxicity.learn_cues(cued, ("oaf",)) == {"glossary"}


def test_automaton_forgets(monkeypatch):
    monkeypatch.setattr(toxicity, "STATES", 5)
    a = toxicity.Automaton(("idiot", "pathetic"))
    assert [a.errors(w) for w in ("idiot", "idoit", "idit", "pathetik", "idiot")] == [0, 9, 1, 1, 0]


def test_repeated_rows_and_clashing_columns_of_toxicity(spark):
    rows = [(i, f"w{i} calm" + (" blockhead" if i % 2 else ""), "kept", 7.0) for i in range(60)] + [(1, "w1 calm blockhead", "kept", 7.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, predicted string, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    left = toxicity.drop_toxic(docs, labels)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == list(range(0, 60, 2))
    assert all(r.predicted == "kept" and r.score == 7.0 for r in left.collect())


def brute_fingerprint(t):
    w = [x.encode().lower() for x in split(t)]
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def test_op5(spark, docs):
    got, rows = run(spark, "op5_simhash_pivots")
    fp = {i: brute_fingerprint(d.text) for i, d in docs.items()}
    group = {i: i for i in docs}
    ids = sorted(docs)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (fp[i] ^ fp[j]).bit_count() <= 2:
                a, b = group[i], group[j]
                group = {x: min(a, b) if g in (a, b) else g for x, g in group.items()}
    assert {i: (got[i].fingerprint, got[i].component_id) for i in ids} == {i: (f"{fp[i]:016x}", group[i]) for i in ids}


def test_a_large_key_is_cut_and_no_link_is_lost(spark):
    r = np.random.default_rng(3)
    fps = {0xABCD << 48 | 0x1234 << 16 | int(a) << 32 | int(b) for a, b in r.integers(0, 1 << 10, (400, 2))}
    fps |= {x ^ (1 << int(r.integers(0, 64))) ^ (1 << int(r.integers(0, 64))) for x in list(fps)[:40]}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    group = {x: x for x in fps}
    for x in fps:
        for y in fps:
            if x < y and (x ^ y).bit_count() <= 2 and group[x] != group[y]:
                a, b = group[x], group[y]
                group = {k: a if g == b else g for k, g in group.items()}
    want = {frozenset(k for k, g in group.items() if g == v) for v in set(group.values())}
    for large in (4096, 8):
        parent = {x: x for x in fps}

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for e in simhash.links(frame, large).collect():
            parent[find(e.a % (1 << 64))] = find(e.b % (1 << 64))
        assert {frozenset(x for x in fps if find(x) == v) for v in {find(x) for x in fps}} == want


def test_op7(spark, docs):
    got, rows = run(spark, "op7_byte_shards")
    size = {i: len((d.text or "").encode()) + 8 for i, d in docs.items()}
    total, before = sum(size.values()), 0
    for i in sorted(docs):
        r = got[i]
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (size[i], zlib.crc32((docs[i].text or "").encode()), "bytes", None)
        assert r.shard == (2 * before + size[i]) * 24 // (2 * total)
        before += size[i]
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_written_shards(spark, tmp_path):
    rows = [(i % 7, "x" * (i % 5) if i % 3 else None, i) for i in range(60)] + [(3, "same", 100), (3, "same", 101), (None, "n", 102)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    sharding.write_shards(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    key = lambda r: (str(r.doc_id), str(r.text))
    assert sorted(map(key, back)) == sorted((str(a), str(b)) for a, b, _ in rows)
    want = Counter((r.shard, r.slot) for r in sharding.shard_by_bytes(docs, 4).collect())
    assert Counter((r.shard, r.slot) for r in back) == want and max(want.values()) == 1


def test_op8(spark, docs):
    got, rows = run(spark, "op8_hash_mix")
    size = {i: len(split(d.text)) for i, d in docs.items()}
    of = defaultdict(int)
    for i, d in docs.items():
        of[d.source] += size[i]
    taken = defaultdict(int)
    for i, r in got.items():
        assert r.size == size[i] and r.source_size == of[docs[i].source] and r.taken in (0, r.size, 2 * r.size)
        taken[docs[i].source, r.target] += r.taken
    largest = max(size.values())
    assert len(taken) == len(of) and all(abs(t - target) <= largest and target <= 2 * of[s] + 1e-6 for (s, target), t in taken.items())
    again, _ = run(spark, "op8_hash_mix")
    assert again == got


def buckets(text):
    w = tokens.words(pa.array([text], pa.string()))
    one = [int(h) for h in w.hashes(lower=True)]
    pair = [int(tokens.window_hashes(np.array(one[i : i + 2], np.uint64), np.array([0]), 2)[0]) for i in range(len(one) - 1)]
    return [h % quality.BUCKETS for h in one + pair]


def test_op9(spark, docs):
    got, _ = run(spark, "op9_target_ratio")
    trusted = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    found = {i: buckets(d.text or "") for i, d in docs.items()}
    raw, target = (Counter(b for i in some for b in found[i]) for some in (docs, [i for i in docs if i in trusted]))
    all_raw, all_target = sum(raw.values()) + 0.5 * quality.BUCKETS, sum(target.values())
    share = lambda b: (raw[b] + 0.5) / all_raw
    ratio = lambda b: math.log((target[b] + quality.PRIOR * share(b)) / (all_target + quality.PRIOR)) - math.log(share(b))
    for i, d in docs.items():
        w = split(d.text)
        c = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        again = {j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in range(k, k + 3)}
        lines = [x for x in (d.text or "").split("\n") if split(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum((d.text or "").count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(again))
        score = sum(map(ratio, found[i])) / max(1, len(found[i]))
        assert math.isclose(r.score, score, abs_tol=1e-9)
        assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w)) and r.kept == (not r.base_failed and r.score >= quality.THRESHOLD)


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").select("doc_id")
    whole = quality.log_ratios(docs, ids)
    monkeypatch.setattr(quality.bloom, "build", lambda keys, n: np.full(4, ~np.uint64(0)))
    assert np.array_equal(whole, quality.log_ratios(docs, ids))


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage gets and leaves, over the smallest tables."""
    now, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        left = corpus_pipeline.materialise(stage(spark, now, SF))
        out.append((now, left))
        now = left
    return out


def test_stage_toxicity(spark, stages):
    given, left = stages[0]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    bad = {r.doc_id for r in toxicity.score_toxicity(given, labels).where("predicted = 1").collect()}
    rows = {r.doc_id: r for r in given.collect()}
    assert {r.doc_id: r for r in left.collect()} == {i: r for i, r in rows.items() if i not in bad}


def shingles(t):
    w = (t or "").encode().lower().decode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stage_near_duplicates(stages):
    given, left = stages[1]
    rows = {r.doc_id: r for r in given.collect()}
    sets = {i: shingles(r.text) for i, r in rows.items()}
    group = {i: i for i in rows}
    ids = sorted(rows)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if (not a and not b) or (a | b and len(a & b) >= 0.8 * len(a | b)):
                x, y = group[i], group[j]
                group = {n: min(x, y) if g in (x, y) else g for n, g in group.items()}
    assert {r.doc_id: r for r in left.collect()} == {i: rows[i] for i in set(group.values())}
    assert copies.WIDTH == 5


def test_stage_personal_data(stages):
    given, left = stages[2]
    spans = {r.doc_id: r.spans for r in pii.find_pii(given).collect()}
    rows = {r.doc_id: r for r in given.collect()}
    assert left.count() == len(rows)
    for r in left.collect():
        t, at, out = rows[r.doc_id].text, 0, []
        for s in sorted(spans[r.doc_id], key=lambda s: (s.start, s.end, s.kind)):
            if s.start >= at:
                out += [t[at : s.start], f"[{s.kind.upper()}]"]
            at = max(at, s.end)
        want = t and "".join(out) + t[at:]
        assert r.text == want and r.n_chars == (want if want is None else len(want))


def test_stage_mix(stages):
    given, left = stages[3]
    plan = {r.doc_id: (r.taken // r.size if r.size else None) for r in mixing.mix_sources(given).collect()}
    n = Counter(r.doc_id for r in left.collect())
    assert all(times is None or n[i] == times for i, times in plan.items())
    rows = {r.doc_id: r for r in given.collect()}
    assert all(r == rows[r.doc_id] for r in left.collect())


def test_stage_pieces(stages):
    import sentencepiece as sp

    from voltmill.llm.queries import MODEL

    given, left = stages[4]
    lib = sp.SentencePieceProcessor(model_file=MODEL)
    want = Counter((r.doc_id, r.source, tuple(lib.encode(r.text))) for r in given.collect() if r.text is not None)
    got = left.where(F.col("ids").isNotNull()).collect()
    assert Counter((r.doc_id, r.source, tuple(r.ids)) for r in got) == want and all(r.n_pieces == len(r.ids) for r in got)
