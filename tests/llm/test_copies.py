"""Near copies against all pairs of texts."""

import corpus_pipeline
import numpy as np

from voltmill.llm import copies

SCHEMA = "doc_id long, text string, source string"


def jaccard(a, b):
    return len(a & b) / max(1, len(a | b)) if a or b else 1.0


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets, group = [shingles(r[1]) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    return sorted(min((rows[i][0] is None, rows[i][0] or 0) for i in range(len(rows)) if group[i] == g) for g in set(group))


def made():
    r = np.random.default_rng(11)
    words = [f"w{i}" for i in range(3000)]
    passage = " ".join(r.choice(words, 40))
    rows = [(i, " ".join(r.choice(words, int(r.integers(1, 130)))) + f" {passage}" * int(i % 2), "s") for i in range(120)]
    for i in range(120):  # copies with some words changed, from almost equal to well under 0.8
        w = rows[i][1].split()
        for at in r.integers(0, len(w), int(r.integers(0, 5))):
            w[at] = "changed"
        rows.append((1000 + i, " ".join(w).upper(), "s"))
    chain = [f"c{i}" for i in range(80)]  # each near the next, the ends far apart
    rows += [(2000 + k, " ".join(chain[k * 4 : k * 4 + 60]), "s") for k in range(6)]
    return rows + [(3000, None, "s"), (3001, "", "s"), (3002, " \n", None), (3003, "one two", "s"), (3004, "One  TWO", "s"), (None, "one two three", "s"), (3003, "one two", "s")]


def test_keeps_one_of_each_group_of_near_copies(spark):
    rows = made()
    docs = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    for kept in (copies.keep_one(docs), corpus_pipeline.drop_near_duplicates(spark, docs, "")):
        assert kept.columns == docs.columns
        assert sorted((x.doc_id is None, x.doc_id or 0) for x in kept.collect()) == want
    assert len(want) < len(rows) - 40
    assert copies.keep_one(docs.limit(0)).count() == 0


def test_any_order_of_shingles_gives_the_same(spark, monkeypatch):
    rows = made()
    monkeypatch.setattr(copies, "_order", lambda table: (np.arange(copies.COUNTERS) % 7).astype(np.int8))
    assert sorted((x.doc_id is None, x.doc_id or 0) for x in copies.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()) == brute(rows)
