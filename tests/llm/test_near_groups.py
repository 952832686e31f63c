"""Large groups of near copies, most of them too far from any one of the group."""

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest

from voltmill.llm import copies, simhash

from test_copies import SCHEMA, brute


def changed(n, length, most, seed=3):
    """One text of ``length`` words with up to ``most`` of them changed, ``n`` times, and as many texts that share most of it."""
    r = np.random.default_rng(seed)
    base = [f"b{i}" for i in range(length)]
    rows = []
    for i in range(n):
        w = list(base)
        for at in r.integers(0, length, int(r.integers(1, most))):
            w[at] = f"x{r.integers(0, 4)}"
        rows += [(i, " ".join(w), "s"), (5000 + i, " ".join(base[: length * 3 // 4] + [f"y{i}z{k}" for k in range(length // 4)]), "s")]
    return rows


@pytest.mark.parametrize(("length", "most"), [(60, 6), (300, 16), (900, 40)])
def test_links_what_all_pairs_link(spark, length, most):
    rows = changed(70, length, most)
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted((x.doc_id is None, x.doc_id or 0) for x in kept.collect()) == brute(rows)


def test_a_group_of_near_copies_leaves_a_forest_and_not_its_pairs():
    """Where every node has a root of its own, a key of n small sets gives n - 1 links at most."""
    texts = pa.array([x[1] for x in changed(150, 60, 6) if x[0] < 5000])
    signed = next(copies._signatures(iter([pa.record_batch([pa.array(np.arange(len(texts))), texts], names=["node", "text"])])))
    sizes = [len(x.as_py()) // 8 for x in signed.column("set")]
    rows = pa.record_batch([pa.array(np.zeros(150, np.int64)), signed.column("node"), pa.array(sizes, pa.int32()), signed.column("node"), *signed.columns[1:]], names=["key", "node", "size", "root", "bitmap", "set"])
    found = next(copies._open_pairs(iter([rows])))
    assert 20 < found.num_rows < 150 and all(found.column("known").to_pylist())


def test_the_stage_links_by_the_pivot_tables_first(spark, monkeypatch):
    called = []
    links = simhash.links
    monkeypatch.setattr(simhash, "links", lambda *a: called.append(1) or links(*a))
    corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(changed(5, 60, 4), SCHEMA), "").count()
    assert called


def test_larger_sets_leave_stars_and_not_their_pairs():
    """A key of n sets that do not travel whole gives n - 1 rows at most, whatever may be similar there."""
    texts = pa.array([x[1] for x in changed(150, 300, 16) if x[0] < 5000])
    signed = next(copies._signatures(iter([pa.record_batch([pa.array(np.arange(len(texts))), texts], names=["node", "text"])])))
    sizes = [len(copies.shingles(texts.slice(i, 1))[0]) for i in range(len(texts))]
    rows = pa.record_batch([pa.array(np.zeros(150, np.int64)), signed.column("node"), pa.array(sizes, pa.int32()), signed.column("node"), *signed.columns[1:]], names=["key", "node", "size", "root", "bitmap", "set"])
    found = next(copies._open_pairs(iter([rows])))
    assert 20 < found.num_rows < 150 and not any(found.column("known").to_pylist())


def test_a_group_in_many_blocks_is_linked_alike(spark, monkeypatch):
    rows = changed(60, 300, 30)
    monkeypatch.setattr(copies, "BLOCK", 9)
    kept = copies.keep_one(spark.createDataFrame(rows, SCHEMA))
    assert sorted((x.doc_id is None, x.doc_id or 0) for x in kept.collect()) == brute(rows)
