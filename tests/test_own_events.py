"""Queries on events made here, against their SQL."""

import datetime

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from voltmill import catalogue

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"


@pytest.fixture
def both(spark, tmp_path):
    """Rows of a query and of its SQL on the events (seconds, unit, channel, value), as sorted tuples."""

    def run(name, events):
        at = datetime.datetime(2024, 1, 1)
        rows = [(i, at + datetime.timedelta(seconds=float(s)), u, c, v) for i, (s, u, c, v) in enumerate(events)]
        spark.createDataFrame(rows, SCHEMA).write.mode("overwrite").parquet(f"{tmp_path}/events.parquet")
        con = duckdb.connect()
        con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
        rel = con.sql(catalogue.ORACLES[name])
        found = catalogue.QUERIES[name](spark, str(tmp_path)).select(*rel.columns)
        return sorted(map(tuple, found.collect()), key=repr), sorted(rel.fetchall(), key=repr)

    return run


def made(n, units, days=3.0, seed=5):
    r = np.random.default_rng(seed)
    return [(float(s), int(u), str(c), float(v)) for s, u, c, v in zip(r.integers(0, int(days * 86400), n), r.integers(0, units, n), r.choice(["purchase", "view", "click"], n), r.integers(0, 400, n) / 8, strict=True)]


def test_trend_of_null_values(both):
    events = made(300, 4)
    events[::7] = [(s, u, c, None) for s, u, c, _ in events[::7]]
    mine, other = both("trend_split", events)
    assert mine == other


PAIRS = ["crosscorrelogram", "cc_dip_score", "joint_activity", "bhatta_hist", "pair_suggestion", "drift_suggestion"]


@pytest.mark.parametrize("name", PAIRS)
def test_pairs_over_many_tiles_and_chunks(both, monkeypatch, name):
    """Units far apart in time, units that meet in few bins, null units and times, and tiles of some units."""
    from voltmill.operators import pairs  # the pairs of all units by tiles

    for what, n in (("UNITS", 7), ("ROWS", 60)):
        monkeypatch.setattr(pairs, what, n)
    events = made(900, 40, days=25.0)
    events += [(s + 86400 * 200, u + 30, c, v) for s, u, c, v in made(200, 25, days=8.0, seed=6)]
    events += [(s + 86400 * 123, u + 20, c, v) for s, u, c, v in made(400, 25, days=10.0, seed=7)]  # bins on both sides of a chunk's end
    events += [(86400.0 * d + 30000 * k, 300 + u, "view", 1.0) for u in (0, 1) for d in range(10) for k in (0, 1)]
    events += [(86400 * 90.0, 99, "view", 1.0), (86400.0 * 3, None, "view", 1.0)]
    mine, other = both(name, events)
    assert len(mine) == len(other) > 0
    assert all(x == pytest.approx(y, abs=2e-6) for x, y in zip(mine, other, strict=True))


def test_pairs_of_no_events(both):
    assert both("crosscorrelogram", []) == ([], [])


def test_tiles_travel_packed(spark, monkeypatch):
    """Each two tiles meet in a partition of their own, and a row that goes there takes a few bytes."""
    from voltmill.operators import pairs

    monkeypatch.setattr(pairs, "UNITS", 250)
    table = spark.range(200_000).select((F.col("id") % 2000).alias("unit"), F.expr("id div 2000 * 2").alias("at"), F.lit(1.0).alias("value"))
    met = pairs.tiles(table).select("met", "tile", F.length("rows").alias("size"), F.spark_partition_id().alias("part")).collect()
    assert len({r.met for r in met}) == len({r.part for r in met}) == 36 and len(met) == 64
    assert sum(r.size for r in met) < 8 * 200_000


def _taken(df, path):
    df.write.parquet(f"{path}")
    return sum(f.stat().st_size for f in path.glob("*.parquet"))


def test_shares_of_many_pairs_take_little_room(spark, tmp_path, monkeypatch):
    """Rounded scores by bands: the same rows as without, and fewer bytes than numbers in full."""
    from voltmill.operators import pairs

    monkeypatch.setattr(pairs, "TILES", 1)
    r = np.random.default_rng(4)
    n = r.poisson(2.2, (1600, 30))
    share = np.sqrt(n / n.sum(axis=1, keepdims=True))
    p = spark.createDataFrame([(int(u), int(d), float(share[u, d])) for u, d in zip(*np.nonzero(n), strict=True)], "unit long, at long, value double")
    scores = lambda band: pairs.pairs(p, lambda a, b: (a @ b.T)[None], ["bhatta"], kind="double", band=band).withColumn("bhatta", F.round("bhatta", 6))
    found = scores(1 / 256)
    assert found.count() == 1600 * 1599 // 2 and found.exceptAll(scores(None)).isEmpty()
    assert _taken(found, tmp_path / "out") < 6 * 1600 * 1599 // 2


def test_counts_of_many_pairs_take_little_room(spark, tmp_path, monkeypatch):
    """The counts of a correlogram's row, its lag and its units take little more than the five bits of a common count."""
    from voltmill.operators import pairs

    monkeypatch.setattr(pairs, "TILES", 1)
    r = np.random.default_rng(4)
    found = r.random((700, 120)) < 0.42
    found[0] = True  # a unit whose counts are seldom ones
    b = spark.createDataFrame([(int(u), int(k)) for u, k in zip(*np.nonzero(found), strict=True)], "unit long, bin long")
    cc = pairs.correlograms(b, 8)
    taken = _taken(cc, tmp_path / "out")
    n = cc.agg(F.count("n"), F.sum("n"), F.countDistinct("i", "j"), F.sum(F.col("n") * F.col("lag") * (F.col("i") + 2 * F.col("j")))).first()
    x = found.astype(np.int64)
    each = [np.triu(x[:, max(0, -k) : 120 - max(0, k)] @ x[:, max(0, k) : 120 - max(0, -k)].T, 1) for k in range(-8, 9)]
    i, j = np.arange(700)[:, None], np.arange(700)
    assert tuple(n) == (sum((e > 0).sum() for e in each), sum(e.sum() for e in each), 700 * 699 // 2, sum((k * e * (i + 2 * j)).sum() for k, e in zip(range(-8, 9), each, strict=True)))
    assert taken < 0.74 * n[0]


@pytest.mark.parametrize("name", ["trigger_median_artefact", "artefact_subtract", "raster_repeats"])
def test_around_triggers(both, name):
    """Lags on the edges, equal times, null values and channels, a channel without values, and an even number of values."""
    events = [(600.0 * k, k % 5, c, float(k * k % 37) / 4) for k in range(30) for c in ("purchase", "view", "purchase")]
    events += made(500, 9, days=0.3) + [(100.0, 1, None, 4.0), (700.0, 1, "view", None), (50.0, 1, "dull", None), (-5000.0, 1, "purchase", -7.5)]
    mine, other = both(name, events)
    assert len(mine) == len(other) > 0
    assert all(x == pytest.approx(y, abs=2e-6) for x, y in zip(mine, other, strict=True))


def test_an_artefact_makes_no_pairs(spark):
    """A thousand events and a thousand triggers at one time are counted, not paired."""
    from voltmill.operators import joins

    e = spark.range(1000).select("id", (F.col("id") % 2 + 7).alias("t"))
    found = joins.lag_counts(e, e, [0, 1, 2])
    assert {(r.t, *r.counts) for r in found.collect()} == {(7, 500, 0), (8, 500, 500)}
    assert " Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_a_raster_over_many_blocks(both, monkeypatch):
    """Blocks and slices of few events, slices that an event meets in part or not at all, more tasks than one, and no event or trigger at all."""
    from voltmill.operators import joins

    for what, n in (("BLOCK", 7), ("SLICE", 3), ("TASK", 50)):
        monkeypatch.setattr(joins, what, n)
    events = [(600.0 * k, k % 5, c, 1.0) for k in range(30) for c in ("purchase", "view", "purchase")]
    events += made(400, 9, days=0.2) + [(3600.0, 1, "purchase", 1.0)] * 20 + [(0.0, 1, "view", None), (7200.0, 1, None, 1.0), (-3600.0, 1, "purchase", 1.0)]
    mine, other = both("raster_repeats", events)
    assert mine == other and len(mine) > 5000
    assert both("raster_repeats", []) == ([], [])
    assert both("raster_repeats", [(5.0, 1, "view", 1.0)]) == ([], [])


def test_a_raster_takes_little_room(spark, tmp_path):
    """A million pairs of events at equal times, written as Parquet, take less than half a byte each, wherever the copies stand in the input."""
    r = np.random.default_rng(3)
    base = [(datetime.datetime(2024, 1, 1) + datetime.timedelta(microseconds=int(us)), c) for us, c in zip(r.integers(0, 4 * 3600 * 10**6, 150), r.choice(["purchase", "view"], 150), strict=True)]
    rows = [(150 * k + i, t, 1, c, 1.0) for k in range(40) for i, (t, c) in enumerate(base)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/events.parquet")
    catalogue.QUERIES["raster_repeats"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    total = "SELECT count(*), sum(hash(repeat, event_id, lag)::HUGEINT) FROM "
    found = con.sql(f"{total} '{tmp_path}/out/*.parquet'").fetchall()
    assert found == con.sql(f"{total} ({catalogue.ORACLES['raster_repeats']})").fetchall()
    assert found[0][0] > 1_000_000
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < found[0][0] / 2
