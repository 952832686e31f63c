"""Live windows and state against a batch, and what is done to chunks before a sort."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltmill.functions import kernels
from voltmill.operators import benchmark, metamerge, recording, trains
from voltmill.sources import raw
from voltmill.streaming import windows


def live(spark, tmp_path, frame, use, name, mode="append", files=3):
    """The rows that ``use`` of a stream of ``frame`` leaves, in ``files`` batches in the order of ts."""
    for k, part in enumerate(range(files)):
        rows = frame.withColumn("_p", F.ntile(files).over(__import__("pyspark").sql.Window.orderBy("ts", "event_id"))).where(f"_p = {part + 1}").drop("_p")
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / name / f"{k}"))
    stream = spark.readStream.schema(frame.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    q = use(stream).writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return {tuple(r) for r in spark.sql(f"select * from {name}").collect()}


@pytest.fixture(scope="module")
def events(spark):
    return spark.range(300).selectExpr("id as event_id", "id % 4 as unit", "cast(id % 2 as string) as channel", "timestamp_seconds(id * 11 + (id % 7) * (id % 3)) as ts", "id * 11 + (id % 7) * (id % 3) as t", "cast(id as double) as amp")


def test_sliding_is_the_batch(spark, tmp_path, events):
    use = lambda e: windows.sliding(e, "4 minutes", "1 minute", "1 hour")
    assert live(spark, tmp_path, events, use, "sliding", "complete") == {tuple(r) for r in use(events).collect()}


def test_sessions_are_the_batch(spark, tmp_path, events):
    gaps = events.where("event_id % 40 < 20")
    use = lambda e: windows.sessions(e, "2 minutes", "1 hour")
    assert live(spark, tmp_path, gaps, use, "sessions", "complete") == {tuple(r) for r in use(gaps).collect()}


def test_late_events_are_dropped(spark, tmp_path):
    row = lambda i, s: (i, 0, "c", s, 1.0)
    frame = spark.createDataFrame([row(0, 0), row(1, 10_000), row(2, 20_000)], "event_id long, unit long, channel string, s long, amp double").selectExpr("event_id", "unit", "channel", "timestamp_seconds(s) as ts", "amp")
    folder = str(tmp_path / "late")
    stream = spark.readStream.schema(frame.schema).parquet(folder) if frame.where("event_id < 2").write.parquet(folder) is None else None
    q = windows.tumbling(stream, "1 minute", "1 minute").writeStream.outputMode("append").format("memory").queryName("late").start()
    q.processAllAvailable()
    frame.where("event_id = 0").withColumn("event_id", F.lit(9).cast("long")).write.mode("append").parquet(folder)
    frame.where("event_id = 2").write.mode("append").parquet(folder)
    q.processAllAvailable()
    q.stop()
    assert {(r.start.timestamp(), r.n) for r in spark.sql("select * from late").collect()} == {(0.0, 1), (9960.0, 1)}


def test_live_refractory_is_the_batch(spark, tmp_path, events):
    got = live(spark, tmp_path, events, lambda e: windows.refractory(e, 44), "refractory", files=4)
    assert got == {(r.event_id, r.unit, r.t) for r in trains.refractory(events, 44).collect()} and len(got) < 300


def test_range_and_every(spark, tmp_path):
    x = np.arange(2000, dtype=np.int16).reshape(1000, 2)
    x.tofile(tmp_path / "a.dat")
    raw.register(spark)
    read = lambda **o: spark.read.format("recording").options(path=str(tmp_path / "a.dat"), channels=2, dtype="int16", **o).load().orderBy("chunk_id").collect()
    part = read(start=130, stop=470, chunk=100, halo=20)
    assert (np.concatenate([raw.samples(r)[r.before : r.before + r.n] for r in part]) == x[130:470]).all() and part[0].t_start == 130
    thin = read(start=10, stop=990, chunk=101, every=7)
    assert (np.concatenate([raw.samples(r) for r in thin]) == x[10:990:7]).all() and [r.t_start for r in thin] == list(np.cumsum([0, *(r.n for r in thin[:-1])]))
    with pytest.raises(Exception, match="every"):
        read(every=2, halo=5)


@pytest.fixture(scope="module")
def noise(spark):
    return benchmark.noise(spark, 4000, 4, 1000, 0.1, seed=3)


def test_artefacts_go(spark, tmp_path, noise):
    raw.register(spark)
    shape = np.outer(np.hanning(40), [1, -2, 3, 0.5])
    x = np.concatenate([raw.samples(r) for r in noise.orderBy("chunk_id").collect()]).astype(np.float64)
    at = [100, 980, 1700, 2990, 3500]
    for t in at:
        x[t : t + 40] += shape
    x.astype(np.float32).tofile(tmp_path / "a.dat")
    chunks = spark.read.format("recording").options(path=str(tmp_path / "a.dat"), channels=4, chunk=1000, halo=50).load()
    triggers = spark.createDataFrame([(7, t) for t in at], "label long, t long")
    found = np.zeros((40, 4))
    for r in recording.artefacts(chunks, triggers, 40, 1000).collect():
        found[r.lag, r.channel] = r.v
    stack = np.median([x[t : t + 40].astype(np.float32) for t in at], axis=0)
    assert np.allclose(found, stack, atol=1e-6) and np.abs(found - shape).max() < 0.3
    y = x.copy()
    for t in at:
        y[t : t + 40] -= found
    for r in recording.remove_artefacts(chunks, triggers, {7: found}, 1000).collect():
        low = r.t_start - r.before
        assert np.allclose(raw.samples(r), y[low : low + len(raw.samples(r))], atol=1e-4)


def test_reference_by_shank_and_ground(spark, noise):
    rows = recording.band_pass(noise, 3, 300, 5000, 20000, common=True, shanks=[[0, 1, 2], [3]], grounds={0: 3}).collect()
    plain = {r.chunk_id: raw.samples(r).astype(np.float64) for r in noise.collect()}
    for r in rows:
        x = plain[r.chunk_id].copy()
        x[:, 0] -= x[:, 3]
        y = kernels.filtfilt(x, kernels.butter(3, 300, 5000, 20000))
        y -= np.median(y, axis=0)
        y[:, :3] -= np.median(y[:, :3], axis=1, keepdims=True)
        y[:, 3] = 0
        assert np.allclose(raw.samples(r), y, atol=1e-4)


def test_matched_and_silent(spark, noise):
    wave = -np.hanning(21)
    got = np.concatenate([raw.samples(r) for r in recording.matched(noise, wave).orderBy("chunk_id").collect()])
    x = raw.samples(noise.orderBy("chunk_id").first())
    assert np.allclose(got[:1000, 1], np.convolve(x[:, 1], wave[::-1] / (np.abs(wave.sum()) * 21), "same"), atol=1e-5)
    crossed = spark.createDataFrame([(t,) for t in (100, 105, 900, 3999)], "t long")
    assert sorted(map(tuple, recording.silent_periods(crossed, 4000, 10, 50).collect())) == [(0, 90), (116, 890), (911, 3989)]
    assert recording.silent_periods(crossed.limit(0), 4000, 10, 50).collect() == [(0, 4000)]


def test_meta_merge(spark):
    r = np.random.default_rng(4)
    base = np.sort(r.choice(200_000, 1200, replace=False)) * 10
    halves = [(int(t), int(r.integers(0, 2))) for t in base]  # units 0 and 1 are one train in two parts
    other = [(int(t), 2) for t in r.choice(2_000_000, 600, replace=False)]
    spikes = spark.createDataFrame([(i, u, t) for i, (t, u) in enumerate(halves + other)], "event_id long, unit long, t long")
    pairs = spark.createDataFrame([(0, 1, 0.9), (0, 2, 0.9), (1, 2, 0.2)], "i long, j long, similarity double")
    scored = {(s.i, s.j): s for s in metamerge.scores(spikes, pairs, 1000, 8, 10).collect()}
    trains_ = {u: np.sort([t for t, v in halves + other if v == u]) for u in range(3)}
    for (i, j), s in scored.items():
        both = np.sort(np.concatenate([trains_[i], trains_[j]]))
        assert abs(s.rpv - (np.diff(both) < 10).sum() / len(both)) < 1e-9
    assert [tuple(p) for p in metamerge.suggest(spark.createDataFrame([(0, 1, 0.9, 0.5, 0.0), (0, 2, 0.9, 0.0, 0.0), (1, 2, 0.2, 0.9, 0.0)], "i long, j long, similarity double, dip double, rpv double"), 0.8, 0.3, 0.01).collect()] == [(0, 1)]
    assert metamerge.resolve([(0, 1), (1, 2), (0, 2), (4, 3)], [0, 1, 2, 3, 4]) == {0: 2, 1: 2, 2: 2, 3: 3, 4: 3}
    left = metamerge.renumber(spikes, {0: 1, 1: 1, 2: 2})
    assert {u["unit"]: u["count"] for u in left.groupBy("unit").count().collect()} == {0: 1200, 1: 600}
    t = spark.createDataFrame([(0, 0.5, 1.5, 2.0, 1.0), (1, 0.6, 1.2, 1.0, 0.5), (2, 0.7, 1.3, 1.0, 0.9)], "unit long, low double, high double, norm double, purity double")
    into = spark.createDataFrame([(0, 1), (1, 1)], "unit long, target long")
    assert [tuple(r) for r in metamerge.slice_templates(t, into).collect()] == [(1, 0.6, 3.0, 1.0, 0.75)]
