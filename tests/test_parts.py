import numpy as np
from pyspark.sql import functions as F

from voltmill.functions import kernels
from voltmill.operators import joins, robust
from voltmill.sources import probefile, raw
from voltmill.streaming import windows


def test_raw_chunks_put_together_are_the_file(spark, tmp_path):
    x = np.random.default_rng(1).integers(-500, 500, (1000, 3)).astype(np.int16)
    path = tmp_path / "r.dat"
    path.write_bytes(b"head" + x.tobytes())
    raw.register(spark)
    rows = spark.read.format("recording").options(path=str(path), channels=3, dtype="int16", header=4, chunk=300, halo=20, gain=0.5).load().orderBy("chunk_id").collect()
    assert [r.n for r in rows] == [300, 300, 300, 100] and [r.before for r in rows] == [0, 20, 20, 20]
    whole = np.concatenate([raw.samples(r)[r.before : r.before + r.n] for r in rows])
    assert (whole == x * np.float32(0.5)).all()


def test_probe_is_parsed_without_being_run(spark):
    text = "total_nb_channels = 2\nradius = 5\nchannel_groups = {1: {'channels': list(range(2)), 'geometry': {0: [0, 0], 1: [22, 0]}, 'graph': []}}"
    assert [tuple(r) for r in probefile.probe_table(spark, text).orderBy("channel").collect()] == [("1", 0, 0.0, 0.0, 0.0), ("1", 1, 22.0, 0.0, 0.0)]


def test_band_pass_keeps_the_middle_and_stops_the_rest():
    rate, t = 20000.0, np.arange(4000) / 20000.0
    s = kernels.butter(3, 300, 3000, rate)
    for freq, low, high in ((1000, 0.95, 1.05), (30, 0, 0.01), (9000, 0, 0.05)):
        y = kernels.filtfilt(np.sin(2 * np.pi * freq * t)[:, None], s)[1000:3000]
        assert low <= np.abs(y).max() <= high


def test_peaks():
    x = np.array([0, 1, 3, 1, 2, 2, 0, 5, 4, 6, 0.0])
    assert kernels.find_peaks(x, 1).tolist() == [2, 4, 7, 9]
    assert kernels.find_peaks(x, 1, distance=3).tolist() == [2, 9]


def test_greedy_match_gets_overlapping_events_back():
    rng = np.random.default_rng(2)
    templates = rng.standard_normal((3, 21, 4))
    x = np.zeros((500, 4))
    truth = [(0, 50, 1.0), (1, 58, 1.2), (2, 300, 0.8)]
    for k, at, a in truth:
        x[at : at + 21] += a * templates[k]
    found = kernels.greedy_match(x, templates, 0.5, 2.0)
    assert {(k, at) for k, at, _ in found[:3]} == {(k, at) for k, at, _ in truth}


def test_clusters_whitening_pca():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 0.1, (40, 2)), rng.normal(3, 0.1, (40, 2))])
    label = kernels.density_clusters(x, 5, 2)
    assert len(set(label[:40])) == 1 and len(set(label[40:])) == 1 and label[0] != label[50]
    c = np.cov(rng.standard_normal((500, 4)) @ rng.standard_normal((4, 4)), rowvar=False)
    w = kernels.whitening(c)
    assert np.allclose(w @ c @ w, np.eye(4), atol=1e-6)
    assert np.allclose(kernels.pca(x, 2) @ kernels.pca(x, 2).T, np.eye(2))


def test_band_join_has_no_nested_loop(spark):
    a = spark.range(1000).select(F.col("id").alias("event_id"), (F.col("id") % 7).alias("unit"), (F.col("id") * 13 % 997).alias("t"))
    b = a.where("event_id % 2 = 0")
    found = joins.band(a, b, ["unit"], 10)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    brute = a.alias("a").join(b.alias("b"), F.expr("a.unit = b.unit and abs(a.t - b.t) < 10")).count()
    assert found.count() == brute


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(200).selectExpr("id", "id % 3 as unit", "cast(id % 2 as string) as channel", "timestamp_seconds(id * 7) as ts", "cast(id as double) as amp")
    rows.write.parquet(str(tmp_path / "in"))
    batch = {tuple(r) for r in windows.tumbling(spark.read.parquet(str(tmp_path / "in")), "1 minute", "10 minutes").collect()}
    live = windows.tumbling(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "1 minute", "10 minutes")
    q = live.writeStream.outputMode("complete").format("memory").queryName("t").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.sql("select * from t").collect()} == batch


def test_medians_by_bracket(spark, monkeypatch):
    """Groups far larger than the sketch, with ties, one value only, nulls and null keys; the bracket must hold the middle of each."""
    rng = np.random.default_rng(8)
    monkeypatch.setattr(robust, "FEW", 50)
    monkeypatch.setattr(robust, "ACCURACY", 100)
    values = {0: rng.normal(size=9000), 1: rng.integers(0, 4, 7001).astype(float), 2: np.full(3000, 2.5), 3: rng.exponential(size=40), None: rng.random(5000), 5: np.array([1.0, 2.0])}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [(0, None), (7, None)]
    df = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "k int, v double").repartition(5)
    got = {r.k: r.m for r in robust.median(df, ["k"], "v", "m").collect()}
    assert got == {k: np.median(v) for k, v in values.items()}
    spread = {r.k: r.mad for r in robust.mad(df.where("k is not null"), ["k"], "v").collect()}
    assert all(np.isclose(spread[k], np.median(np.abs(v - np.median(v)))) for k, v in values.items() if k is not None)
