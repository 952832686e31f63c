"""Kernels of clustering and merging on small groups, the synthetic benchmark, and a whole sort that must find what was injected."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltmill.engine import Run
from voltmill.functions import kernels, merging, sorting
from voltmill.operators import benchmark, joins, recording, validation
from voltmill.operators import sorting as sorter
from voltmill.sources import curation, probefile, raw


def test_dip():
    r = np.random.default_rng(1)
    grid = np.arange(200) / 200
    assert np.isclose(merging.dip(grid), 1 / 400)
    two = np.concatenate([r.normal(0, 0.01, 300), r.normal(1, 0.01, 300)])
    assert 0.22 < merging.dip(two) <= 0.25
    one = r.normal(0, 1, 400)
    assert merging.dip(one) < merging.dip_threshold(400, 0.05) < merging.dip(two)
    uniform = np.array([merging.dip(r.random(100)) for _ in range(300)])
    assert abs(np.median(uniform) - 0.0341) < 0.003 and abs(np.quantile(uniform, 0.95) - 0.048) < 0.005  # the published table
    assert (uniform > merging.dip_threshold(100, 0.05)).mean() < 0.1
    assert merging.dip(np.zeros(5)) == 0.1


def test_folding():
    r = np.random.default_rng(2)
    one, two = r.normal(0, 1, (500, 1)), np.concatenate([r.normal(-3, 1, (250, 1)), r.normal(3, 1, (250, 1))])
    assert merging.folding(one, False)[0] and not merging.folding(two, False)[0]
    assert merging.folding(two)[1] < 1e-3
    x = np.array([-1.0, 1.0] * 200)[:, None] + r.normal(0, 1e-3, (400, 1))
    assert merging.folding(x)[2] < 0.01
    box = r.random((4000, 2))
    assert abs(merging.folding(box, False)[2] - 1) < 0.15  # uniform points lie on the border


def test_bhattacharyya():
    r = np.random.default_rng(3)
    a, b, c = r.normal(0, 1, 2000), r.normal(0, 1, 2000), r.normal(4, 1, 2000)
    for method in ("continuous", "hist", "autohist"):
        assert merging.bhattacharyya(a, b, method) < 0.1 < merging.bhattacharyya(a, c, method)
    assert merging.bhattacharyya(np.array([1.0, 1, 2]), np.array([1.0, 1, 2]), "noiseless") == pytest.approx(0)
    assert merging.bhattacharyya(np.zeros(3), np.ones(3), "noiseless") == np.inf
    x, y = r.normal(0, 1, (20000, 2)), r.normal(0, 1, (20000, 2)) + [2, 0]
    assert merging.gaussian_bhattacharyya(x, y) == pytest.approx(4 / 8, abs=0.03)
    assert merging.gaussian_bhattacharyya(np.zeros((5, 2)), y) == np.inf


@pytest.mark.parametrize("method", list(merging.METRICS))
def test_merge(method):
    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(0, 1, (150, 3)), r.normal(0, 1, (150, 3)), r.normal(0, 1, (150, 3)) + [12, 0, 0]])
    labels = np.repeat([0, 1, 2], 150)
    labels[5] = -1
    found, history = merging.merge(x, labels, method, {"folding": 1.1, "nd-folding": 1.1}.get(method))
    assert found[5] == -1 and (found[:150][labels[:150] == 0] == 0).all() and (found[150:300] == 0).all() and (found[300:] == 2).all()
    assert [h[:2] for h in history] == [(0, 1)]


def test_robust_line_and_centres():
    x = np.linspace(0, 1, 100)
    y = 1 - x
    y[90] = 8
    assert np.abs(sorting.robust_line(x, y)[:80] - (1 - x)[:80]).max() < 0.1
    assert sorting.centres(x, y).tolist() == [90]
    assert not len(sorting.centres(np.ones(5), np.arange(5.0)))


def test_density_peaks():
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(m, 0.3, (120, 2)) for m in (0, 6, 12)] + [[[30.0, 30.0]]])
    found = sorting.density_peaks(x)
    main = [np.bincount(found[a : a + 120][found[a : a + 120] >= 0]).argmax() for a in (0, 120, 240)]
    assert len(set(main)) == 3 and all((found[a : a + 120] == m).mean() > 0.7 for a, m in zip((0, 120, 240), main, strict=True))
    assert sorting.density_peaks(np.zeros((1, 2))).tolist() == [-1]


def test_smoothing_and_shifts():
    t = np.arange(61.0)
    cubic = 0.001 * (t - 30) ** 3 - 0.2 * t
    assert np.allclose(sorting.savitzky_golay(cubic, 11, 3), cubic)
    noisy = np.sin(t / 8) + np.random.default_rng(6).normal(0, 0.2, 61)
    assert np.std(sorting.smooth(noisy[None], 7, 21)[0] - np.sin(t / 8)) < np.std(noisy - np.sin(t / 8))
    w = np.zeros((2, 9))
    w[1, 2] = -5
    assert sorting.centred(w)[1].tolist() == [0, 0, 0, 0, -5, 0, 0, 0, 0] and sorting.shifted(w, -20).sum() == 0
    wave = lambda s: -np.exp(-((t - 30 - s) ** 2) / 20)
    waves = np.array([wave(s) for s in (-1.3, 0.0, 0.6, 1.7)])
    assert np.abs(sorting.align(waves) - wave(0)).max() < 0.02


def test_amplitude_bounds_are_the_best_there_are():
    r = np.random.default_rng(7)
    good, bad = r.normal(1, 0.1, 80), np.concatenate([r.normal(0.3, 0.1, 60), r.normal(1.8, 0.1, 30)])
    low, high, purity = sorting.amplitude_bounds(good, bad, 2.0)
    cost = lambda a, b: sorting.error(good, bad, a, b) + 1e-2 * (2.0 - (b - a)) ** 2
    grid = min(cost(a, b) for a in np.linspace(0, 1, 201) for b in np.linspace(1, 2, 201))
    assert cost(low, high) <= grid + 1e-9 and 0.4 < low < 0.9 and 1.1 < high < 1.8 and purity > 0.9
    assert sorting.amplitude_bounds(np.zeros(0), bad)[:2] == (0.5, 1.5)


def test_similar_templates_and_mixtures():
    r = np.random.default_rng(8)
    base = r.standard_normal((3, 4, 21)) * np.hanning(21)
    t = np.concatenate([base, sorting.shifted(base[:1], 3) * 1.4, (sorting.shifted(base[1], 1) + sorting.shifted(base[2], -2))[None]])
    s = sorting.similarity(t)
    assert s[0, 3] > 0.9 > s[0, 1]
    assert sorting.merge_similar(s, np.array([10, 10, 10, 10, 10]), 0.9).tolist() == [3, 1, 2, 3, 4]
    assert sorting.merge_similar(s, np.array([11, 10, 10, 10, 10]), 0.9).tolist() == [0, 1, 2, 0, 4]
    assert sorting.mixtures(t, np.tile([0.5, 1.5], (5, 1)), 0.9).tolist() == [False, False, False, False, True]


def test_match_with_bounds_second_component_and_places():
    r = np.random.default_rng(9)
    t, s = r.standard_normal((2, 2, 15, 3))
    s -= (s * t).sum(axis=(1, 2), keepdims=True) / (t**2).sum(axis=(1, 2), keepdims=True) * t
    x = np.zeros((200, 3))
    x[40:55] += t[0] + 0.5 * s[0]
    x[48:63] += 0.8 * t[1]
    x[120:135] += 3 * t[1]
    found = kernels.match(x, t, np.array([[0.5, 1.5], [0.5, 1.5]]), s, 0.1)
    assert {(int(k), int(at)) for k, at, *_ in found[:2]} == {(0, 40), (1, 48)} and (found[:, 2] < 1.5).all()
    only = kernels.match(x, t, np.array([[0.5, 1.5], [0.5, 4.0]]), None, 0.0, np.array([120, 500]))
    assert [(int(k), int(at)) for k, at, *_ in only] == [(1, 120)]
    assert kernels.match(x[:5], t, np.ones((2, 2))).shape == (0, 4)


RATE, CHANNELS = 20_000.0, 4


@pytest.fixture(scope="module")
def waves():
    """Three units, each with its largest trough on a channel of its own."""
    t = np.arange(61) - 30
    shape = lambda a, b: -np.exp(-((t / a) ** 2)) + 0.4 * np.exp(-(((t - 9) / b) ** 2))
    weights = np.array([[9, 3, 1, 0], [1, 8, 3, 0], [0, 1, 4, 10.0]])
    return np.array([shape(a, b)[:, None] * w[None] for a, b, w in zip((2.5, 4.0, 3.2), (6, 7, 5), weights, strict=True)])


def test_benchmark_kinds():
    sizes = {"fitting": 25, "clustering": 25, "synchrony": 5, "pca-validation": 10, "smart-search": 10, "drifts": 25}
    for name, n in sizes.items():
        k = benchmark.kind(name, 7)
        assert len(k.templates) == len(k.scales) == len(k.rates) == n and max(k.templates) < 7
        assert benchmark.shuffled(np.ones((7, 5, 3)), k).shape == (n, 5, 3)
    with pytest.raises(ValueError):
        benchmark.kind("none", 7)


def test_injection_does_not_depend_on_how_chunks_are_dealt(spark, waves):
    units = benchmark.Injection((0, 1, 2), (1.0, 1.0, 1.0), (20.0, 20.0, 20.0), slopes=(0.0, 1.0, -1.0))
    quiet = benchmark.noise(spark, 50_000, CHANNELS, 10_000, 0.0)
    rows = {n: sorted(map(tuple, benchmark.truth(quiet.repartition(n), waves, units, RATE).collect())) for n in (1, 3, 8)}
    assert rows[1] == rows[3] == rows[8] and len(rows[1]) > 60
    x = np.concatenate([raw.samples(r) for r in benchmark.inject(quiet, waves, units, RATE).orderBy("chunk_id").collect()])
    built = np.zeros_like(x, dtype=float)
    for u, t, amplitude, *_ in rows[1]:
        assert 61 <= t % 10_000 < 10_000 - 61
        built[t - 30 : t + 31] += amplitude * waves[u]
    assert np.allclose(x, built, atol=1e-4)
    for u in range(3):
        assert (np.diff(sorted(t for v, t, *_ in rows[1] if v == u)) > 100).all()
    shared = benchmark.truth(quiet, waves, benchmark.Injection((0, 1), (1.0, 1.0), (50.0, 50.0), shared=0.9), RATE).collect()
    a, b = ({r.t for r in shared if r.unit == u} for u in range(2))
    assert len(a & b) > 0.6 * len(a)


def test_the_sort_finds_what_was_injected(spark, waves, tmp_path):
    """Noise and three units in, a file, all steps by name, and the units within two milliseconds out."""
    raw.register(spark)
    units = benchmark.Injection((0, 1, 2), (1.0, 1.0, 1.0), (12.0, 12.0, 12.0))
    bare = benchmark.noise(spark, 400_000, CHANNELS, 40_000, 0.3)
    benchmark.inject(bare, waves, units, RATE).write.format("recording").mode("append").options(path=str(tmp_path / "in")).save()
    run = Run(spark, str(tmp_path / "out"), {"path": str(tmp_path / "in"), "channels": CHANNELS, "chunk": 50_000, "halo": 200}, sorter.Settings(rate=RATE, quota=600, parameter=2.0))
    run.write("truth", benchmark.truth(bare, waves, units, RATE))
    run.run("thresholding", "clustering", "fitting", "merging", "gathering", "converting", "deconverting", "validating")
    found = run.table("validation").collect()
    assert {r.unit for r in found} == {0, 1, 2} and all(r.recall > 0.9 and r.precision > 0.9 for r in found)
    merged = run.table("merged").count()
    assert run.table("curated_spikes").count() == merged == run.table("events").where("kind = 'spike'").count()
    truth = run.table("truth").where("unit = 0").select(F.col("t").alias("event_id"), "t")
    spikes = run.table("spikes").select(F.xxhash64("template", "t").alias("event_id"), "template", "t")
    chosen, recall, precision = validation.best_union(truth, spikes, 40)
    assert chosen and recall > 0.9 and precision > 0.9
    run.write("given", run.table("truth").select(F.col("unit").alias("template"), "t"))
    run.run("extracting")
    again = run.templates()
    assert again.electrode.tolist() == [0, 1, 3] and all(np.corrcoef(again.waves[k].ravel(), waves[k].ravel())[0, 1] > 0.98 for k in range(3))
    run.options["benchmark"] = "smart-search"
    run.run("benchmarking")
    assert run.table("benchmark").count() == 8 and run.table("truth").select("unit").distinct().count() == 10


def test_classifiers(spark):
    r = np.random.default_rng(10)
    x = np.concatenate([r.normal(0, 1, (200, 2)), r.normal(3, 1, (200, 2))])
    rows = [(i, [float(v) for v in x[i]], bool(i >= 200)) for i in range(400)]
    points = spark.createDataFrame(rows, "i long, features array<double>, good boolean")
    centre, inverse = validation.ellipsoid(points)
    own = x[200:]
    assert np.allclose(centre, own.mean(axis=0)) and np.allclose(inverse, np.linalg.inv(np.cov(own, rowvar=False, bias=True)))
    d = {q.i: q.d for q in points.select("i", validation.mahalanobis("features", centre, inverse).alias("d")).collect()}
    off = x - centre
    assert np.allclose([d[i] for i in range(400)], ((off @ inverse) * off).sum(axis=1))
    beta = validation.weighted_logistic(points, 1.0)
    p = 1 / (1 + np.exp(-(beta[0] + x @ beta[1:])))
    y = np.arange(400) >= 200
    assert np.abs(np.column_stack([np.ones(400), x]).T @ (y - p) - 1e-3 * beta).max() < 1e-5
    low, high = validation.balanced_rates(points, [0.1, 10.0])
    assert low[1] < high[1] and low[2] < high[2] and high[1] > 0.95
    assert validation.quadratic(x).shape == (400, 5) and validation.quadratic(x, False).shape == (400, 4)


def test_safety_is_one_by_one(spark):
    r = np.random.default_rng(11)
    rows = [(i, "ab"[int(r.integers(0, 2))], int(r.integers(0, 3000)), float(r.integers(0, 40))) for i in range(400)]
    events = spark.createDataFrame(rows, "event_id long, channel string, t long, amp double")
    got = {e.event_id for e in joins.safety(events, ["channel"], "amp", 25, 200).collect()}
    want, taken = set(), {"a": [], "b": []}
    for i, c, t, _ in sorted(rows, key=lambda e: (-e[3], e[2], e[0])):
        if all(abs(t - u) >= 25 for u in taken[c]):
            taken[c].append(t)
            want.add(i)
    assert got == want
    assert joins.safety(events.limit(0), ["channel"], "amp", 25, 200).count() == 0


def test_neighbours_and_zones_do_not_depend_on_buckets(spark):
    r = np.random.default_rng(12)
    rows = [(i, int(r.integers(0, 3)), int(r.integers(0, 5000))) for i in range(150)] + [(900, 7, 10)]
    events = spark.createDataFrame(rows, "event_id long, unit int, t long")
    for width in (7, 100, 10**6):
        got = {e.event_id: (e.before and e.before.event_id, e.after and e.after.event_id) for e in joins.neighbours(events, ["unit"], ["t", "event_id"], ["event_id"], width).collect()}
        for u in (0, 1, 2, 7):
            line = [i for i, _, _ in sorted((e for e in rows if e[1] == u), key=lambda e: (e[2], e[0]))]
            assert [got[i] for i in line] == list(zip([None, *line[:-1]], [*line[1:], None], strict=True))
    zones = spark.createDataFrame([(int(a), int(a + r.integers(0, 60))) for a in r.integers(0, 4000, 120)] + [(5, 3000)], "start long, stop long")
    plain = sorted((z.start, z.stop) for z in zones.collect() if z.stop > z.start)
    want = []
    for a, b in plain:
        if want and a <= want[-1][1]:
            want[-1][1] = max(want[-1][1], b)
        else:
            want.append([a, b])
    for width in (10, 333, 10**6):
        assert sorted([z.start, z.stop] for z in joins.coalesce_intervals(zones, width).collect()) == want


def test_curated_merges(spark):
    templates = spark.createDataFrame([(0, 5, 0), (1, 5, 1), (2, 6, 2), (3, 7, 3), (4, 8, 4), (4, 5, 5)], "template long, cluster long, row long")
    groups = spark.createDataFrame([(5, "good"), (6, "noise"), (7, "unsorted"), (8, "mua")], "cluster_id long, group string")
    assert {(r.template, r.unit) for r in curation.merges_of_groups(templates, groups).collect()} == {(0, 0), (1, 0), (4, 0), (3, 1)}


def test_texts_of_a_recording(spark, tmp_path):
    (tmp_path / "t.txt").write_text("# label ms\n1 10\n\n2, 20.5 // late\n")
    assert [tuple(r) for r in probefile.time_table(spark, str(tmp_path / "t.txt"), ("label", "t"), 20000.0).orderBy("t").collect()] == [(1, 200), (2, 410)]
    assert probefile.mapping_file("# a\nx/a.dat\n\nb.dat // second\n") == ["x/a.dat", "b.dat"]
    assert probefile.batch_list("a.dat nodes=4 method=x\n#c\nb.dat") == [("a.dat", {"nodes": "4", "method": "x"}), ("b.dat", {})]
    assert str(probefile.header_time("## Time Opened (m/d/y): 6/24/2019  (h:m:s.ms) 16:40:4.328")) == "2019-06-24 16:40:04.328000"
    assert probefile.header_time("-TimeCreated 2019/06/24 16:40:04").year == 2019 and probefile.header_time("none") is None
    with pytest.raises(ValueError):
        probefile.probe_table(spark, "total_nb_channels = 2\nradius = 5\nchannel_groups = {1: {'channels': [-1], 'geometry': {-1: [0, 0]}}}")
    zones = spark.createDataFrame([(-5, 10), (90, 200), (150, 160)], "start long, stop long")
    both = probefile.clipped([(zones, 0, 100), (zones, 1000, 155)])
    assert sorted(map(tuple, both.collect())) == [(0, 10), (90, 100), (1000, 1010), (1090, 1155), (1150, 1155)]


def test_overwriting_a_recording(spark, tmp_path):
    raw.register(spark)
    long, short = (benchmark.noise(spark, n, 2, 100) for n in (500, 200))
    options = {"path": str(tmp_path / "r")}
    long.write.format("recording").mode("append").options(**options).save()
    (tmp_path / "r" / "_0-half").write_bytes(b"x")
    short.write.format("recording").mode("overwrite").options(**options).save()
    assert sorted(p.name for p in (tmp_path / "r").iterdir()) == ["00000000000000000000.dat", "00000000000000000100.dat"]


def test_unfitted(spark):
    crossed = spark.createDataFrame([(0, 100, -3.0), (1, 200, -4.0), (0, 215, -5.0)], "channel int, t long, amp double")
    spikes = spark.createDataFrame([(0, 105), (1, 210)], "template int, t long")
    assert [r.t for r in recording.unfitted(crossed, spikes, 9).collect()] == [200]
