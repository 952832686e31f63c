"""Each format's file is written here by its public description and read back; operators on chunks are held against whole arrays."""

import struct

import numpy as np
import pytest

from voltmill.functions import kernels
from voltmill.operators import recording
from voltmill.sources import curation, layouts, raw

RNG = np.random.default_rng(5)


def whole(spark, path, layout, **options):
    raw.register(spark)
    rows = spark.read.format("recording").options(path=str(path), layout=layout, chunk=100, halo=7, **options).load().orderBy("chunk_id").collect()
    return np.concatenate([raw.samples(r)[r.before : r.before + r.n] for r in rows])


@pytest.mark.parametrize("case", ["time first", "channels first", "fortran", "three", "one channel"])
def test_npy(spark, tmp_path, case):
    x = RNG.integers(-99, 99, (350, 1 if case == "one channel" else 3)).astype(np.int16)
    y = {"time first": x, "channels first": np.ascontiguousarray(x.T), "fortran": np.asfortranarray(x), "three": x[None], "one channel": x[:, 0]}[case]
    np.save(tmp_path / "a.npy", y)
    assert (whole(spark, tmp_path / "a.npy", "npy") == x).all()


@pytest.mark.parametrize("wide", [False, True])
def test_mda(spark, tmp_path, wide):
    x = RNG.standard_normal((350, 4)).astype(np.float32)
    head = struct.pack("<3i", -3, 4, -2 if wide else 2) + np.array([4, 350], "<i8" if wide else "<i4").tobytes()
    (tmp_path / "a.mda").write_bytes(head + x.tobytes())
    assert (whole(spark, tmp_path / "a.mda", "mda") == x).all()


def test_mcs_raw(spark, tmp_path):
    x = RNG.integers(0, 65535, (350, 2)).astype("<u2")
    head = b"MC_DataTool binary conversion\r\nSample rate = 20000\r\nADC zero = 32768\r\nEl = 0.5\xb5V/AD\r\nStreams = El_01;El_02\r\nEOH\r\n"
    (tmp_path / "a.raw").write_bytes(head + x.tobytes())
    assert np.allclose(whole(spark, tmp_path / "a.raw", "mcs_raw"), (x.astype(float) - 32768) * 0.5)
    assert layouts.layout([str(tmp_path / "a.raw")], "mcs_raw", {}).rate == 20000


def test_open_ephys(spark, tmp_path):
    x = RNG.integers(-999, 999, (3 * 1024, 11)).astype(">i2")
    for c in range(11):
        records = b"".join(bytes(12) + x[i : i + 1024, c].tobytes() + bytes(10) for i in range(0, len(x), 1024))
        (tmp_path / f"100_CH{c + 1}.continuous").write_bytes(b"header.bitVolts = 0.5;\nheader.sampleRate = 30000;\n".ljust(1024) + records + b"torn")
    assert (whole(spark, tmp_path, "open_ephys") == x * np.float32(0.5)).all()


def test_neuralynx(spark, tmp_path):
    x = RNG.integers(-999, 999, (2 * 512, 2)).astype("<i2")
    for c in range(2):
        records = b"".join(bytes(20) + x[i : i + 512, c].tobytes() for i in range(0, len(x), 512))
        (tmp_path / f"CSC{c + 1}.ncs").write_bytes(b"-SamplingFrequency 32000\r\n-ADBitVolts 0.000001\r\n-InputInverted True\r\n".ljust(16384, b"\0") + records)
    assert np.allclose(whole(spark, tmp_path, "neuralynx"), -x.astype(float), rtol=1e-5)


@pytest.mark.parametrize("major", [1, 2])
def test_intan(spark, tmp_path, major):
    n = 128 if major == 2 else 60
    x = RNG.integers(0, 65535, (4 * n, 3)).astype("<u2")
    text = lambda s: struct.pack("<I", 2 * len(s)) + s.encode("utf-16-le")
    none = struct.pack("<I", 0xFFFFFFFF)
    head = struct.pack("<Ihhf", 0xC6912702, major, 3, 20000.0) + struct.pack("<h6fh2f", *[0] * 10) + text("note") + none + none + struct.pack("<2h", 1, 0)
    head += (text("ref") if major == 2 else b"") + struct.pack("<h", 2)
    channel = lambda kind, on=1: text("A-0") + none + struct.pack("<10h2f", 0, 0, kind, on, *[0] * 8)
    head += text("Port A") + text("A") + struct.pack("<3h", 1, 5, 4) + channel(0) + channel(0) + channel(0) + channel(0, 0) + channel(1)
    head += text("Board") + text("D") + struct.pack("<3h", 1, 1, 0) + channel(4)
    rest = bytes(2 * (n // 4 + 1 + n))
    blocks = b"".join(bytes(4 * n) + np.ascontiguousarray(x[i : i + n].T).tobytes() + rest for i in range(0, len(x), n))
    (tmp_path / "a.rhd").write_bytes(head + blocks)
    assert np.allclose(whole(spark, tmp_path / "a.rhd", "intan"), (x.astype(float) - 32768) * 0.195, rtol=1e-5)


def test_nsx_packets_follow_each_other(spark, tmp_path):
    x = RNG.integers(-999, 999, (250, 2)).astype("<i2")
    end = 314 + 2 * 66
    head = (b"NEURALCD" + struct.pack("<BBI", 2, 3, end)).ljust(286, b"\0") + struct.pack("<II", 1, 30000) + bytes(16) + struct.pack("<I", 2)
    head += b"".join((b"CC" + struct.pack("<H", c)).ljust(22, b"\0") + struct.pack("<4h", -1000, 1000, -500 * (c + 1), 500 * (c + 1)) + bytes(36) for c in range(2))
    packet = lambda y: struct.pack("<BII", 1, 0, len(y)) + y.tobytes()
    (tmp_path / "a.ns5").write_bytes(head + packet(x[:90]) + packet(x[90:]))
    assert np.allclose(whole(spark, tmp_path / "a.ns5", "nsx"), x * np.array([0.5, 1.0]))


def test_several_files_are_one_recording_and_channels_are_chosen(spark, tmp_path):
    x = RNG.standard_normal((350, 4)).astype(np.float32)
    for i, part in enumerate((x[:120], x[120:])):
        part.tofile(tmp_path / f"{i}.dat")
    for path in (f"{tmp_path}/0.dat,{tmp_path}/1.dat", tmp_path):
        assert (whole(spark, path, "raw_binary", channels=4, keep="3,1") == x[:, [3, 1]]).all()


def test_chunks_written_are_read_again(spark, tmp_path):
    x = RNG.integers(-999, 999, (350, 3)).astype(np.int16)
    x.tofile(tmp_path / "a.dat")
    raw.register(spark)
    chunks = spark.read.format("recording").options(path=str(tmp_path / "a.dat"), channels=3, dtype="int16", gain=0.5, chunk=100, halo=9).load()
    for _ in range(2):  # a second run replaces the same files
        chunks.write.format("recording").mode("append").options(path=str(tmp_path / "out"), dtype="int16", gain=0.5).save()
    assert (whole(spark, tmp_path / "out", "raw_binary", channels=3, dtype="int16") == x).all()


def test_empty_recording_and_unknown_formats(spark, tmp_path):
    (tmp_path / "a.dat").write_bytes(b"")
    raw.register(spark)
    assert spark.read.format("recording").options(path=str(tmp_path / "a.dat"), channels=2).load().count() == 0
    listed = {r.format: r.readable for r in layouts.formats(spark).collect()}
    assert listed["npy"] and not listed["hdf5"]
    with pytest.raises(ValueError, match="HDF5"):
        layouts.layout(["x"], "hdf5", {})


@pytest.fixture(scope="module")
def signal(spark, tmp_path_factory):
    """Noise with three templates at known places, some over a chunk's edge: (array, path, templates, truth)."""
    x = RNG.normal(0, 0.05, (4000, 4))
    shape = np.hanning(21)[:, None] * RNG.standard_normal((3, 21, 4)) * 3
    truth = [(k % 3, 60 + 83 * k) for k in range(45)] + [(0, 995), (1, 1990)]
    truth = [(k, t) for i, (k, t) in enumerate(truth) if all(abs(t - u) > 25 for _, u in truth[i + 1 :])]
    for k, t in truth:
        x[t - 10 : t + 11] += shape[k]
    path = tmp_path_factory.mktemp("signal") / "a.dat"
    x.astype(np.float32).tofile(path)
    raw.register(spark)
    return x.astype(np.float32), path, shape, truth


def chunks_of(spark, path, chunk=500, halo=100):
    return spark.read.format("recording").options(path=str(path), channels=4, chunk=chunk, halo=halo).load()


def test_filtered_chunks_are_the_whole_filtered(spark, signal):
    x, path, _, _ = signal
    rows = recording.band_pass(chunks_of(spark, path, 1000, 600), 3, 500, 3000, 20000).orderBy("chunk_id").collect()
    y = kernels.filtfilt(x, kernels.butter(3, 500, 3000, 20000))
    for r in rows:
        own = y[r.t_start : r.t_start + r.n]
        assert np.allclose(raw.samples(r)[r.before : r.before + r.n], own - np.median(own, axis=0), atol=1e-3)


def test_deviations_covariance_saturation(spark, signal):
    x, path, _, _ = signal
    chunks = chunks_of(spark, path)
    found = {r.channel: r.mad for r in recording.deviations(chunks).collect()}
    parts = x.reshape(8, 500, 4)
    assert np.allclose([found[c] for c in range(4)], np.median(np.abs(parts - np.median(parts, axis=1, keepdims=True)), axis=1).mean(axis=0), atol=1e-6)
    c = np.zeros((4, 4))
    for r in recording.covariance(chunks).collect():
        c[r.i, r.j] = r.covariance
    assert np.allclose(c, np.cov(x, rowvar=False, bias=True), atol=1e-6)
    assert recording.saturated(chunks, 2.0).count() == (np.abs(x) >= 2.0).sum()


@pytest.mark.parametrize("sign", [-1, 0, 1])
def test_crossings_do_not_depend_on_chunks(spark, signal, sign):
    x, path, _, _ = signal
    found = {(r.channel, r.t) for r in recording.crossings(chunks_of(spark, path), np.full(4, 0.5), 5, sign).collect()}
    brute = {(c, int(t)) for c in range(4) for t in kernels.find_peaks(np.abs(x[:, c]) if sign == 0 else sign * x[:, c], 0.5, 5)}
    assert found == brute


def test_fit_finds_every_event_once(spark, signal):
    _, path, shape, truth = signal
    rows = recording.fit(chunks_of(spark, path), shape, 0.7, 1.3).collect()
    assert sorted((r.template, r.t) for r in rows) == sorted(truth)


def test_snippets(spark, signal):
    x, path, _, truth = signal
    spikes = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(truth)] + [(999, 2)], "event_id long, t long")
    found = {r.event_id: np.array(r.waveform) for r in recording.snippets(chunks_of(spark, path), spikes, 10, 10, 500).collect()}
    assert set(found) == set(range(len(truth)))
    assert all(np.allclose(found[i], x[t - 10 : t + 11].T.ravel()) for i, (_, t) in enumerate(truth))


def test_clusters_of_each_electrode(spark):
    rows = [(e, i, [float(v) for v in RNG.normal(3 * (i % 2), 0.1, 2)]) for e in range(2) for i in range(60)] + [(0, 100, None), (1, 101, [float("nan"), 0.0]), (7, 1, [0.0, 0.0])]
    found = {(r.electrode, r.point_id): r.cluster for r in recording.clusters(spark.createDataFrame(rows, "electrode long, point_id long, features array<double>"), 5, 2).collect()}
    assert len(found) == 121 and found[7, 1] == 0
    for e in range(2):
        even, odd = ({found[e, i] for i in range(s, 60, 2)} for s in (0, 1))
        assert len(even) == len(odd) == 1 and even != odd


def test_sorting_of_a_curation_tool(spark, tmp_path):
    np.save(tmp_path / "spike_times.npy", np.arange(1000, dtype=np.uint64) * 7)
    np.save(tmp_path / "spike_clusters.npy", (np.arange(1000) % 3).astype(np.int32))
    assert curation.read_sorting(spark, str(tmp_path), 300).where("group = 'unsorted'").count() == 1000
    curation.write_groups(spark.createDataFrame([(0, "good"), (1, "noise")], 'cluster_id long, "group" string'.replace('"', "`")), str(tmp_path / "cluster_group.tsv"))
    rows = curation.keep_curated(curation.read_sorting(spark, str(tmp_path), 300)).collect()
    assert {(r.event_id, r.t, r.unit) for r in rows} == {(i, 7 * i, i % 3) for i in range(1000) if i % 3 != 1}
