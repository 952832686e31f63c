"""A recording's folder of results and the steps that fill it, by name."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import sorting
from .operators import benchmark, recording, validation
from .operators import sorting as sorter
from .sources import curation, raw


@dataclass
class Run:
    """Tables are Parquet under ``folder``, which all executors share; ``table(name)`` reads one back, ``steps`` lists what can be run.

    options: path, layout, channels and the rest of the recording source; chunk and halo in steps.
    """

    spark: SparkSession
    folder: str
    options: dict
    settings: sorter.Settings = field(default_factory=sorter.Settings)
    band: tuple[float, float] = (300.0, 9500.0)

    def __post_init__(self) -> None:
        raw.register(self.spark)
        self.chunk, self.halo = int(self.options.get("chunk", 1 << 16)), int(self.options.get("halo", 4 * self.settings.steps))
        self.steps: dict[str, Callable[[], None]] = {n: getattr(self, f"_{n}") for n in ("filtering", "whitening", "thresholding", "clustering", "extracting", "fitting", "merging", "gathering", "converting", "deconverting", "benchmarking", "validating")}

    def run(self, *names: str) -> Run:
        for name in names:
            self.steps[name]()
        return self

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.folder, name))

    def has(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(os.path.join(self.folder, name))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def write(self, name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(os.path.join(self.folder, name))

    def chunks(self) -> DataFrame:
        """The whitened chunks, else the filtered ones, else the recording."""
        for name in ("whitened", "filtered"):
            if self.has(name):
                return self.table(name)
        return self.spark.read.format("recording").options(**{**{k: str(v) for k, v in self.options.items()}, "chunk": str(self.chunk), "halo": str(self.halo)}).load()

    @property
    def channels(self) -> int:
        return self.chunks().select("channels").first()[0]

    def _filtering(self) -> None:
        self.write("filtered", recording.band_pass(self.chunks(), 3, *self.band, self.settings.rate))

    def _whitening(self) -> None:
        chunks = self.chunks()
        self.write("whitened", recording.whiten(chunks, recording.whitening_matrix(chunks)))

    def _thresholding(self) -> None:
        c = self.chunks()
        limits = sorter.thresholds(c, self.settings.threshold, self.channels)
        self.write("thresholds", self.spark.createDataFrame([(k, float(v)) for k, v in enumerate(limits)], "channel int, threshold double"))
        self.write("crossings", recording.crossings(c, limits, max(1, self.settings.steps // 4), self.settings.sign))

    def _put(self, t: sorter.Templates) -> None:
        rows = [(k, int(t.electrode[k]), int(t.size[k]), float(t.purity[k]), float(t.bounds[k, 0]), float(t.bounds[k, 1]), t.waves[k].ravel().tolist(), t.second[k].ravel().tolist()) for k in range(len(t.waves))]
        self.write("templates", self.spark.createDataFrame(rows, "template int, electrode int, size long, purity double, low double, high double, wave array<double>, second array<double>").coalesce(1))

    def templates(self) -> sorter.Templates:
        rows = self.table("templates").orderBy("template").collect()  # one row for each unit
        shape = (len(rows), self.settings.steps, self.channels)
        stack = lambda n: np.array([r[n] for r in rows], np.float64).reshape(shape)
        return sorter.Templates(stack("wave"), stack("second"), np.array([(r.low, r.high) for r in rows]).reshape(-1, 2), np.array([r.electrode for r in rows], int), np.array([r["size"] for r in rows], int), np.array([r.purity for r in rows]))

    def _clustering(self) -> None:
        self._put(sorter.find_templates(self.chunks(), self.channels, self.settings, self.chunk))

    def _extracting(self) -> None:
        """Templates of the table ``given`` (template, t), whose spikes come from elsewhere."""
        half, given = self.settings.steps // 2, self.table("given").withColumn("event_id", F.xxhash64("template", "t"))
        waves = recording.snippets(self.chunks(), given, half, half, self.chunk).join(given.select("event_id", F.col("template").cast("long").alias("electrode")), "event_id")
        rows = sorter.extract(waves, given.select(F.col("template").cast("long").alias("electrode"), "event_id", F.lit(0).alias("cluster")), self.channels, self.settings)
        shape = (len(rows), self.settings.steps, self.channels)
        stack = lambda n: np.array([r[n] for r in rows], np.float64).reshape(shape)
        waves_, n = stack("template"), len(rows)
        best = np.abs(waves_).max(axis=1).argmax(axis=1) if n else np.zeros(0, int)
        self._put(sorter.Templates(waves_, stack("second"), np.tile([0.5, 1.5], (n, 1)), best, np.array([r["size"] for r in rows], int), np.ones(n)))

    def _fitting(self) -> None:
        t, c = self.templates(), self.chunks()
        limits = sorter.thresholds(c, self.settings.threshold * 0.5, self.channels)
        spikes = recording.fit(c, t.waves, t.bounds[:, 0], t.bounds[:, 1], thresholds=limits, sign=self.settings.sign) if len(t.waves) else self.spark.createDataFrame([], "template int, t long, amp double, amp2 double")
        self.write("spikes", spikes)
        if self.has("crossings"):
            self.write("garbage", recording.unfitted(self.table("crossings"), self.table("spikes"), self.settings.steps // 2))

    def _merging(self) -> None:
        """Units whose templates are alike become one, in ``spikes`` and ``templates``."""
        t = self.templates()
        into = sorting.merge_similar(sorting.similarity(t.waves.transpose(0, 2, 1)), t.size, self.settings.cc_merge) if len(t.waves) else np.zeros(0, int)
        kept = np.unique(into)
        pairs = self.spark.createDataFrame([(int(k), int(np.searchsorted(kept, into[k]))) for k in range(len(into))], "template int, unit int")
        self.write("merged", self.table("spikes").join(pairs, "template").select(F.col("unit").alias("template"), "t", "amp", "amp2"))
        groups = [into == k for k in kept]
        bounds = np.array([(t.bounds[g, 0].min(), t.bounds[g, 1].max()) for g in groups]).reshape(-1, 2)
        self._put(sorter.Templates(t.waves[kept], t.second[kept], bounds, t.electrode[kept], np.array([t.size[g].sum() for g in groups]), np.array([t.purity[g].mean() for g in groups])))

    def _gathering(self) -> None:
        """All events in one table: spikes, and what no template explains."""
        name = "merged" if self.has("merged") else "spikes"
        all_ = self.table(name).select(F.lit("spike").alias("kind"), F.col("template").alias("unit"), "t", "amp")
        if self.has("garbage"):
            all_ = all_.unionByName(self.table("garbage").select(F.lit("garbage").alias("kind"), F.col("channel").alias("unit"), "t", F.col("amp")))
        self.write("events", all_)

    def _converting(self) -> None:
        t = self.templates()
        positions = [(0.0, float(c)) for c in range(self.channels)]
        similar = sorting.similarity(t.waves.transpose(0, 2, 1)) if len(t.waves) else np.zeros((0, 0))
        curation.export(os.path.join(self.folder, "curated"), self.table("merged" if self.has("merged") else "spikes"), t.waves, positions, similar, self.settings.rate)

    def _deconverting(self) -> None:
        events = curation.keep_curated(curation.read_sorting(self.spark, os.path.join(self.folder, "curated")))
        self.write("curated_spikes", events.select(F.col("unit").alias("template"), "t"))

    def _benchmarking(self) -> None:
        """Copies of the templates in the recording: the tables ``benchmark`` (chunks without halos) and ``truth``."""
        kind, t = self.options.get("benchmark", "fitting"), self.templates()
        units = benchmark.kind(kind, len(t.waves))
        waves = benchmark.shuffled(t.waves, units)
        bare = self.spark.read.format("recording").options(**{**{k: str(v) for k, v in self.options.items()}, "chunk": str(self.chunk), "halo": "0"}).load()
        self.write("benchmark", benchmark.inject(bare, waves, units, self.settings.rate))
        self.write("truth", benchmark.truth(bare, waves, units, self.settings.rate))

    def _validating(self) -> None:
        """Recall and precision of the best template of each unit of ``truth``, two milliseconds apart at most."""
        truth = self.table("truth").withColumn("event_id", F.xxhash64("unit", "t"))
        spikes = self.table("spikes").withColumn("event_id", F.xxhash64("template", "t"))
        self.write("validation", validation.best_template(truth, spikes, int(0.002 * self.settings.rate)))
