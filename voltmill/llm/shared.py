"""Cutting lineage through files that every executor can read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Steps on a local path are written without ``.crc`` files, as for each file the default starts five ``chmod`` processes, and for these two:
#: the JVM is forked for each, and until the child runs ``chmod`` the executor's memory shows twice. Parquet's own checksums of pages are verified instead.
_PLAINLY = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true", "parquet.page.write-checksum.enabled": "true"}
_VERIFIED = {"parquet.page.verify-checksum.enabled": "true"}

#: Words are runs of anything but these bytes (U+0020, U+0009 to U+000D), in every operator of this package.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where the session names none, one is made and set if driver and executors are one process;
    on a cluster that is an error, as its machines do not share a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back.

    Unlike an in-memory checkpoint the copy outlives any executor, and what follows plans on the real size of the files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/step-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **_PLAINLY).parquet(path)
    held = spark.read.schema(df.schema).options(**_VERIFIED).parquet(path)
    held.__dict__["_step_path"] = path
    return held


def release(*frames: DataFrame) -> None:
    """Deletes the files of materialised tables that nothing reads any more."""
    for df in frames:
        path = df.__dict__.pop("_step_path", None)
        if path:
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which whoever runs a job sets in proportion to the input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
