"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
}


def build_session(app: str = "passagework", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings every operator assumes; `extra` uses `__` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


ARROW_BYTES = 8 * 1024 * 1024
# Tables that are written here hold whole texts and numbers: two thirds of the size by the default codec.
CODEC = "zstd"

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="passagework-code-"), "passagework.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


_local_dirs: dict[str, tempfile.TemporaryDirectory] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by the cluster in `spark.checkpoint.dir`.

    Only a local-mode session may go without the setting; it gets one temporary
    folder per application, removed when Python exits.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = context.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.TemporaryDirectory(prefix="passagework-", ignore_cleanup_errors=True)
    return _local_dirs[app].name


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; never reused, so retries cannot collide."""
    return f"{shared_dir(spark)}/passagework/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    Cuts the lineage in a way that survives lost executors, keeps column
    pruning, and gives the next plan true sizes.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.mode("errorifexists").option("compression", CODEC).parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.scratch = path
    return stored


def discard(*stored: DataFrame) -> None:
    """Delete what `materialize` wrote for these tables, once all that reads them is stored."""
    for df in stored:
        delete_scratch(df.sparkSession, df.__dict__.get("scratch"))


def delete_scratch(spark: SparkSession, path: str | None) -> None:
    """Delete a folder that `scratch_path` named; anything else is left alone."""
    if path and path.startswith(f"{shared_dir(spark)}/passagework/"):
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def prepare(spark: SparkSession) -> None:
    """Make a session that someone else built fit for the operators."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # Texts may be long: what a Python worker gets at a time is bounded in bytes, too.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    ship_package(spark)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for a source that Spark reads in fewer partitions than there are cores.

    A table of any size has more splits than cores and is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
