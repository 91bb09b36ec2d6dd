"""Session, table access and durable intermediate tables."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Whether Spark deletes a query's shuffle files as it ends; else they stay until the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_scratch: list[str] = []
_written: list[str] = []


def session(app: str = "centime", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for (UTC, AQE, small local shuffles)."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**base, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; column pruning and filters reach the parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for durable intermediates: spark.checkpoint.dir, else a temporary one, on a local master only."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not (spark.conf.get("spark.master", None) or spark.sparkContext.master).split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _scratch:
        _scratch.append(tempfile.mkdtemp(prefix="centime-"))
        import atexit

        atexit.register(shutil.rmtree, _scratch[0], ignore_errors=True)
    return "file://" + os.path.abspath(_scratch[0])


@contextmanager
def _shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Queries that run meanwhile leave no shuffle files."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def durable(df: DataFrame, name: str = "step", by: list[str] | None = None) -> DataFrame:
    """Write df once to the shared folder, partitioned by some columns if asked, and read it back.

    Cuts lineage and survives the loss of executors; used where a result feeds
    several consumers or an iteration. Nothing is kept in executors' memory,
    and what was shuffled for it is deleted when it is written.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/centime/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    with _shuffles_deleted(spark):
        (writer.partitionBy(*by) if by else writer).parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def on_all_cores(df: DataFrame) -> DataFrame:
    """df in at least as many pieces as there are cores: a table that comes in fewer, as one small file does, is dealt out.

    For work that costs more than moving the rows; tables of many files stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def release(spark: SparkSession) -> int:
    """Delete the intermediates that durable has written so far; for when no result of them will be read again."""
    removed = 0
    while _written:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_written.pop())
        removed += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return removed


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once for each context; they need no installation of it."""
    import zipfile
    from pathlib import Path

    context = spark.sparkContext
    if getattr(context, "_centime_shipped", False):
        return spark
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="centime-zip-")) / "centime_package.zip"
    with zipfile.ZipFile(archive, "w") as file:
        for source in sorted(root.rglob("*.py")):
            file.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._centime_shipped = True
    return spark
