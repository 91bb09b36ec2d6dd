"""Indexes and metadata on the shared folder: gates before reading, atomic small files, logs, ordered exports, deadlines."""

from __future__ import annotations

import contextlib
import json
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, path: str):  # noqa: ANN202
    made = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return made(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), made


def write_small_json(spark: SparkSession, path: str, value: object) -> None:
    """One JSON document, members in order: written aside and renamed over the old one, so readers see either."""
    fs, made = _files(spark, path)
    aside = made(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(aside, True)
    out.write(bytearray(json.dumps(value, ensure_ascii=False, sort_keys=True, indent=1).encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(aside, made(path), options)


def read_small_json(spark: SparkSession, path: str) -> object | None:
    """A JSON document; None where there is no file."""
    fs, made = _files(spark, path)
    if not fs.exists(made(path)):
        return None
    return json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))


def json_records(spark: SparkSession, path: str, schema: str, known: dict[tuple, DataFrame]) -> DataFrame:
    """Records of a JSON file, read again only when its time or size has changed; without a file none. known keeps what was read."""
    fs, made = _files(spark, path)
    if not fs.exists(made(path)):
        return spark.createDataFrame([], schema)
    state = fs.getFileStatus(made(path))
    key = (path, state.getModificationTime(), state.getLen())
    if key not in known:
        for old in [k for k in known if k[0] == path]:
            del known[old]
        known[key] = spark.read.schema(schema).option("multiLine", True).json(path)
    return known[key]


def with_audit(meta: DataFrame, audit: dict | None, signature: str) -> DataFrame:
    """meta (key, value as JSON) and, only if the audit succeeded and is of this very build and content, a row with it (without its single checks)."""
    built = meta.where("key = 'built_at'").select(F.col("value").alias("_built"))
    if not audit or not audit.get("success") or audit.get("signature") != signature:
        return meta.select("key", "value")
    kept = json.dumps({k: v for k, v in audit.items() if k != "checks"}, sort_keys=True)
    told = built.where(F.col("_built") == F.lit(json.dumps(audit.get("built_at")))).select(F.lit("reconciliation").alias("key"), F.lit(kept).alias("value"))
    return meta.select("key", "value").unionByName(told)


def check_manifest(found: dict, wanted: dict, parts: dict[str, int], base: dict | None = None) -> None:
    """Raises ValueError unless an index is the one wanted: every wanted member (version, model, revision, size of vectors) equal,
    every part there with the size stated, and, for a supplement, bound to the digest of its base."""
    for name, value in wanted.items():
        if found.get(name) != value:
            raise ValueError(f"index: {name} is {found.get(name)!r}, not {value!r}")
    for name, size in found.get("parts", {}).items():
        if parts.get(name) != size:
            raise ValueError(f"index: part {name} has {parts.get(name)} bytes, not {size}")
    if base is not None and found.get("base_digest") != base.get("digest"):
        raise ValueError("index: the supplement is of another base")


def vector_parts(spark: SparkSession, path: str, key: str, vector: str, size: int) -> DataFrame:
    """Vectors of an index in parts; raises unless keys are 1 to the number of rows, each once, and all vectors have `size` entries."""
    read = spark.read.parquet(path)
    first, last, count, distinct, wrong = read.agg(
        F.min(key), F.max(key), F.count(F.lit(1)), F.count_distinct(key), F.count(F.when(F.col(vector).isNull() | (F.size(vector) != size), 1))
    ).first()
    if count and (first != 1 or last != count or distinct != count or wrong):
        raise ValueError(f"vectors: keys {first} to {last}, {distinct} of {count} distinct, {wrong} of another size")
    return read


def append_log(rows: DataFrame, path: str) -> None:
    """Rows added to a log of JSON lines; what is there stays."""
    rows.write.mode("append").json(path)


def write_projection(df: DataFrame, path: str, fields: list[str]) -> None:
    """The named fields as CSV, in that order; other columns are ignored, absent ones blank."""
    chosen = [F.col(f).cast("string").alias(f) if f in df.columns else F.lit(None).cast("string").alias(f) for f in fields]
    df.select(*chosen).write.mode("overwrite").option("header", True).csv(path)


def export_with_catalogue(df: DataFrame, path: str, order: str, parts: int) -> list[dict]:
    """JSON lines in total order over `parts` files, and the closed catalogue of what each holds: rows, first and last key, digest.

    The catalogue is read back from the files, so it states what is there.
    """
    df.repartitionByRange(parts, order).sortWithinPartitions(order).write.mode("errorifexists").json(path)
    written = df.sparkSession.read.schema(df.schema).json(path).withColumn("_file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    told = written.groupBy("_file").agg(F.count(F.lit(1)).alias("rows"), F.min(order).alias("first"), F.max(order).alias("last"), F.bit_xor(F.xxhash64(*df.columns)).alias("digest"))
    catalogue = [r.asDict() for r in told.orderBy("first").collect()]
    write_small_json(df.sparkSession, f"{path}/_catalogue.json", catalogue)
    return catalogue


@contextlib.contextmanager
def deadline(spark: SparkSession, seconds: float) -> Iterator[None]:
    """Jobs started inside are cancelled after some seconds; the caller gets a TimeoutError."""
    group, late = f"deadline-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        spark.sparkContext.cancelJobGroup(group)

    timer = threading.Timer(seconds, stop)
    spark.sparkContext.setJobGroup(group, "deadline", interruptOnCancel=True)
    timer.start()
    try:
        yield
    except Exception as error:
        if late.is_set():
            raise TimeoutError(f"no result within {seconds} seconds") from error
        raise
    finally:
        timer.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
