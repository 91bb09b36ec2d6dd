"""Incremental intake of delivered parts: each part once, however often a run is repeated.

The file source's own log and an idempotent sink give what a batch with a
checkpoint for each part would.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def take_in(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, fmt: str = "parquet") -> int:
    """Append parts that are new in `source` to `target`, one directory a batch, and stop. Returns the rows of this run.

    A batch that is run again after a failure overwrites its own directory, so
    the target has every row exactly once.
    """
    counted: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number:09d}")
        counted.append(spark.read.parquet(f"{target}/batch={number:09d}").count())

    stream = spark.readStream.schema(schema).format(fmt).load(source)
    run = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    return sum(counted)


def latest(deliveries: DataFrame, key: list[str], arrived: str) -> DataFrame:
    """Of rows delivered again, the one that arrived last; equal times go to the least row."""
    others = [c for c in deliveries.columns if c not in (*key, arrived)]
    newest = F.max_by(F.struct(*others), F.struct(arrived, F.negative(F.xxhash64(*others)))).alias("_row")
    return deliveries.groupBy(*key).agg(F.max(arrived).alias(arrived), newest).select(*key, arrived, "_row.*")


def events_by_window(events: DataFrame, time: str = "ts", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums by event type and time window, batch or stream; late rows beyond the watermark are dropped by the stream."""
    dated = events.withColumn(time, F.col(time).cast("timestamp"))
    if events.isStreaming:
        dated = dated.withWatermark(time, late)
    return dated.groupBy(F.window(time, width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
