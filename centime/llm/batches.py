"""Runs of rows over record batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def spread(df: DataFrame, key: str, tasks: int) -> DataFrame:
    """df parted by key, over as many tasks as needed, so that what one takes does not grow with the data; few tasks are left to AQE."""
    few = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, key) if tasks > few else df.repartition(key)


def whole_runs(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """Consecutive rows, at least so many and all of their last key (the first column, in order); each row is copied once."""
    held: list[pa.RecordBatch] = []
    count, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        edges = (np.flatnonzero(key[1:] != key[:-1]) + 1).tolist()
        if last is not None and key[0] != last:
            edges.insert(0, 0)
        begin = 0
        for edge in edges:
            if count + edge - begin >= least:
                if edge > begin:
                    held.append(batch.slice(begin, edge - begin))
                yield pa.Table.from_batches(held)
                held, count, begin = [], 0, edge
        held.append(batch.slice(begin))
        count += batch.num_rows - begin
        last = key[-1]
    if held:
        yield pa.Table.from_batches(held)
