from __future__ import annotations

from pathlib import Path

from centime.session import durable


def test_durable_leaves_no_shuffle_files(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()

    def shuffled():
        return {p for d in dirs for p in Path(d).rglob("shuffle_*.data")}

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = shuffled(), spark.conf.get(key, None)
    rows = durable(spark.range(1000).repartition(7, "id"), "kept")
    assert shuffled() <= before and rows.count() == 1000
    assert spark.conf.get(key, None) == setting
