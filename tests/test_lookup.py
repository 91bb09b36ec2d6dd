from __future__ import annotations

from pyspark.sql import functions as F

from centime.operators import lookup, status
from centime.operators.explorer import confirmed_totals, position_cells, without_part


def test_assembling(spark):
    df = spark.createDataFrame([(" ", "b", 1, None), ("a", "c", 1, 2)], "x string, y string, m int, n int")
    assert [r[0] for r in df.select(lookup.first_filled(df, "absent", "x", "y")).collect()] == ["b", "a"]
    assert [r[0] for r in df.select(lookup.strict_sum("m", "n")).collect()] == [None, 3]
    labels = [spark.createDataFrame([(1, "old"), (2, "only")], "k int, l string"), spark.createDataFrame([(1, "new"), (2, None)], "k int, l string")]
    assert sorted(map(tuple, lookup.nomenclature(labels, ["k"], "l").collect())) == [(1, "new"), (2, "only")]


def test_labels_and_headings(spark):
    cut = spark.createDataFrame([("abcdefghijklm",), ("abcdefghijkl",), ("short",), (None,)], "l string")
    whole = spark.createDataFrame([("abcdefghijklmno",), ("abcdefghijklxyz",), ("short label",)], "l string")
    assert [tuple(r) for r in lookup.rescue_labels(cut, whole, "l").collect()] == [("abcdefghijklm", "abcdefghijklmno")]
    texts = spark.createDataFrame([("regime general puis fsv",), ("fsv puis regime general",), ("rien",), (None,)], "t string")
    got = [r[0] for r in texts.select(lookup.last_heading(F.col("t"), {"regime general": "RG", "fsv": "FSV"})).collect()]
    assert got == ["FSV", "RG", None, None]


def test_gaps_partitions_and_ranges(spark):
    rows = spark.createDataFrame([("a", 2019), ("a", 2022), ("b", 2020), ("b", None)], "k string, y int")
    assert sorted(map(tuple, lookup.missing_years(rows, ["k"], "y").collect())) == [("a", 2020), ("a", 2021)]
    whole, x, y = (spark.createDataFrame([(i,) for i in part], "k int") for part in ([1, 2, 3], [1, 2], [2, 4]))
    assert sorted(map(tuple, lookup.partition_faults(whole, [x, y], "k").collect())) == [(2, True, 2), (3, True, 0), (4, False, 1)]
    ranges = spark.createDataFrame([("a", 0, 5), ("a", 5, 9), ("b", 0, 5), ("b", 6, 9)], "k string, s int, e int")
    assert [tuple(r) for r in lookup.contiguous(ranges, ["k"], "s", "e").collect()] == [("b", 1)]


def test_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0]), (3, None), (4, [float("nan"), 0.0]), (5, [2.0, 0.0]), (6, [None, 1.0])]
    df = spark.createDataFrame(rows, "k int, v array<float>")
    assert sorted(map(tuple, lookup.vector_faults(df, "k", "v", 2).collect())) == [(2, "size"), (3, "size"), (4, "entry"), (5, "norm"), (6, "entry")]


def test_position_cells(spark):
    rows = [
        (2020, "a/1", "1", 10), (2020, "a/2", "2", 5), (2021, "a/1", "1", 7), (2022, "a/3/x", "3", 1), (2023, "a", "0", 9), (2024, "b", "9", 9), (2025, "a/3/y", "3", 2), (2025, "a/1", "1", None),
    ]
    df = spark.createDataFrame(rows, "y int, path string, program string, cents bigint")
    cells = position_cells(df, "a", ["a/3/x", "a/9"], ["y"])
    got = {r["y"]: (r["value"], r["status"]) for r in cells.collect()}
    assert got == {2020: (15, "partial"), 2021: (7, "partial"), 2022: (0, "excluded"), 2023: (None, "detail_unavailable"), 2025: (2, "partial")}
    totals = spark.createDataFrame([(2020, 15), (2021, 8)], "y int, total bigint")
    assert {r["y"]: r["status"] for r in confirmed_totals(cells, totals, ["y"]).where("y < 2022").collect()} == {2020: "ok", 2021: "partial"}
    part = spark.createDataFrame([(2020, 20), (2021, 3)], "y int, part bigint")
    assert {r["y"]: (r["rest"], r["rest_status"]) for r in without_part(cells, part, ["y"]).where("y < 2023").collect()} == {2020: (None, "part_exceeds_whole"), 2021: (4, "ok"), 2022: (None, "unavailable")}


def test_status_order(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, None)], "k int, v int")
    rules = ((F.col("k") == 1, "first"), (F.col("k") <= 2, "second"), (F.col("v").isNull(), "missing"))
    assert [r["status"] for r in status.with_status(df, "v", *rules).orderBy("k").collect()] == ["first", "second", "missing"]
    assert [r[0] for r in df.select(status.last_reason(*rules)).collect()] == ["second", "second", "missing"]
