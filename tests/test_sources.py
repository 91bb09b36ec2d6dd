from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from centime.sources import files, sinks
from centime.streaming.ingest import latest, take_in

PAGE = "<html><body><table><tr><th>Branche</th><th>Recettes</th></tr><tr><td>Maladie</td><td>− 0,1</td></tr></table><table><tr><td><table><tr><td>x</td></tr></table></td></tr></table><a href='a.pdf'>Annexe <b>1</b></a>"


def test_html():
    assert [c for c in files.html_cells(PAGE) if c[0] == 0] == [(0, 0, 0, True, "Branche"), (0, 0, 1, True, "Recettes"), (0, 1, 0, False, "Maladie"), (0, 1, 1, False, "− 0,1")]
    assert files.html_links(PAGE) == [("a.pdf", "Annexe 1")]
    with pytest.raises(ValueError, match="nested"):
        list(files.html_cells(PAGE, strict=True))


def test_files_and_errors(spark, tmp_path):
    (tmp_path / "a.html").write_text(PAGE)
    (tmp_path / "b.html").write_text("")
    cells = files.html_tables(files.binary(spark, str(tmp_path), "*.html")).collect()
    assert len([c for c in cells if c["path"].endswith("a.html")]) == 5 and all(c["error"] is None for c in cells)
    (tmp_path / "c.xlsx").write_bytes(b"no archive")
    assert files.workbook_cells(files.binary(spark, str(tmp_path), "*.xlsx")).first()["error"].startswith("BadZipFile")
    kinds = {r["path"][-1]: r["k"] for r in files.binary(spark, str(tmp_path)).select("path", files.kind_of(F.col("content")).alias("k")).collect()}
    assert kinds == {"l": kinds["l"], "x": "text"}


def test_workbook_round_trip(spark):
    df = spark.createDataFrame([("a & b", 12, None), (None, -3, 1.5)], "label string, n int, x double")
    cells = list(files.xlsx_cells(sinks.xlsx_bytes({"Feuille 1": df})))
    assert [c[2] for c in cells] == ["label", "n", "x", "a & b", "12", "-3", "1.5"] and {c[0] for c in cells} == {"Feuille 1"}


def test_archives():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("d/a.txt", "x")
    assert list(files.archive_members(out.getvalue())) == [("d/a.txt", 1, b"x")]
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("../a.txt", "x")
    with pytest.raises(ValueError, match="unsafe"):
        list(files.archive_members(out.getvalue()))


def test_published_versions(spark, tmp_path):
    root = str(tmp_path / "t")
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert sinks.current(spark, root) is None
    assert sinks.install(a, root, ["k"]) == 2 and sinks.install(a, root, ["k"]) == 0
    assert sinks.install(a.unionByName(spark.createDataFrame([(3, "c")], a.schema)), root, ["k"]) == 1
    with pytest.raises(ValueError, match="lacks"):
        sinks.publish(a.where("k = 1"), root, keep=a)
    assert sinks.read_published(spark, root).count() == 3


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", 2), (None, None)], "a string, b int")
    assert sinks.csv_bytes(df) == "﻿a;b\r\n'=1+1;2\r\n;\r\n".encode()
    sinks.write_csv(df, str(tmp_path / "c"))
    assert files.delimited(spark, str(tmp_path / "c")).first()["a"] == "'=1+1"


def test_intake_is_idempotent(spark, tmp_path):
    source, target, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    spark.createDataFrame([(1, "a")], "k int, v string").write.mode("append").parquet(source)
    assert take_in(spark, source, "k int, v string", target, log) == 1
    assert take_in(spark, source, "k int, v string", target, log) == 0
    spark.createDataFrame([(2, "b")], "k int, v string").write.mode("append").parquet(source)
    assert take_in(spark, source, "k int, v string", target, log) == 1
    assert spark.read.parquet(target).count() == 2


def test_latest_delivery(spark):
    df = spark.createDataFrame([(1, 5, "old"), (1, 7, "new"), (2, 1, None)], "k int, t int, v string")
    assert sorted(map(tuple, latest(df, ["k"], "t").collect())) == [(1, 7, "new"), (2, 1, None)]
