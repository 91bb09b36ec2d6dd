from __future__ import annotations

import json
import time

import pytest
from pyspark.sql import functions as F

from centime.operators import adapters, budget, labels, lookup, search, textprep
from centime.plans.parameters import Explorer, Matrix, Search
from centime.sources import index


def test_parameters():
    stages = ("PLF", "LF", "CONSTATE")
    assert Matrix.of({"start": "2024", "end": "2024", "stages": "LF,CONSTATE", "exclude": "FAMILLE"}, stages).excluded == ("FAMILLE",)
    for wrong in ({"domain": "X"}, {"domain": "ONDAM", "perimeter": "RG"}, {"domain": "ONDAM", "metric": "SOLDE"}, {"start": "2026", "end": "2020"}, {"start": "20x"}, {"stages": "LF,LF"}, {"stages": "Z"}, {"perimeter": "FSV", "exclude": "FAMILLE"}):
        with pytest.raises(ValueError):
            Matrix.of(wrong, stages)
    assert Explorer.of({"exclude": '["M1/123"]', "constant": "1"}).constant
    for wrong in ({"scope": "a/b"}, {"exclude": "{}"}, {"exclude": "["}, {"exclude": json.dumps(["M"] * 101)}, {"measure": "X"}, {"base": "2026"}, {"topic": "t"}):
        with pytest.raises(ValueError):
            Explorer.of(wrong)
    asked = Search.of({"q": " Le fonds ", "year": "2024", "limit": "50"})
    assert (asked.text, asked.year, asked.limit, asked.phrase(1)) == ("Le fonds", 2024, 50, ['"Le"'])
    for wrong in ({"q": "x" * 201}, {"limit": "0"}, {"limit": "51"}, {"year": "1999"}, {"format": "doc"}, {"mode": "dense"}):
        with pytest.raises(ValueError):
            Search.of(wrong)


GRID = [["Branche", "Recettes", "Dépenses", "Solde"], ["Maladie", "10,5", "11", "- 0,5"], ["Famille", "0", "n.d.", "1"], ["Autre", "1", "2", "3"]]
YEARS = [["", "", "2023", "2024 (p)"], ["Maladie", "Recettes", "1", "2"], ["", "Dépenses", "3", "4"], ["Ensemble", "", "", ""], ["", "Solde", "5", "6"], ["Famille", "Solde", "7", "x"]]


def grid(no, rows):
    return [(no, r, c, text) for r, row in enumerate(rows) for c, text in enumerate(row)]


def test_tables_become_facts(spark):
    cells = spark.createDataFrame(grid(0, GRID) + grid(1, YEARS) + grid(2, [["a", "b"], ["1", "2"]]), "t int, row_index int, column_index int, text string")
    contexts = spark.createDataFrame([(0, "Loi de 2024 (en milliards d'euros)"), (1, "Annexe, en millions"), (2, "en millions")], "t int, context string")
    entities = spark.createDataFrame([("maladie", "MALADIE"), ("famille", "FAMILLE")], "label string, entity string")
    found = {(r["t"], r["entity"], r["metric"], r["year"]): r["cents"] for r in adapters.table_facts(cells, contexts, entities, ["t"]).collect()}
    assert found == {
        (0, "MALADIE", "RECETTES", 2024): 1_050_000_000_000, (0, "MALADIE", "DEPENSES", 2024): 1_100_000_000_000, (0, "MALADIE", "SOLDE", 2024): -50_000_000_000,
        (0, "FAMILLE", "RECETTES", 2024): 0, (0, "FAMILLE", "SOLDE", 2024): 100_000_000_000,
        (1, "MALADIE", "RECETTES", 2023): 100_000_000, (1, "MALADIE", "RECETTES", 2024): 200_000_000, (1, "MALADIE", "DEPENSES", 2023): 300_000_000, (1, "MALADIE", "DEPENSES", 2024): 400_000_000,
        (1, "FAMILLE", "SOLDE", 2023): 700_000_000,
    }
    assert adapters.table_facts(cells.where("false"), contexts, entities, ["t"]).collect() == []


def test_workbooks(spark):
    cells = [("A1", "en millions"), ("B2", "Constat 2023"), ("C2", "Prévision 2024"), ("A3", "Fonds"), ("B3", "12,5"), ("C3", "7"), ("A4", "Part"), ("B4", "0"), ("AB5", "5 %"), ("A6", "2023"), ("B6", "9")]
    rows = [("f", "s", c, raw, "0%" if c == "B6" else "General", None, None) for c, raw in cells] + [("g", None, None, None, None, None, "BadZipFile")]
    held = spark.createDataFrame(rows, "path string, sheet string, cell string, raw string, format string, formula string, error string")
    told = adapters.workbook_inventory(held).collect()
    assert [(r["path"], r["cells"], r["rows"], r["columns"], r["zeros"], r["percents"], r["unit"]) for r in told] == [("f", 11, 6, 28, 1, 2, 10**6)]
    assert {(r["cell"], r["label"], r["year"], r["cents"]) for r in adapters.column_annex(held, 10**6).collect()} == {("B3", "Fonds", 2023, 1_250_000_000), ("B4", "Part", 2023, 0), ("B6", "2023", 2023, 900_000_000)}
    assert {(r["cell"], r["year"], r["heading"]) for r in adapters.row_annex(held, 1).collect()} == {("B6", 2023, "Constat 2023")}


def test_levels_are_carried_down(spark):
    rows = [(1, 1, "A"), (2, 2, "a"), (3, None, "x"), (4, 2, "b"), (5, 1, "B"), (6, None, "y")]
    df = spark.createDataFrame([("s", *r) for r in rows], "s string, n int, level int, code string")
    got = {r["n"]: (r["level_1"], r["level_2"]) for r in adapters.hierarchy_rows(df, ["s"], [F.asc("n")], "level", "code", 2).collect()}
    assert got == {1: ("A", None), 2: ("A", "a"), 3: ("A", "a"), 4: ("A", "b"), 5: ("B", None), 6: ("B", None)}


def test_small_files_logs_and_exports(spark, tmp_path):
    path = str(tmp_path / "meta.json")
    assert index.read_small_json(spark, path) is None
    index.write_small_json(spark, path, {"b": 1, "a": "é"})
    index.write_small_json(spark, path, {"b": 2, "a": "é"})
    assert index.read_small_json(spark, path) == {"a": "é", "b": 2}
    known = {}
    assert index.json_records(spark, str(tmp_path / "none.json"), "a string", known).count() == 0
    first = index.json_records(spark, path, "a string, b int", known)
    assert first.collect()[0]["b"] == 2 and index.json_records(spark, path, "a string, b int", known) is first
    for _ in range(2):
        index.append_log(spark.createDataFrame([(1, "ok")], "n int, result string"), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    df = spark.createDataFrame([(i, f"t{i}", "x") for i in range(20)], "id int, text string, extra string")
    index.write_projection(df, str(tmp_path / "csv"), ["text", "absent", "id"])
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["text", "absent", "id"]
    catalogue = index.export_with_catalogue(df, str(tmp_path / "export"), "id", 3)
    assert sum(p["rows"] for p in catalogue) == 20 and all(a["last"] < b["first"] for a, b in zip(catalogue, catalogue[1:], strict=False))


def test_gates(spark, tmp_path):
    found = {"version": 2, "model": "m", "parts": {"a": 5}, "base_digest": "d"}
    index.check_manifest(found, {"version": 2, "model": "m"}, {"a": 5}, {"digest": "d"})
    for wanted, parts, base in (({"version": 1}, {"a": 5}, None), ({"version": 2}, {"a": 4}, None), ({"version": 2}, {}, None), ({"version": 2}, {"a": 5}, {"digest": "e"})):
        with pytest.raises(ValueError):
            index.check_manifest(found, wanted, parts, base)
    spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 1.0])], "seq int, v array<double>").write.parquet(str(tmp_path / "good"))
    spark.createDataFrame([(1, [1.0, 2.0]), (3, [0.0])], "seq int, v array<double>").write.parquet(str(tmp_path / "bad"))
    assert index.vector_parts(spark, str(tmp_path / "good"), "seq", "v", 2).count() == 2
    with pytest.raises(ValueError):
        index.vector_parts(spark, str(tmp_path / "bad"), "seq", "v", 2)
    meta = spark.createDataFrame([("built_at", '"t"')], "key string, value string")
    audit = {"success": True, "built_at": "t", "signature": "s", "checks": [1]}
    assert index.with_audit(meta, audit, "s").count() == 2 and index.with_audit(meta, audit, "other").count() == 1 and index.with_audit(meta, {**audit, "built_at": "u"}, "s").count() == 1


def test_deadline(spark):
    with pytest.raises(TimeoutError), index.deadline(spark, 1.0):
        spark.range(4, numPartitions=4).mapInPandas(lambda parts: (time.sleep(20) or p for p in parts), "id long").count()
    with index.deadline(spark, 60):
        assert spark.range(3).count() == 3


def test_exclusions_and_changes(spark):
    rows = [(1, "m/p", None, 2, 100), (1, "m/p/01", "m/p", 3, 60), (1, "m/p/02", "m/p", 3, 39), (1, "m/p/01/a", "m/p/01", 4, 20), (1, "m/p/01/b", "m/p/01", 4, 41), (2, "m/q", None, 2, 7), (3, "m/p", None, 2, None)]
    nodes = spark.createDataFrame([(r, p, up, d, "l", c, "s", 1) for r, p, up, d, c in rows], "record_id bigint, path string, parent_path string, depth int, label string, cents bigint, source string, page int")

    def of(*exclusions):
        result, proofs = budget.subtract(nodes, spark.createDataFrame([(e,) for e in exclusions], "path string"))
        return {r["record_id"]: (r["cents"], r["status"]) for r in result.collect()}, sorted((r["record_id"], r["path"], r["cents"]) for r in proofs.where("operation = 'subtract'").collect())

    assert of("m/p/01/a", "m/p/01/b") == ({1: (40, "computed"), 2: (7, "unchanged"), 3: (None, "detail_unavailable")}, [(1, "m/p/01", -60)])
    assert of("m/p/01/a") == ({1: (80, "computed"), 2: (7, "unchanged"), 3: (None, "detail_unavailable")}, [(1, "m/p/01/a", -20)])
    assert of("m/p/01", "m/p/02", "m/p/01/a")[0][1] == (0, "fully_excluded")
    assert of("m/p/09")[0] == {1: (None, "detail_unavailable"), 2: (7, "unchanged"), 3: (None, "detail_unavailable")}
    assert of("m")[0][2] == (0, "fully_excluded")
    current = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2), ("c", None)], "k string, v bigint")
    changes = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("b", 2, 3), ("c", None, 4), ("z", 1, 2)], "k string, before bigint, after bigint")
    got = sorted((r["k"], r["before"] or 0, r["status"], r["impact"]) for r in budget.apply_changes(current, changes, ["k"], "v").collect())
    assert got == [("a", 1, "applied", 4), ("a", 2, "value_changed", None), ("b", 2, "ambiguous", None), ("c", 0, "applied", None), ("z", 1, "missing", None)]


def test_labels(spark):
    def one(expression):
        return spark.range(1).select(expression.alias("x")).first()["x"]

    assert one(labels.header_metric(F.lit("Prévisions de recettes"))) == "RECETTES" and one(labels.header_metric(F.lit("Total"))) is None
    assert one(labels.result_column(F.lit("Constaté 2023"))) and not one(labels.result_column(F.lit("Écart au constaté")))
    assert [one(labels.cell_kind(F.lit(x))) for x in ("", "0,0", "− 12 %", "(1 234)", "n.d.", None)] == ["empty", "zero", "percent", "number", "text", "empty"]
    assert [one(labels.column_key(F.lit(x), F.lit(2024))) for x in ("N", "N − 1", "n+1", "M")] == [2024, 2023, 2025, None]
    assert [one(labels.money_text(F.lit(x))) for x in (123456789, -5, 0)] == ["1 234 567,89", "-0,05", "0,00"]
    assert one(labels.last_part(F.lit("03.7"))) == "07" and one(labels.last_part(F.lit("12"))) == "12"


def test_filling_recovery_and_search_rules(spark):
    rows = spark.createDataFrame([("s", 1, "a", "x"), ("s", 2, None, "x"), ("s", 3, None, "y"), ("s", 4, "b", None), ("s", 5, None, None)], "s string, n int, v string, c string")
    got = {r["n"]: r["w"] for r in lookup.forward_fill(rows, ["s"], [F.asc("n")], {"v": "w"}, changes="c").collect()}
    assert got == {1: "a", 2: "a", 3: None, 4: "b", 5: "b"}
    segments = spark.createDataFrame([("k", 0, 3, "un "), ("k", 3, 5, "et"), ("l", 1, 3, "ab"), ("m", 0, 2, "ab"), ("m", 2, 3, "c")], "k string, b int, e int, t string")
    told = {r["k"]: (r["moved"], r["wrong_length"], r["word_split"]) for r in textprep.recover(segments, ["k"], "b", "e", "t").collect()}
    assert told == {"k": (False, False, False), "l": (True, False, False), "m": (False, False, True)}
    hits = spark.createDataFrame([(1, 0.5), (2, 0.9), (3, 0.1), (4, 0.2)], "seq bigint, score double")
    cites = spark.createDataFrame([(1, "s", "page:1", "t", "x", 1), (2, "s", "page:1/bloc:2", "t", "x", 1), (3, "s", "feuille:2", None, "x", None), (3, "r", "page:9", "a", "x", 9)], "seq bigint, asset_sha string, locator string, title string, source_id string, page int")
    assert sorted((r["seq"], r["asset_sha"], r["page_key"]) for r in search.first_per_page(hits, cites, "seq").collect()) == [(2, "s", "1"), (3, "r", "9")]
    numbers = spark.range(5)
    assert [(r["id"], r["place"], r["truncated"]) for r in search.first_rows(numbers, [F.desc("id")], 2).collect()] == [(4, 1, True), (3, 2, True)]
    assert search.first_rows(numbers.where("false"), [F.desc("id")], 2).collect() == []
