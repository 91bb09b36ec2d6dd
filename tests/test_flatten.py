from __future__ import annotations

import json

from centime.operators.flatten import amounts_titles_labels, flatten, table_of, write_tables

RAW = "registry string, record_id bigint, payload string, tag string"


def raw(spark, *payloads):
    return spark.createDataFrame([(r, i, p, "clash") for i, (r, p) in enumerate(payloads)], RAW)


def test_cases_of_raw_payloads(spark):
    comparisons = [None, {"values_cents": {"RECETTES": 0}}, {"values_cents": {"RECETTES": "12"}}, {"values_cents": {"RECETTES": "n.d."}}, {"values_cents": None}, {}, 7]
    payloads = [
        ("source-reconciliation", json.dumps({"items": [{"comparisons": []}, {"comparisons": comparisons}]})),
        ("delivery-check", json.dumps([{"supporting_documents": {"title": "x", "n": 1}}, {"supporting_documents": [{"title": "  "}, None, {"title": "y"}]}])),
        ("actions-p174", json.dumps({"parent": {"program_label": "p"}, "parents": None})),
        ("actions-p174", json.dumps({"groups": [{"parents": [{"program_label": ""}, {"program_label": " "}]}]})),
        ("actions-p174", '{"groups": [{"parent": {"program_label": "lost"'),
        ("actions-p174", None),
        ("actions-p174", ""),
        ("actions-p174", "[]"),
        ("actions-p174", '{"groups": [{"parent": {"program_label": NaN}}]}'),
    ]
    got = sorted(map(tuple, amounts_titles_labels(raw(spark, *payloads)).collect()))
    assert got == [
        ("actions-p174", 2, 0, 0),
        ("actions-p174", 3, 0, 1),
        ("delivery-check", 1, 0, 0),
        ("delivery-check", 1, 1, 2),
        ("source-reconciliation", 0, 1, 1),
        ("source-reconciliation", 0, 1, 2),
    ]


def test_typed_tables_and_children_of_children(spark, tmp_path):
    groups = spark.createDataFrame(
        [(9, {"program_label": "a"}, [None, {"program_label": "b"}], [{"code": "01", "cents": 5, "subactions": [{"code": "01.1"}, {"code": "01.2"}]}])],
        "record_id bigint, parent struct<program_label:string>, parents array<struct<program_label:string>>, actions array<struct<code:string,cents:bigint,subactions:array<struct<code:string>>>>",
    )
    tagged = flatten(action_groups=groups)
    rows = sorted((r["tag"], r["field"] or "", r["child_no"], r["parent_tag"] or "", r["parent_no"] or 0) for r in tagged.collect())
    assert rows == [
        ("action", "actions", 0, "item", 0),
        ("item", "", 0, "", 0),
        ("parent", "parent", 0, "item", 0),
        ("parent", "parents", 1, "item", 0),
        ("subaction", "subactions", 0, "action", 0),
        ("subaction", "subactions", 1, "action", 0),
    ]
    assert [r["code"] for r in table_of(tagged, "action").collect()] == ["01"]
    write_tables(tagged, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("tag = 'subaction'").count() == 2
    empty = amounts_titles_labels(raw(spark, ("x", "[]")).where("false"), action_groups=groups.where("false"))
    assert empty.collect() == []


def test_each_flat_table_is_a_query(spark, tmp_path):
    from centime.operators.flatten import SCHEMAS
    from centime.plans.queries import queries

    item = {"stage": "PLF", "parents": [{"program_label": "p", "cents": 3}, {"title": "t", "field": "f"}], "actions": [{"code": "01", "subactions": [{"code": "01.1", "euros": 5}]}], "comparisons": [{"edition": "1", "values_cents": {"RECETTES": 7}}]}
    raw(spark, ("actions-p174", json.dumps([item, item]))).write.parquet(str(tmp_path / "registry_raw.parquet"))
    for name in ("source_reconciliation", "delivery_check", "action_groups"):
        spark.createDataFrame([(4, {"program_label": name})], "record_id bigint, parent struct<program_label:string>").write.parquet(str(tmp_path / f"{name}.parquet"))
    found = {tag: queries()[f"registry_{tag}"](spark, str(tmp_path)).collect() for tag in SCHEMAS}
    assert {tag: len(rows) for tag, rows in found.items()} == {"item": 5, "comparison": 2, "document": 0, "evidence": 0, "parent": 7, "action": 2, "subaction": 2}
    assert sorted((r["record_id"], r["item_no"], r["child_no"], r["program_label"], r["title"], r["cents"]) for r in found["parent"] if r["field"] == "parents" and r["child_no"] == 0) == [(0, 0, 0, "p", None, "3"), (0, 1, 0, "p", None, "3")]
    assert {(r["parent_tag"], r["parent_no"], r["code"], r["euros"]) for r in found["subaction"]} == {("action", 0, "01.1", "5")}
    assert {(r["edition"], r["values_cents_recettes"]) for r in found["comparison"]} == {("1", "7")}
    assert sum(r["parent_field"] == "f" for r in found["parent"]) == 2
    assert all(len(set(queries()[f"registry_{tag}"](spark, str(tmp_path)).columns)) == len(queries()[f"registry_{tag}"](spark, str(tmp_path)).columns) for tag in SCHEMAS)
