from __future__ import annotations

from collections import Counter

import pytest

from centime.llm.lookalikes import Classes, Form, Rewriter, look_classes, one_form, same_look


def rewriter(*texts):
    return Rewriter(Form(Counter("".join(texts))))


@pytest.mark.parametrize(
    ("a", "b"),
    [("１２３", "123"), ("é", "é"), ("n​.d­.", "n.d."), ("1 234", "1 234"), ("ﬁn", "fin"), ("fіn", "ﬁn"), ("Rеcеttеs", "Recettes"), ("ⅿіl", "mil"), ("е́", "é"), ("％", "%"), ("－1", "-1"), ("​", "")],
)
def test_same_look(a, b):
    rewrite = rewriter(a, b)
    assert rewrite(a) == rewrite(b)


@pytest.mark.parametrize(("a", "b"), [("E", "e"), ("e", "é"), ("a  b", "a b"), ("−1", "-1"), ("l’a", "l'a"), ("1*", "1"), ("oe", "œ"), ("–", "—"), ("2", "²"), (" a", "a")])
def test_other_look(a, b):
    rewrite = rewriter(a, b)
    assert rewrite(a) != rewrite(b)


def test_the_most_frequent_member_represents_its_class():
    assert rewriter("ааа", "a")("a") == "а"  # Cyrillic is more frequent here
    assert rewriter("а", "aa")("а") == "a"


def test_union_find_is_transitive():
    classes = Classes()
    for a, b in (("a", "b"), ("c", "d"), ("b", "c"), ("x", "y")):
        classes.join(a, b)
    assert classes.find("a") == classes.find("d") != classes.find("x")
    assert sorted(map(len, classes.members().values())) == [2, 4]


SCHEMA = "id bigint, raw string, row_label string, source_id string, table_index int, field string"


def test_pairs(spark):
    rows = [
        (1, "12", "Fonds", "s", 0, "clash"), (2, "１2", "Fоnds", "s", 0, None), (3, "12", "fonds", "s", 0, None), (4, "12", None, "s", 1, None), (5, "１2", "", None, 0, None),
        (6, None, "​", "s", 0, None), (7, None, "", "s", 0, None), (2, "１2", "Fоnds", "s", 0, None),
    ]
    facts = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, same_look(facts).collect())) == [("raw", 1, 2), ("raw", 2, 3), ("row_label", 1, 2), ("row_label", 6, 7)]
    assert same_look(facts.where("false")).collect() == []
    classes = [(r["field"], r["id"], r["class"]) for r in look_classes(facts).collect()]
    assert sorted(classes) == [("raw", 1, 1), ("raw", 2, 1), ("raw", 3, 1), ("row_label", 1, 1), ("row_label", 2, 1), ("row_label", 6, 6), ("row_label", 7, 6)]
    assert look_classes(facts.where("false")).collect() == []
    assert [r["raw_form"] for r in one_form(facts.where("id = 6"), ["raw"]).collect()] == [None]
