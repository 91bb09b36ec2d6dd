from __future__ import annotations

from decimal import Decimal

import pytest

from centime.operators.units import misstated, parse_amount, to_cents, unit_in_text, unit_of_code


@pytest.mark.parametrize(
    ("raw", "number", "unit"),
    [
        ("69.132,3 millions d’euros", "69132.3", "MEUR"),
        ("(3 817,8) millions €", "-3817.8", "MEUR"),
        ("− 12,7", "-12.7", None),
        ("159 Md€ 162 M€", "159162", "MEUR"),
        ("38 milliards 614 millions d’euros", "38614", "MEUR"),
        ("1.492838Е+6", "1492838", None),  # Cyrillic exponent sign
        ("１０７ ３７０ k€", "107370", "kEUR"),
        ("3​601,0", "3601.0", None),
        ("12.287 MdEUR", "12.287", "MdEUR"),
        ("0", "0", None),
    ],
)
def test_amounts(raw, number, unit):
    assert parse_amount(raw) == (Decimal(number), unit)


@pytest.mark.parametrize("raw", [None, "", " ", "-", "—", "n.d.", "ND", "n/a", "12,5 %", "３６ ％", "abc 12", "12 34 x"])
def test_no_amount(raw):
    assert parse_amount(raw) is None


def test_units_in_text():
    assert unit_in_text("Tableau 3. Données en M€, arrondies.") == "MEUR"
    assert unit_in_text("2019, milliards d’euros") == "MdEUR"
    assert unit_in_text("europe") is None
    assert unit_in_text(None) is None
    assert [unit_of_code(c) for c in ("1000", "1 000 000", "1E9", "1.0", "Md€", "7", None)] == ["kEUR", "MEUR", "MdEUR", "EUR", "MdEUR", None, None]


SCHEMA = "id bigint, raw string, column_label string, unit_eur string, context string, amount_cents bigint, unit string, number string"


def test_field_order_and_extra_columns(spark):
    rows = [
        (1, "2 M€", "en k€", "1", "en Md€", 1, "clash", "clash"),
        (2, "2", "2019 (en k€)", "1", "en Md€", 200000, None, None),
        (3, "2", "2019", "1000000", "en Md€", None, None, None),
        (4, "2", "2019", None, "(en Md€)", 2, None, None),
        (5, "2", "2019", None, None, 2, None, None),
        (6, "n.d.", None, None, None, None, None, None),
        (2, "2", "2019 (en k€)", "1", "en Md€", 200000, None, None),
        (7, "1" * 40, None, "1", None, 3, None, None),
    ]
    facts = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r["id"], r["unit"], r["cents"]) for r in to_cents(facts).collect())
    assert got == [(1, "MEUR", 200000000), (2, "kEUR", 200000), (2, "kEUR", 200000), (3, "MEUR", 200000000), (4, "MdEUR", 200000000000), (5, None, None), (7, "EUR", None)]
    assert sorted(map(tuple, misstated(facts).collect())) == [(1, 200000000), (3, 200000000), (4, 200000000000)]
    assert misstated(facts.where("false")).collect() == []
