"""Quantities printed in different units and scales, brought to cents.

A multi-pattern automaton over all unit aliases scans each field once; the
longest match wins, a match inside a longer word does not count, and fields are
consulted in a fixed order. The unit found is a code; its factor comes from a
small fixed table that is broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from decimal import Decimal, InvalidOperation
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from centime.functions.lookalike import fold_case

# Unit codes and the power of ten of one unit in euros.
UNITS = {"EUR": 0, "kEUR": 3, "MEUR": 6, "MdEUR": 9}
# Words of scale, and words of currency, as printed (folded).
SCALES = {
    "EUR": [""],
    "kEUR": ["k", "millier", "milliers", "mille", "thousand"],
    "MEUR": ["m", "mio", "million", "millions"],
    "MdEUR": ["md", "mds", "mrd", "mrds", "milliard", "milliards", "billion"],
}
CURRENCIES = ["€", "eur", "euro", "euros", "d'euro", "d'euros"]
#: A scale alone counts beside a number when another scaled term follows ("3 milliards 20 millions d'euros").
BARE = {"milliard": "MdEUR", "milliards": "MdEUR", "md": "MdEUR", "mds": "MdEUR", "million": "MEUR", "millions": "MEUR", "millier": "kEUR", "milliers": "kEUR"}

_SIGN = "[-+]?"
_NUMBER = rf"[0-9](?:[0-9., ']*[0-9])?(?:e{_SIGN}[0-9]+)?"
_TERM = re.compile(rf"({_NUMBER}) ?")
_CODE = re.compile(r"1(?:[ ]?000)*(?:[.,]0+)?|1e[+]?[0-9]+")


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for unit, scales in SCALES.items():
        for scale in scales:
            for currency in CURRENCIES:
                for gap in {"", " "} if scale else {""}:
                    if not scale and currency.startswith("d'"):
                        continue
                    machine.add_word(scale + gap + currency, (unit, len(scale + gap + currency)))
    machine.make_automaton()
    return machine


def find_units(folded: str) -> list[tuple[int, int, str]]:
    """Units of a folded text as (start, end, code): the longest at each place, none inside a longer word."""
    found = []
    for last, (unit, size) in _automaton().iter(folded):
        start, end = last + 1 - size, last + 1
        if start and folded[start].isalpha() and folded[start - 1].isalpha():
            continue
        if end < len(folded) and folded[end].isalpha() and folded[end - 1].isalpha():
            continue
        while found and found[-1][0] >= start:
            found.pop()
        if not found or found[-1][1] <= start:
            found.append((start, end, unit))
        elif found[-1][1] - found[-1][0] < size:
            found[-1] = (start, end, unit)
    return found


def unit_in_text(text: str | None) -> str | None:
    """The one unit a label or context names; None when it names none. Of several the last counts: it is nearest to the cells."""
    if not text:
        return None
    found = find_units(fold_case(text))
    return found[-1][2] if found else None


def unit_of_code(code: str | None) -> str | None:
    """The unit of a coded field: 1000000, 1e6, '1 000' or an alias."""
    if not code:
        return None
    folded = fold_case(code)
    if _CODE.fullmatch(folded):
        try:
            value = Decimal(folded.replace(" ", "").replace(",", "."))
        except InvalidOperation:
            return None
        return next((u for u, power in UNITS.items() if value == Decimal(10) ** power), None)
    return unit_in_text(code)


def parse_number(printed: str) -> Decimal | None:
    """A printed number in any usual layout; None if it is not one.

    Spaces and apostrophes part thousands. Of point and comma the later is the
    decimal sign; one that occurs twice parts thousands; a single one is decimal.
    """
    body, e, power = printed.replace(" ", "").replace("'", "").partition("e")
    point, comma = body.count("."), body.count(",")
    if point and comma:
        decimal = "." if body.rfind(".") > body.rfind(",") else ","
        if body.count(decimal) > 1:
            return None
        body = body.replace("," if decimal == "." else ".", "").replace(decimal, ".")
    elif comma:
        body = body.replace(",", "." if comma == 1 else "")
    elif point > 1:
        body = body.replace(".", "")
    try:
        return Decimal(body + ("e" + power if e else ""))
    except InvalidOperation:
        return None


def parse_amount(raw: str | None) -> tuple[Decimal, str | None] | None:
    """(number, unit beside it or None) of a cell that states an amount, else None.

    Null, blank, missing-value marks, percentages and cells with anything else
    but one amount state none. Several scaled terms add up in the smallest unit;
    parentheses around the number mean minus.
    """
    if not raw:
        return None
    text = fold_case(raw)
    if "%" in text or not any(c.isdigit() for c in text):
        return None
    negative = False
    if text[0] in "-+":
        negative, text = text[0] == "-", text[1:].lstrip()
    bracket = re.match(r"\( ?(-? ?[^()]*?) ?\)", text)
    if bracket:
        inner = bracket[1]
        negative, text = True, " ".join((inner.lstrip("- ") + " " + text[bracket.end() :]).split())
    units = {start: (end, unit) for start, end, unit in find_units(text)}
    at, terms = 0, []
    before = units.pop(0, None)
    if before:
        at = before[0] + (text[before[0] : before[0] + 1] == " ")
        if text[at : at + 1] == "-":
            negative, at = True, at + 1
    while at < len(text):
        match = _TERM.match(text, at)
        if not match:
            return None
        number = parse_number(match[1])
        if number is None:
            return None
        at, unit = match.end(), None
        if at in units:
            at, unit = units[at]
        else:
            word = re.compile(r"[a-z]+").match(text, at)
            if word and word[0] in BARE:
                at, unit = word.end(), BARE[word[0]]
        terms.append((number, unit))
        while at < len(text) and text[at] in " .*":
            at += 1
    if not terms or len(terms) > 1 and any(u is None for _, u in terms):
        return None
    if len(terms) == 1:
        number, unit = terms[0]
        unit = unit or (before[1] if before else None)
    else:
        powers = [UNITS[u] for _, u in terms]
        if sorted(powers, reverse=True) != powers or len(set(powers)) < len(powers):
            return None
        unit = terms[-1][1]
        number = sum(n.scaleb(p - powers[-1]) for (n, _), p in zip(terms, powers, strict=True))
    return (-number if negative else number), unit


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number and unit of each row that states an amount; columns behind the first five go along."""
    label_unit, code_unit = lru_cache(1 << 16)(unit_in_text), lru_cache(1 << 12)(unit_of_code)
    most = Decimal(10) ** 17
    for batch in batches:
        rows, values, units = [], [], []
        columns = [batch.column(i).to_pylist() for i in range(1, 5)]
        for row, (raw, label, code, context) in enumerate(zip(*columns, strict=True)):
            amount = parse_amount(raw)
            if amount is None:
                continue
            unit = amount[1] or label_unit(label) or code_unit(code) or label_unit(context)
            rows.append(row)
            values.append(amount[0].quantize(Decimal("1e-11")) if abs(amount[0]) < most else None)
            units.append(unit)
        at = pa.array(rows, pa.int64())
        carried = {batch.schema.names[i]: batch.column(i).take(at) for i in (0, *range(5, batch.num_columns))}
        yield pa.RecordBatch.from_pydict({**carried, "number": pa.array(values, pa.decimal128(29, 11)), "unit": pa.array(units, pa.string())})


def factors(spark: SparkSession) -> DataFrame:
    """unit, cents_each: one row for each unit code (4 rows, fixed)."""
    return spark.createDataFrame([(u, Decimal(10) ** (p + 2)) for u, p in UNITS.items()], "unit string, cents_each decimal(12,0)")


def to_cents(
    facts: DataFrame,
    key: str = "id",
    raw: str = "raw",
    label: str = "column_label",
    code: str = "unit_eur",
    context: str = "context",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """(id, carried columns, number, unit, cents) of every row whose raw states an amount.

    The unit beside the number counts first, then one in label, then code, then
    one in context; with none at all unit is null and cents is null. Numbers of
    1e17 and more, which are in no cents of a long, have a row with null number and
    cents. cents is rounded half up. Rows that state no amount (null, blank, marks such as n.d.,
    percentages, prose) have no row. Repeated rows each give one. Other columns
    are ignored; an empty table gives no rows. No shuffle.
    """
    fields = [(raw, "raw"), (label, "label"), (code, "code"), (context, "context")]
    read = facts.where(F.col(raw).isNotNull()).select(F.col(key).alias("id"), *(F.col(c).cast("string").alias(f"_{n}") for c, n in fields), *carry)
    kinds = "".join(f", `{c}` {read.schema[c].dataType.simpleString()}" for c in carry)
    found = read.mapInArrow(_resolve, f"id {read.schema['id'].dataType.simpleString()}{kinds}, number decimal(29,11), unit string")
    joined = found.join(F.broadcast(factors(facts.sparkSession)), "unit", "left")
    return joined.select("id", *carry, "number", "unit", F.expr("try_cast(round(number * cents_each) AS bigint)").alias("cents"))


def misstated(facts: DataFrame) -> DataFrame:
    """(id, cents): rows whose raw states an amount while amount_cents is null or another number. Distinct."""
    stated = to_cents(facts, carry=("amount_cents",))
    return stated.where("cents IS NOT NULL AND (amount_cents IS NULL OR amount_cents <> cents)").select("id", "cents").distinct()
