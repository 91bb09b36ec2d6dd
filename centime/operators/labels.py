"""What headings, labels and formats of published tables mean, as rules over their text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from centime.functions.scalars import norm

# Headings of a table's columns, normalised, and the metric they hold.
HEADINGS = {
    "RECETTES": ("recettes", "previsionsderecettes", "previsionderecettes"),
    "DEPENSES": ("depenses", "objectifsdedepenses", "objectifdedepenses", "previsionsdedepenses"),
    "SOLDE": ("solde",),
}


def header_metric(text: Column) -> Column:
    """The metric of a column heading; null for any other text."""
    plain, found = norm(text), None
    for metric, names in HEADINGS.items():
        found = F.when(plain.isin(*names), metric) if found is None else found.when(plain.isin(*names), metric)
    return found


def route(text: Column, rules: dict[str, str], otherwise: str | None = None) -> Column:
    """The name of the first rule (name -> pattern over the folded text) that matches."""
    found = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, pattern in rules.items():
        found = found.when(text.rlike(pattern), name)
    return found.otherwise(F.lit(otherwise)) if otherwise is not None else found


def result_column(heading: Column) -> Column:
    """Whether a heading is that of results, and not of a gap, a revision or an earlier estimate."""
    plain = norm(heading)
    return plain.rlike("constat|realis|execut") & ~plain.rlike("ecart|revision|previs|evolution")


def cell_kind(raw: Column) -> Column:
    """empty, percent, zero, number or text: what a printed cell holds."""
    plain = F.regexp_replace(F.translate(raw, "−–", "--"), r"(?U)[\s'’]", "")
    number = plain.rlike(r"^[-+]?\(?[0-9][0-9.,]*\)?$")
    return (
        F.when(F.coalesce(plain, F.lit("")) == "", "empty").when(plain.endswith("%"), "percent").when(number & ~plain.rlike("[1-9]"), "zero").when(number, "number").otherwise("text")
    )


def last_part(code: Column) -> Column:
    """The last part of a dotted code, two digits at least: '03.7' as '07'."""
    last = F.element_at(F.split(code, r"\."), -1)
    return F.when(F.length(last) >= 2, last).otherwise(F.lpad(last, 2, "0"))


def column_key(heading: Column, year: Column) -> Column:
    """A heading that names a year by its distance ('N', 'N-1', 'N+1') as that year; null otherwise."""
    plain = F.translate(F.upper(F.regexp_replace(heading, r"(?U)\s", "")), "−–", "--")
    return F.when(plain == "N", year).when(plain.rlike(r"^N[-+][0-9]$"), year + F.substring(plain, 2, 2).try_cast("int"))


def money_text(cents: Column) -> Column:
    """Cents as printed in French: thousands parted by a blank, a decimal comma, two decimals."""
    whole, rest = F.call_function("div", F.abs(cents), F.lit(100)), F.abs(cents) % 100
    grouped = F.translate(F.format_number(whole, 0), ",", " ")
    return F.concat(F.when(cents < 0, "-").otherwise(""), grouped, F.lit(","), F.lpad(rest.cast("string"), 2, "0"))
