"""Scalar rules as Column expressions: money, codes, labels, years, stages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that mean a missing value.
MISSING_MARKS = ("", "-", "—", "–", "n.d.", "nd", "na", "n/a", "…")
# Latin letters with marks and what they fold to.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿœæ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyoa"
# French months.
MONTHS = ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre")


def text(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm(c: Column | str) -> Column:
    """Lower-case letters a-z and digits only; accents folded."""
    return F.regexp_replace(F.translate(F.lower(text(c)), MARKED, PLAIN), "[^a-z0-9]", "")


def fold(c: Column | str) -> Column:
    """Lower case without accents; everything else stays."""
    return F.translate(F.lower(text(c)), MARKED, PLAIN)


def clean(c: Column | str) -> Column:
    """Runs of blanks of any kind become one space; none at the ends."""
    return F.trim(F.regexp_replace(text(c), r"(?U)\s+", " "))


def amount_cents(c: Column | str, unit: int | Column = 1) -> Column:
    """A printed amount in units of `unit` euros as integer cents, half up; null for missing marks and for anything else.

    A published 0 stays 0. Blanks of any kind part thousands, a comma or point is
    decimal, U+2212 and dashes before digits are minus signs.
    """
    plain = F.regexp_replace(F.regexp_replace(text(c), r"(?U)[\s'’]", ""), "^[−–—](?=[0-9])", "-")
    plain = F.regexp_replace(plain, ",", ".")
    number = F.when(~F.lower(plain).isin(*MISSING_MARKS), plain)
    unit = F.lit(unit) if isinstance(unit, int) else unit
    value = F.when(number.rlike(r"^[-+]?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$"), number).try_cast("decimal(28,8)")
    return F.round(value * unit.cast("decimal(10,0)") * F.lit(100).cast("decimal(3,0)")).try_cast("bigint")


def quantum_cents(raw: Column | str, unit: int | Column = 1) -> Column:
    """The value of the last printed digit, in cents: the unit over ten to the number of decimals."""
    decimals = F.length(F.regexp_extract(F.regexp_replace(text(raw), ",", "."), r"\.([0-9]+)", 1))
    unit = F.lit(unit) if isinstance(unit, int) else unit
    return unit.cast("double") * 100 / F.pow(F.lit(10.0), decimals)


def raw_quantum(raw: Column | str, unit: Column | str) -> Column:
    """The quantum in euros of a raw figure that is a plain number (blanks, parentheses and any minus sign allowed): its unit over ten to the number of decimals.

    Null for anything else and for a unit that is no number.
    """
    plain = F.btrim(F.translate(F.replace(F.replace(text(raw), F.lit(","), F.lit(".")), F.lit(" "), F.lit("")), "\u2212\u2011\u2013\u2010", "----"), F.lit("()"))
    decimals = F.length(F.regexp_extract(plain, r"\.([0-9]+)", 1))
    number = plain.rlike(r"^[-+]?[0-9]+(\.[0-9]+)?$")
    return F.when(number, text(unit).try_cast("decimal(20,4)").cast("double") / F.pow(F.lit(10.0), decimals))


def code(c: Column | str, width: int) -> Column:
    """'12.0' and ' 7 ' as zero-padded codes; longer ones are kept whole."""
    bare = F.regexp_replace(F.trim(text(c)), r"\.0+$", "")
    return F.when(F.length(bare) >= width, bare).otherwise(F.lpad(bare, width, "0"))


def year_header(c: Column | str) -> Column:
    """The year of a header that is exactly a year, '(p)' allowed; else null."""
    return F.regexp_extract(F.trim(text(c)), r"^(20[0-9]{2})(?:\s*\([pP]\))?$", 1).try_cast("int")


def last_year(c: Column | str) -> Column:
    """The last year 20xx that a text names; null without one."""
    return F.try_element_at(F.regexp_extract_all(text(c), F.lit(r"(?<![0-9])(20[0-9]{2})(?![0-9])"), 1), F.lit(-1)).cast("int")


def stage_for(kind: Column | str, edition: Column | str, year: Column | str) -> Column:
    """The stage of a year's figure in a publication of one kind and edition.

    Its own year: the kind. The year before: the kind corrected; two years before
    and more: stated; later years: a projection. A null in any gives null.
    """
    kind, gap = text(kind), text(edition) - text(year)
    return F.when(gap < 0, "PROJECTION").when(gap == 0, kind).when(gap == 1, F.concat(kind, F.lit("_RECTIF"))).when(gap > 1, "CONSTATE")


def month_key(c: Column | str) -> Column:
    """The latest 'month year' of a French text as YYYY-MM; null without one."""
    found = F.regexp_extract_all(F.lower(text(c)), F.lit(r"((?:" + "|".join(MONTHS) + r") 20[0-9]{2})"), 1)
    numbered = F.create_map(*(x for i, m in enumerate(MONTHS, 1) for x in (F.lit(m), F.lit(f"{i:02d}"))))
    return F.array_max(F.transform(found, lambda m: F.concat(F.element_at(F.split(m, " "), 2), F.lit("-"), numbered[F.element_at(F.split(m, " "), 1)])))


def safe_csv(c: Column | str) -> Column:
    """Text that a spreadsheet would take for a formula gets an apostrophe in front."""
    return F.when(F.ltrim(text(c)).rlike(r"^[=+\-@]"), F.concat(F.lit("'"), text(c))).otherwise(text(c))


def published_cents(cents: Column | str, euros: Column | str) -> Column:
    return F.coalesce(text(cents), text(euros) * 100)


def identity(c: Column | str, length: int = 24) -> Column:
    """The first digits of a text's SHA-256."""
    return F.substring(F.sha2(text(c), 256), 1, length)


def iso_date(millis: Column | str) -> Column:
    return F.date_format(F.timestamp_millis(text(millis)), "yyyy-MM-dd")


def excel_scale(fmt: Column | str) -> Column:
    """What trailing commas of a number format divide the shown value by: 1000 each."""
    return F.pow(F.lit(1000.0), F.length(F.regexp_extract(text(fmt), r"[0#](,+)$", 1))).cast("bigint")


def years_key(years: Column | str) -> Column:
    """Years as |2024|2025|, for substring tests; and back with years_of."""
    return F.concat(F.lit("|"), F.array_join(F.array_sort(F.array_distinct(text(years))).cast("array<string>"), "|"), F.lit("|"))


def years_of(key: Column | str) -> Column:
    return F.transform(F.split(F.btrim(text(key), F.lit("|")), r"\|"), lambda y: y.try_cast("int"))


def constant_cents(cents: Column, index_of_year: Column, index_of_base: Column) -> Column:
    """cents * base / year exactly, rounded half up away from zero; indices are positive integers of one scale. Null without an index."""
    b, c = index_of_base.cast("decimal(12,0)"), index_of_year.cast("decimal(12,0)")
    doubled = F.lit(2).cast("decimal(1,0)") * F.abs(cents).cast("decimal(19,0)") * b + c
    quotient = F.call_function("div", doubled, F.lit(2).cast("decimal(1,0)") * c)
    return F.when((c > 0) & (b > 0), F.signum(cents.cast("double")).cast("bigint") * quotient)
