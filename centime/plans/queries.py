"""Registry of the core's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from centime.plans import explorer, passages, published, retrieval, tables
from centime.session import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from centime.operators.flatten import REGISTRIES, amounts_titles_labels

    return amounts_titles_labels(table(spark, sf_dir, "registry_raw"), **{n: table(spark, sf_dir, n) for n in REGISTRIES})


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from centime.operators.units import misstated

    return misstated(table(spark, sf_dir, "pdf_facts"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**published.QUERIES, **passages.QUERIES, **explorer.QUERIES, **retrieval.QUERIES, **tables.QUERIES, **{f.__name__: f for f in (p3_found, p4_found)}}


_P3 = r"""WITH r AS (SELECT registry, record_id, CAST(payload AS JSON) AS p FROM registry_raw WHERE json_valid(payload)),
c AS (SELECT registry, record_id, CASE WHEN json_type(p) = 'ARRAY' THEN p WHEN json_exists(p, '$.items') THEN p -> '$.items' WHEN json_exists(p, '$.source_arithmetic_notices') THEN p -> '$.source_arithmetic_notices'
  WHEN json_exists(p, '$.groups') THEN p -> '$.groups' ELSE json_array(p) END AS a FROM r),
i AS (SELECT registry, record_id, unnest(range(len(l))) AS item_no, unnest(l) AS it FROM (SELECT registry, record_id, CAST(CASE WHEN json_type(a) = 'ARRAY' THEN a ELSE json_array(a) END AS JSON[]) AS l FROM c)),
f AS (SELECT registry, record_id, item_no, 'c' AS t, it -> '$.comparisons' AS x FROM i UNION ALL SELECT registry, record_id, item_no, 'd', it -> '$.supporting_documents' FROM i
  UNION ALL SELECT registry, record_id, item_no, 'p', it -> '$.parent' FROM i UNION ALL SELECT registry, record_id, item_no, 'p', it -> '$.parents' FROM i
  UNION ALL SELECT 'source-reconciliation', record_id, 0, 'c', to_json(comparisons) FROM source_reconciliation UNION ALL SELECT 'delivery-check', record_id, 0, 'd', to_json(supporting_documents) FROM delivery_check
  UNION ALL SELECT 'actions-p174', record_id, 0, 'p', to_json(parent) FROM action_groups UNION ALL SELECT 'actions-p174', record_id, 0, 'p', to_json(parents) FROM action_groups),
k AS (SELECT registry, record_id, item_no, t, unnest(range(len(l))) AS child_no, unnest(l) AS y FROM (SELECT registry, record_id, item_no, t, CAST(CASE WHEN json_type(x) = 'ARRAY' THEN x ELSE json_array(x) END AS JSON[]) AS l FROM f WHERE x IS NOT NULL AND json_type(x) <> 'NULL'))
SELECT DISTINCT registry, record_id, CAST(item_no AS INTEGER) AS item_no, CAST(child_no AS INTEGER) AS child_no FROM k
WHERE (t = 'c' AND regexp_matches(y ->> '$.values_cents.RECETTES', '^\s*[-+]?[0-9]+([.][0-9]+)?([eE][-+]?[0-9]+)?\s*$')) OR (t = 'd' AND trim(y ->> '$.title') <> '') OR (t = 'p' AND (y ->> '$.program_label') <> '')"""


def _p4() -> str:
    """Amounts by patterns over folded text: characters of one look first, then sign, brackets, number and units, one or two terms."""
    from centime.functions.lookalike import HOMOGLYPHS, invisible, shape_of

    wide = {chr(c): shape_of(chr(c)) for c in (*range(0xA0, 0x2500), *range(0xFF01, 0xFF5F), 0x3000) if len(shape_of(chr(c))) == 1 and shape_of(chr(c)) != chr(c)}
    shapes = {**wide, **HOMOGLYPHS, "’": "'", "−": "-", "–": "-", "\t": " "}
    gone = "".join(chr(c) for c in (0xAD, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0xFE00, 0xFE10), 0xFEFF) if invisible(chr(c)))
    source, target = ("".join(x).replace("'", "''") for x in (shapes, shapes.values()))

    def fold(column: str) -> str:
        return f"trim(regexp_replace(lower(strip_accents(translate({column}, '{source}{gone}', '{target}'))), '\\s+', ' ', 'g'))"

    scales = "milliards|milliard|billion|mrds|mrd|mds|md|millions|million|mio|milliers|millier|mille|thousand|m|k"
    unit, bare = f"(?:(?:{scales}) ?)?(?:d''euros|d''euro|euros|euro|eur|€)", "milliards|milliard|mds|md|millions|million|milliers|millier"
    number = "[0-9](?:[0-9., '']*[0-9])?(?:e[-+]?[0-9]+)?"
    one = f"^([-+]?) ?(\\(?) ?(-?) ?((?:{unit})?) ?(-?) ?({number}) ?((?:{unit}|{bare})?) ?(\\)?) ?((?:{unit}|{bare})?)[ .*]*$"
    two = f"^([-+]?) ?({number}) ?({unit}|{bare}) ?({number}) ?({unit}|{bare})[ .*]*$"

    def power(u: str) -> str:
        return f"CASE WHEN {u} IS NULL OR {u} = '' THEN NULL WHEN regexp_matches({u}, '^(md|mrd|milliard|billion)') THEN 9 WHEN regexp_matches({u}, '^(millier|mille|k|thousand)') THEN 3 WHEN regexp_matches({u}, '^(mio|million|m)') THEN 6 ELSE 0 END"

    def value(n: str) -> str:
        body = f"replace(replace(split_part({n}, 'e', 1), ' ', ''), '''', '')"
        points, commas = (f"(length({body}) - length(replace({body}, '{c}', '')))" for c in ".,")
        comma_last = f"strpos(reverse({body}), ',') < strpos(reverse({body}), '.')"
        plain = f"""CASE WHEN {points} > 0 AND {commas} > 0 THEN CASE WHEN {comma_last} THEN CASE WHEN {commas} = 1 THEN replace(replace({body}, '.', ''), ',', '.') END WHEN {points} = 1 THEN replace({body}, ',', '') END
  WHEN {commas} > 1 THEN replace({body}, ',', '') WHEN {commas} = 1 THEN replace({body}, ',', '.') WHEN {points} > 1 THEN replace({body}, '.', '') ELSE {body} END"""
        return f"TRY_CAST({plain} || CASE WHEN contains({n}, 'e') THEN 'e' || split_part({n}, 'e', 2) ELSE '' END AS DECIMAL(28,11))"

    def named(column: str) -> str:
        return f"list_last(regexp_extract_all({fold(column)}, '(?:^|[^\\p{{L}}])({unit})(?:$|[^\\p{{L}}])', 1))"

    def cents(x: str, p: str) -> str:
        return f"({x} * CAST(CASE {p} WHEN 0 THEN 100 WHEN 3 THEN 100000 WHEN 6 THEN 100000000 WHEN 9 THEN 100000000000 END AS BIGINT)::DECIMAL(12,0))"

    code = f"regexp_replace({fold('unit_eur')}, '[ ]|[.,]0+$', '', 'g')"
    return f"""WITH t AS (SELECT id, amount_cents, {fold("raw")} AS t, {power(named("column_label"))} AS p2, CASE WHEN regexp_matches({code}, '^1(000)*$') THEN length({code}) - 1 WHEN regexp_matches({code}, '^1e[+]?[0-9]+$') THEN TRY_CAST(replace(split_part({code}, 'e', 2), '+', '') AS INTEGER)
  ELSE {power(named("unit_eur"))} END AS p3, {power(named("context"))} AS p4 FROM pdf_facts WHERE raw IS NOT NULL),
m AS (SELECT *, regexp_extract(t, '{one}', ['sign', 'bracket', 'minus', 'ahead', 'minus2', 'n', 'u1', 'closed', 'u2']) AS a, regexp_extract(t, '{two}', ['sign', 'n1', 'u1', 'n2', 'u2']) AS b, regexp_matches(t, '{one}') AS single, regexp_matches(t, '{two}') AS paired FROM t WHERE NOT contains(t, '%')),
v AS (SELECT id, amount_cents, single, paired, p2, p3, p4, {value("a.n")} AS x, {power("coalesce(nullif(a.u1, ''), nullif(a.u2, ''), nullif(a.ahead, ''))")} AS p1, a.sign = '-' OR (a.bracket = '(' AND a.closed = ')') OR a.minus = '-' OR a.minus2 = '-' AS negative,
  (a.bracket = '(') <> (a.closed = ')') AS unbalanced, {value("b.n1")} AS y1, {power("b.u1")} AS q1, {value("b.n2")} AS y2, {power("b.u2")} AS q2, b.sign = '-' AS minus2 FROM m),
w AS (SELECT id, amount_cents, CASE WHEN single AND NOT unbalanced THEN CASE WHEN negative THEN -1 ELSE 1 END * {cents("x", "coalesce(p1, p2, CASE WHEN p3 IN (0, 3, 6, 9) THEN p3 END, p4)")}
  WHEN paired AND q1 > q2 THEN CASE WHEN minus2 THEN -1 ELSE 1 END * ({cents("y1", "q1")} + {cents("y2", "q2")}) END AS c FROM v)
SELECT DISTINCT id, CAST(round(c) AS BIGINT) AS cents FROM w WHERE c IS NOT NULL AND abs(c) < 9000000000000000000 AND (amount_cents IS NULL OR amount_cents <> round(c))"""


def oracle_sql() -> dict[str, str]:
    return {**published.SQL, **passages.SQL, **explorer.SQL, **retrieval.SQL, **tables.SQL, "p3_found": _P3, "p4_found": _p4()}
