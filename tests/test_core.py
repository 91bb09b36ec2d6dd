from __future__ import annotations

import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from centime.functions import scalars
from centime.operators import cells, paths, rates, reconcile, search, textprep
from centime.operators.hierarchy import attach, resolve


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "unit", "cents"),
    [("", 10**9, None), (" ", 1, None), ("-", 1, None), ("—", 1, None), ("n.d.", 1, None), ("0,0", 10**9, 0), ("− 12,7", 10**9, -1270000000000), ("1 234,56", 1, 123456), ("x1", 1, None), ("1e3", 1, 100000)],
)
def test_amount(spark, raw, unit, cents):
    assert one(spark, scalars.amount_cents(F.lit(raw), unit)) == cents


def test_scalars(spark):
    assert one(spark, scalars.year_header(F.lit("2025 (p)"))) == 2025
    assert one(spark, scalars.year_header(F.lit("2025-2026"))) is None
    assert one(spark, scalars.last_year(F.lit("de 2019 à 2021"))) == 2021
    assert one(spark, scalars.norm(F.lit("Équilibre n° 3"))) == "equilibren3"
    assert one(spark, scalars.code(F.lit("12.0"), 3)) == "012"
    assert one(spark, scalars.code(F.lit("12345"), 3)) == "12345"
    assert one(spark, scalars.safe_csv(F.lit(" =1+1"))) == "' =1+1"
    assert one(spark, scalars.month_key(F.lit("mars 2020, puis août 2021"))) == "2021-08"
    assert one(spark, scalars.excel_scale(F.lit("0,,"))) == 1000000
    stages = [one(spark, scalars.stage_for(F.lit(k), F.lit(e), F.lit(y))) for k, e, y in (("BILL", 2027, 2027), ("BILL", 2027, 2026), ("BILL", 2027, 2025), ("LAW", 2026, 2027), ("LAW", 2026, 2025))]
    assert stages == ["BILL", "BILL_RECTIF", "CONSTATE", "PROJECTION", "LAW_RECTIF"]
    assert one(spark, scalars.raw_quantum(F.lit("(1 234,50)"), F.lit("1000"))) == 10.0
    assert one(spark, scalars.raw_quantum(F.lit("12 M€"), F.lit("1000"))) is None


def test_constant_money_is_exact(spark):
    draw = random.Random(5)
    rows = [(draw.randrange(-(10**14), 10**14), draw.randrange(1, 200000), draw.randrange(1, 200000)) for _ in range(500)]
    df = spark.createDataFrame(rows, "a bigint, c bigint, b bigint")
    got = df.select("a", "b", "c", scalars.constant_cents(F.col("a"), F.col("c"), F.col("b")).alias("x")).collect()
    for r in got:
        assert r["x"] == int((Decimal(r["a"]) * r["b"] / r["c"]).quantize(Decimal(1), ROUND_HALF_UP))


FACT = "id bigint, pos string, priority int, amount bigint, precision bigint, quantum bigint"


def test_cell_ties_and_intervals(spark):
    rows = [
        (1, "a", 2, 100, 10, 10), (2, "a", 2, 104, 2, 2), (3, "a", 1, 999, 0, 1),  # agree within rounding: the finest counts
        (4, "b", 2, 100, 1, 1), (5, "b", 2, 104, 1, 1),  # do not
        (6, "c", 1, 7, 0, 1), (7, "c", 1, 7, 0, 1), (8, "d", 1, None, 0, 1),
    ]
    facts = spark.createDataFrame(rows, FACT)
    got = cells.select_cells(facts, ["pos"], [F.col("priority")], "amount", F.col("precision"), F.col("quantum"), [F.col("id")])
    found = {r["pos"]: (r["value"], r["status"], r["references_n"], r["earlier_n"], r["alternatives"]) for r in got.collect()}
    assert found == {"a": (104, "rounded_consistency", 2, 1, 2), "b": (None, "divergence", 2, 0, 2), "c": (7, "published", 2, 0, 0)}
    roles = cells.cell_references(facts, ["pos"], [F.col("priority")], "amount", "id")
    assert sorted((r["id"], r["role"]) for r in roles.collect()) == [(1, "reference"), (2, "reference"), (3, "earlier"), (4, "reference"), (5, "reference"), (6, "reference"), (7, "reference")]


def test_cells_do_not_overflow(spark):
    most = (1 << 63) - 1
    facts = spark.createDataFrame([(1, "a", None, most, 5, None), (2, "a", None, most - 2, 5, 1), (3, None, 1, -most, None, 1)], FACT)
    got = cells.select_cells(facts, ["pos"], [F.col("priority")], "amount", F.col("precision"), F.col("quantum"), [F.col("id")])
    assert {r["pos"]: (r["value"], r["status"]) for r in got.collect()} == {"a": (most - 2, "rounded_consistency"), None: (-most, "published")}


def test_paths(spark):
    df = spark.createDataFrame([("2/8",), ("2/88",), ("2/8/x",)], "p string")
    assert [r[0] for r in df.select(paths.within(F.col("p"), "2/8")).collect()] == [True, False, True]
    assert paths.outermost(["a", "a/b", "ab", "c/d"]) == ["a", "ab", "c/d"]
    assert one(spark, paths.node_path(F.lit("a"), F.lit(""), F.lit(None).cast("string"), F.lit("b"))) == "a/b"
    scopes = spark.createDataFrame([("",), ("2/8",)], "scope string")
    assert sorted((r["scope"], r["n"]) for r in paths.under_scopes(df.withColumnRenamed("p", "path"), scopes).groupBy("scope").agg(F.count("*").alias("n")).collect()) == [("", 3), ("2/8", 2)]


def test_resolve(spark):
    parents = spark.createDataFrame([("a", 103), ("b", 10), ("c", 5), ("d", 9)], "path string, cents bigint")
    children = spark.createDataFrame([("a", "a/1", 40), ("a", "a/2", 60), ("b", "b/1", 10), ("d", "d/1", None), ("d", "d/2", 1)], "parent string, path string, cents bigint")
    got = {r["path"]: (r["cents"], r["removed"], r["status"]) for r in resolve(parents, children, ["a/1", "b/1", "d/1"]).collect()}
    assert got == {"a": (63, 40, "computed"), "b": (0, 10, "fully_excluded"), "c": (5, 0, "unchanged"), "d": (None, 0, "detail_unavailable")}


def test_attach_only_unchanged(spark):
    parents = spark.createDataFrame([("p", 10, "s"), ("q", 11, "s")], "k string, cents bigint, source string")
    groups = spark.createDataFrame([("p", 10, "s", ["x"]), ("q", 10, "s", ["y"])], "k string, reviewed_cents bigint, source string, parts array<string>")
    assert {r["k"]: r["parts"] for r in attach(parents, groups, ["k"], "cents", "parts").collect()} == {"p": ["x"], "q": None}


def test_years_with_gaps(spark):
    series = spark.createDataFrame([("a", 2019, 100), ("a", 2021, 110), ("a", 2022, 121)], "k string, y int, v bigint")
    got = {r["y"]: r["g"] for r in rates.with_reference(series, ["k"], "y", "v").select("y", rates.growth(F.col("v"), F.col("prior")).alias("g")).collect()}
    assert got == {2019: None, 2021: None, 2022: 10.0}


def test_multisets_and_precedence(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    b = spark.createDataFrame([(1,), (3,)], "k int")
    assert sorted(((r["k"] or 0), r["side"], r["surplus"]) for r in reconcile.difference(a, b).collect()) == [(0, "only_first", 1), (1, "only_first", 1), (2, "only_first", 1), (3, "only_second", 1)]
    x, y = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([(1, "y"), (2, "y")], "k int, v string")
    assert sorted((r["k"], r["v"]) for r in reconcile.precedence_merge([x, y], ["k"], ["v"]).collect()) == [(1, "x"), (2, "y")]
    assert reconcile.content_digest(a).first() == reconcile.content_digest(a.orderBy(F.desc("k"))).first()


def test_tiling():
    text = "un deux trois quatre cinq six"
    assert textprep.tiles(text, ["un deux trois", "trois quatre", "cinq six"], 1)
    assert not textprep.tiles(text, ["un deux", "quatre cinq six"], 1)
    assert not textprep.tiles(text, ["un deux trois", "deux trois quatre cinq six"], 1)
    assert not textprep.tiles(text, ["un deux trois"], 1)
    assert textprep.tiles("a b a b", ["a b", "a b"], 0)
    assert textprep.tiles("e\u0301te\u0301  a\nb", ["été a", "b"], 0)
    assert textprep.tiles("", [], 0) and not textprep.tiles("a", [""], 0) and not textprep.tiles("a", [], 0)
    assert not textprep.tiles("a b c", ["b c", "a b c"], 9)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab ", min_size=1, max_size=10), st.lists(st.text(alphabet="ab ", min_size=1, max_size=5), max_size=4), st.integers(0, 2))
def test_tiling_against_all_alignments(source, chunks, most):
    text, parts = textprep._flat(source), [textprep._flat(c) for c in chunks]

    def goes(no, begin, end):
        if no == len(parts):
            return end == len(text)
        for at in range(begin, len(text)):
            until = at + len(parts[no])
            if not parts[no] or text[at:until] != parts[no] or until <= end or text[end:at].strip() or at > end + 1:
                continue
            marks = [m.start() for m in textprep._TOKEN.finditer(text)]
            if sum(at <= m < end for m in marks) <= most and goes(no + 1, at, until):
                return True
        return False

    assert textprep.tiles(source, chunks, most) == goes(0, 0, 0)


def test_search(spark):
    docs = spark.createDataFrame([(1, "Fonds de solidarité"), (2, "fonds"), (3, None), (4, "")], "k bigint, t string")
    assert [r["k"] for r in search.bm25(docs, "k", "t", ["fonds", "solidarite"]).collect()] == [1]
    assert search.query_terms("Le Fonds de solidarité, le fonds") == ["fonds", "solidarite"]


def test_digest_tells_boxes_apart(spark, tmp_path):
    from centime.plans.queries import queries

    for name, box in (("a", [1.0, 2.0]), ("b", [1.0, 2.0]), ("c", [1.0, 3.0]), ("d", None)):
        spark.createDataFrame([(1, "x", box)], "id bigint, raw string, pdf_bbox array<double>").write.parquet(str(tmp_path / name / "pdf_facts.parquet"))
    a, b, c, d = (tuple(queries()["content_digest"](spark, str(tmp_path / name)).first()) for name in "abcd")
    assert a == b and len({a, c, d}) == 3
