"""Queries over published observations and the hierarchy of positions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from centime.functions import scalars
from centime.operators import cells, paths, rates, reconcile
from centime.session import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def cents(column: str) -> F.Column:
    return F.round(F.col(column) * 100).cast("bigint")


POSITION = ["domain", "perimeter", "metric", "exercise", "stage", "entity"]
_QUANTUM = """CASE WHEN regexp_matches(trim(translate(replace(replace(raw, ',', '.'), ' ', ''), '\u2212\u2011\u2013\u2010', '----'), '()'), '^[-+]?[0-9]+([.][0-9]+)?$')
  THEN TRY_CAST(unit_eur AS DECIMAL(20,4))::DOUBLE / pow(10::DOUBLE, length(regexp_extract(replace(raw, ',', '.'), '[.]([0-9]+)', 1))) END"""
_RANKED = f"""f AS (
  SELECT *, coalesce(TRUNC(TRY_CAST(precision_eur AS DECIMAL(18,4)) * 100), 0)::HUGEINT AS p, {_QUANTUM} AS q, CASE WHEN kind = 'LFSS' THEN 1 ELSE 0 END AS lfss
  FROM pdf_facts WHERE amount_cents IS NOT NULL),
o AS (SELECT *, CASE WHEN stage = 'PROJECTION' THEN edition WHEN stage = 'CONSTATE' THEN lfss ELSE 0 END AS k2, CASE WHEN stage = 'PROJECTION' THEN lfss ELSE 0 END AS k3,
  CASE WHEN stage = 'PROJECTION' THEN coalesce(reference_date, '') ELSE coalesce(reference_date, lpad(CAST(edition - 1 AS VARCHAR), 4, '0') || '-00') END AS k4, CASE WHEN stage = 'PROJECTION' THEN 0 ELSE edition END AS k5 FROM f),
r AS (
  SELECT *, rank() OVER (PARTITION BY domain, perimeter, metric, exercise, stage, entity
                         ORDER BY priority DESC NULLS LAST, k2 DESC NULLS LAST, k3 DESC, k4 DESC NULLS LAST, k5 DESC NULLS LAST) AS k FROM o)"""


def _ranking() -> list[F.Column]:
    """The greatest counts: projections by priority, edition and vote; the others by priority, for stated results by vote, then by date and edition."""
    voted = F.when(F.col("kind") == "LFSS", 1).otherwise(0)
    ahead, stated = F.col("stage") == "PROJECTION", F.col("stage") == "CONSTATE"
    dated = F.coalesce("reference_date", F.concat(F.lpad((F.col("edition") - 1).cast("string"), 4, "0"), F.lit("-00")))
    return [
        F.col("priority"),
        F.when(ahead, F.col("edition")).when(stated, voted).otherwise(0),
        F.when(ahead, voted).otherwise(0),
        F.when(ahead, F.coalesce("reference_date", F.lit(""))).otherwise(dated),
        F.when(ahead, 0).otherwise(F.col("edition")),
    ]


@query(
    f"""WITH {_RANKED},
g AS (
  SELECT domain, perimeter, metric, exercise, stage, entity,
         count(DISTINCT amount_cents) FILTER (k = 1) AS distinct_values,
         max(2 * amount_cents::HUGEINT - p) FILTER (k = 1) AS low, min(2 * amount_cents::HUGEINT + p) FILTER (k = 1) AS high,
         arg_min(amount_cents, (CASE WHEN q IS NULL THEN 1 ELSE 0 END, coalesce(q, 0), id)) FILTER (k = 1) AS finest,
         count(*) FILTER (k = 1) AS references_n, count(*) FILTER (k > 1) AS earlier_n
  FROM r GROUP BY ALL)
SELECT domain, perimeter, metric, exercise, stage, entity,
       CASE WHEN low <= high THEN finest END AS value,
       CASE WHEN distinct_values = 1 THEN 'published' WHEN low <= high THEN 'rounded_consistency' ELSE 'divergence' END AS status,
       references_n, earlier_n, CASE WHEN distinct_values > 1 THEN distinct_values ELSE 0 END AS alternatives
FROM g"""
)
def cell_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "pdf_facts")
    precision = F.coalesce(F.expr("try_cast(precision_eur AS decimal(18,4)) * 100").try_cast("bigint"), F.lit(0))
    found = cells.select_cells(facts, POSITION, _ranking(), "amount_cents", precision, scalars.raw_quantum("raw", "unit_eur"), [F.col("id")])
    return found.drop("distinct_values")


@query(f"WITH {_RANKED} SELECT domain, perimeter, metric, exercise, stage, entity, id, amount_cents, CASE WHEN k = 1 THEN 'reference' ELSE 'earlier' END AS role FROM r")
def cell_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.cell_references(table(spark, sf_dir, "pdf_facts"), POSITION, _ranking(), "amount_cents", "id")


YEARS = list(range(1994, 2003))


@query(
    """
WITH c AS (SELECT year(o_orderdate) AS y, o_orderpriority AS p, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS value FROM orders GROUP BY ALL),
g AS (SELECT y.range AS y, p.p FROM range(1994, 2003) y CROSS JOIN (SELECT DISTINCT o_orderpriority AS p FROM orders) p)
SELECT CAST(g.y AS INTEGER) AS y, g.p, c.value, CASE WHEN c.y IS NULL THEN 'missing' ELSE 'published' END AS status,
       CASE WHEN c.y IS NULL THEN CASE WHEN g.y >= 2002 THEN 'not_yet_published' ELSE 'not_in_sources' END END AS reason
FROM g LEFT JOIN c ON g.y = c.y AND g.p = c.p"""
)
def matrix_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    found = orders.groupBy(F.year("o_orderdate").alias("y"), F.col("o_orderpriority").alias("p")).agg(F.sum(cents("o_totalprice")).alias("value")).withColumn("status", F.lit("published"))
    years = spark.createDataFrame([(y,) for y in YEARS], "y int")
    priorities = orders.select(F.col("o_orderpriority").alias("p")).distinct()
    return cells.grid(found, [years, priorities], ["y", "p"], F.when(F.col("y") >= 2002, "not_yet_published").otherwise("not_in_sources"))


@query(
    "SELECT o_orderpriority AS priority, "
    + ", ".join(f"CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) FILTER (year(o_orderdate) = {y}) AS BIGINT) AS y{y}" for y in range(1995, 2002))
    + " FROM orders GROUP BY 1"
)
def matrix_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = [f"y{y}" for y in range(1995, 2002)]
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("priority"), F.concat(F.lit("y"), F.year("o_orderdate")).alias("y"), cents("o_totalprice").alias("c"))
    return orders.groupBy("priority").pivot("y", years).agg(F.sum("c"))


@query(
    """SELECT l_orderkey, l_linenumber, metric, value FROM (
  SELECT l_orderkey, l_linenumber, unnest(['price', 'discount', 'tax']) AS metric,
         unnest([CAST(round(l_extendedprice * 100) AS BIGINT), CASE WHEN l_discount = 0 THEN NULL ELSE CAST(round(l_discount * 100) AS BIGINT) END, CAST(round(l_tax * 100) AS BIGINT)]) AS value
  FROM lineitem)"""
)
def unpivot_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", cents("l_extendedprice").alias("price"), F.when(F.col("l_discount") != 0, cents("l_discount")).alias("discount"), cents("l_tax").alias("tax")
    )
    return cells.unpivot(wide, ["l_orderkey", "l_linenumber"], ["price", "discount", "tax"], "metric", "value")


EXCLUDED = ["1", "2/8", "2/8/BUILDING", "3/6/MACHINERY"]
_POSITIONS = """p AS (
  SELECT n_regionkey || '/' || n_nationkey || '/' || c_mktsegment AS path, n_regionkey, n_nationkey,
         CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(round(c_acctbal * 100) AS BIGINT) END AS cents
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
_GONE = "(path = '1' OR path LIKE '1/%' OR path = '2/8' OR path LIKE '2/8/%' OR path = '3/6/MACHINERY' OR path LIKE '3/6/MACHINERY/%')"


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' balances at region/nation/segment; every seventh unknown."""
    nation = F.broadcast(table(spark, sf_dir, "nation"))  # 25 rows, fixed by the schema
    met = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    value = F.when(F.col("c_custkey") % 7 != 0, cents("c_acctbal"))
    return met.select(paths.node_path("n_regionkey", "n_nationkey", "c_mktsegment").alias("path"), "n_regionkey", "n_nationkey", value.alias("cents"))


@query(
    f"""WITH {_POSITIONS} SELECT n_regionkey, CAST(sum(cents) FILTER (NOT {_GONE}) AS BIGINT) AS value, count(*) FILTER (NOT {_GONE}) AS members,
  CASE WHEN count(*) FILTER (NOT {_GONE}) = 0 THEN 'empty_selection' WHEN count(cents) FILTER (NOT {_GONE}) < count(*) FILTER (NOT {_GONE}) THEN 'partial' ELSE 'computed' END AS status
  FROM p GROUP BY 1"""
)
def selection_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.selection_sum(positions(spark, sf_dir), ["n_regionkey"], "cents", ~paths.excluded(F.col("path"), EXCLUDED))


@query(
    f"""WITH {_POSITIONS}, s AS (SELECT unnest(['', '0', '2/8', '2/88', '4/20/BUILDING']) AS scope)
SELECT scope, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM p JOIN s ON scope = '' OR path = scope OR starts_with(path, scope || '/') GROUP BY 1"""
)
def path_prefix_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    scopes = spark.createDataFrame([(s,) for s in ("", "0", "2/8", "2/88", "4/20/BUILDING")], "scope string")
    return paths.under_scopes(positions(spark, sf_dir), F.broadcast(scopes)).groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))


@query(
    f"""WITH {_POSITIONS} SELECT n_regionkey || '/' || n_nationkey AS path, count(*) AS n, count(*) FILTER (NOT {_GONE}) AS kept,
  bool_or(starts_with('3/6/MACHINERY', n_regionkey || '/' || n_nationkey || '/')) AS too_fine FROM p GROUP BY 1"""
)
def exclusions_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = positions(spark, sf_dir).withColumn("gone", paths.excluded(F.col("path"), EXCLUDED))
    grouped = rows.groupBy(paths.ancestor(F.col("path"), 2).alias("path")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~F.col("gone"), 1)).alias("kept"))
    return grouped.withColumn("too_fine", paths.finer_exclusion(F.col("path"), EXCLUDED))


@query(
    f"""WITH {_POSITIONS}, d AS (SELECT 1 AS depth UNION ALL SELECT 2 UNION ALL SELECT 3)
SELECT array_to_string(string_split(path, '/')[1:depth], '/') AS node, depth, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents, count(cents) AS known
FROM p CROSS JOIN d GROUP BY ALL"""
)
def drilldown_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = positions(spark, sf_dir).groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"), F.count("cents").alias("known"))
    nodes = leaves.select(F.explode(paths.ancestors(F.col("path"))).alias("node"), "n", "cents", "known")
    grouped = nodes.groupBy("node").agg(F.sum("n").alias("n"), F.sum("cents").alias("cents"), F.sum("known").alias("known"))
    return grouped.select("node", F.size(F.split("node", "/")).alias("depth"), "n", "cents", "known")


@query(
    """WITH c AS (SELECT p_brand AS parent, p_brand || '/' || p_type AS path, CAST(sum(CAST(round(p_retailprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM part GROUP BY ALL),
p AS (SELECT parent AS path, CAST(sum(cents) + 3 AS BIGINT) AS cents FROM c GROUP BY 1),
k AS (SELECT c.*, parent LIKE '%1' OR path LIKE '%/STANDARD%' AS gone FROM c),
t AS (SELECT parent AS path, count(*) AS n, count(*) FILTER (gone) AS g, CAST(sum(cents) FILTER (gone) AS BIGINT) AS s FROM k GROUP BY 1)
SELECT p.path, CASE WHEN g = n THEN 0 WHEN g > 0 THEN cents - s ELSE cents END AS cents, CASE WHEN g = n THEN cents WHEN g > 0 THEN s ELSE 0 END AS removed,
       CASE WHEN g = n THEN 'fully_excluded' WHEN g > 0 THEN 'computed' ELSE 'unchanged' END AS status
FROM p JOIN t USING (path)"""
)
def resolve_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from centime.operators.hierarchy import resolve

    parts = table(spark, sf_dir, "part")
    children = parts.groupBy(F.col("p_brand").alias("parent"), paths.node_path("p_brand", "p_type").alias("path")).agg(F.sum(cents("p_retailprice")).alias("cents"))
    parents = children.groupBy(F.col("parent").alias("path")).agg((F.sum("cents") + 3).alias("cents"))
    listed = children.where("parent LIKE '%1' OR path LIKE '%/STANDARD%'").select("path")
    return resolve(parents, children, listed)


@query(
    """WITH s AS (SELECT l_orderkey AS o, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS c, count(*) AS n FROM lineitem GROUP BY 1),
p AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN coalesce(c, 0) ELSE CAST(round(o_totalprice * 100) AS BIGINT) END AS cents, n, c FROM orders LEFT JOIN s ON o = o_orderkey)
SELECT o_orderkey, cents, coalesce(n, 0) AS children, CASE WHEN n IS NULL THEN 'no_children' WHEN c = cents THEN 'children' ELSE 'parent_kept' END AS source FROM p"""
)
def leaf_or_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), cents("l_extendedprice").alias("child"))
    sums = lines.groupBy("o_orderkey").agg(F.sum("child").alias("child"))
    orders = table(spark, sf_dir, "orders").join(sums, "o_orderkey", "left")
    parents = orders.select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.coalesce("child", F.lit(0))).otherwise(cents("o_totalprice")).alias("cents"))
    return reconcile.leaf_or_parent(parents, lines, "o_orderkey", "cents", "child")


_SERIES = """s AS (SELECT o_orderpriority AS p, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) - CASE WHEN year(o_orderdate) = 1996 THEN 100000000000000 ELSE 0 END AS cents
  FROM orders WHERE year(o_orderdate) <> 1998 GROUP BY ALL, year(o_orderdate))"""
_SERIES = _SERIES.replace("GROUP BY ALL, year(o_orderdate)", "GROUP BY o_orderpriority, year(o_orderdate)")


def yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly totals with 1998 left out and 1996 negative: a gap and a reference that allows no rate."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("p"), F.year("o_orderdate").alias("y"), cents("o_totalprice").alias("c")).where("y <> 1998")
    shift = F.when(F.col("y") == 1996, F.lit(100000000000000)).otherwise(F.lit(0))
    return orders.groupBy("p", "y").agg(F.sum("c").alias("c")).select("p", "y", (F.col("c") - shift).alias("cents"))


@query(
    f"""WITH {_SERIES} SELECT a.p, a.y, a.cents, CASE WHEN b.cents > 0 THEN round((CAST(a.cents AS DOUBLE) / CAST(b.cents AS DOUBLE) - 1) * 100, 4) END AS rate,
  CASE WHEN b.cents IS NULL THEN 'unavailable' WHEN b.cents <= 0 THEN 'nonpositive_reference' ELSE 'ok' END AS status
  FROM s a LEFT JOIN s b ON a.p = b.p AND b.y = a.y - 1"""
)
def yoy_gap_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = rates.with_reference(yearly(spark, sf_dir), ["p"], "y", "cents")
    return series.select("p", "y", "cents", rates.growth(F.col("cents"), F.col("prior")).alias("rate"), rates.growth_status(F.col("cents"), F.col("prior")).alias("status"))


INDICES = {1995: 100000, 1996: 102137, 1997: 103391, 1999: 104871, 2000: 106655}
_INDICES = "i AS (SELECT * FROM (VALUES " + ", ".join(f"({y}, {v})" for y, v in INDICES.items()) + ") t(y, v))"


@query(
    f"""WITH {_SERIES}, {_INDICES}, f AS (SELECT p, arg_min(cents, y) AS first, min(y) AS y0 FROM s GROUP BY p)
SELECT s.p, s.y, CAST(sign(s.cents) AS BIGINT) * CAST((2 * abs(CAST(s.cents AS HUGEINT)) * 106655 + i.v) // (2 * i.v) AS BIGINT) AS constant_cents,
  CASE WHEN f.first > 0 AND i.v IS NOT NULL AND s.cents > 0 THEN round((CAST(s.cents AS DOUBLE) / CAST(f.first AS DOUBLE) * 100000.0 / CAST(i.v AS DOUBLE) - 1) * 100, 4) END AS real_rate,
  CASE WHEN f.first <= 0 THEN 'nonpositive_reference' WHEN i.v IS NULL THEN 'inflation_missing' ELSE 'ok' END AS status
FROM s JOIN f USING (p) LEFT JOIN i ON i.y = s.y"""
)
def real_from_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    indices = spark.createDataFrame(list(INDICES.items()), "year int, index_value bigint")
    series = rates.in_constant_money(rates.with_reference(yearly(spark, sf_dir), ["p"], "y", "cents"), indices, "y", "cents", 2000)
    rate = F.when(F.col("index_value").isNotNull() & (F.col("cents") > 0), rates.growth(F.col("cents"), F.col("first"), F.col("index_value"), F.lit(100000)))
    return series.select("p", "y", "constant_cents", rate.alias("real_rate"), rates.growth_status(F.col("cents"), F.col("first"), F.col("index_value")).alias("status"))


@query(
    """WITH s AS (SELECT o_orderpriority AS p, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) FILTER (o_orderstatus = 'F') AS BIGINT) AS a,
  CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) FILTER (o_orderstatus = 'O') AS BIGINT) AS b FROM orders GROUP BY ALL)
SELECT p, y, b - a AS difference, CASE WHEN a <> 0 THEN round(CAST(b AS DOUBLE) / CAST(a AS DOUBLE) * 100, 4) END AS rate,
  CASE WHEN a IS NULL OR b IS NULL THEN 'unavailable' WHEN a = 0 THEN 'zero_denominator' ELSE 'ok' END AS status FROM s"""
)
def comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("p"), F.year("o_orderdate").alias("y"), "o_orderstatus", cents("o_totalprice").alias("c"))
    return rates.compare_stages(series, ["p", "y"], "o_orderstatus", "c", "F", "O")


@query(
    """WITH s AS (SELECT l_orderkey AS k, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS published, count(*) AS n FROM lineitem GROUP BY 1),
d AS (SELECT k, published, n, published - CASE k % 5 WHEN 0 THEN 0 WHEN 1 THEN 90 WHEN 2 THEN 700 WHEN 3 THEN -950 ELSE 5000 END AS reference FROM s),
e AS (SELECT *, abs(published - reference) AS gap, least(1000, greatest(100, (n + 1) * 50)) AS rounding, least(1000, CAST(floor(abs(reference) / 1000.0) AS BIGINT)) AS material FROM d)
SELECT k, CASE WHEN gap = 0 THEN 'exact' WHEN gap <= rounding THEN 'published_rounding_difference' WHEN gap <= material THEN 'source_difference' ELSE 'material_difference' END AS class FROM e"""
)
def tolerance_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum(cents("l_extendedprice")).alias("published"), F.count(F.lit(1)).alias("n"))
    step = F.pmod("k", F.lit(5))
    shift = F.when(step == 0, 0).when(step == 1, 90).when(step == 2, 700).when(step == 3, -950).otherwise(5000)
    return sums.select("k", reconcile.tolerance_class(F.col("published"), F.col("published") - shift, F.col("n")).alias("class"))


@query(
    """WITH t AS (SELECT l_suppkey AS k, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS r, CAST(sum(CAST(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT)) AS BIGINT) AS d FROM lineitem GROUP BY 1),
u AS (SELECT k, r AS RECETTES, d AS DEPENSES, r - d + (k % 40) AS SOLDE FROM t WHERE k % 11 <> 0)
SELECT k, RECETTES, DEPENSES, SOLDE, RECETTES - DEPENSES - SOLDE AS gap, abs(RECETTES - DEPENSES - SOLDE) <= 15 AS balanced FROM u"""
)
def balance_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(
        F.sum(cents("l_extendedprice")).alias("r"), F.sum(F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100).cast("bigint")).alias("d")
    )
    balance = F.when(F.col("k") % 11 != 0, F.col("r") - F.col("d") + F.col("k") % 40)
    long = sums.select("k", F.col("r").alias("RECETTES"), F.col("d").alias("DEPENSES"), balance.alias("SOLDE")).unpivot("k", ["RECETTES", "DEPENSES", "SOLDE"], "metric", "value")
    return reconcile.balance(long, ["k"], "metric", "value", F.lit(15))


@query(
    """SELECT a.id AS id, b.source_id AS other_source, count(*) AS n, CAST(sum(CASE WHEN a.amount_cents = b.amount_cents THEN 1 ELSE 0 END) AS BIGINT) AS equal
FROM pdf_facts a JOIN (SELECT DISTINCT exercise, perimeter, entity, metric, stage, row_index, column_index, source_id, edition, amount_cents FROM pdf_facts) b
  ON a.exercise = b.exercise AND a.perimeter = b.perimeter AND a.entity = b.entity AND a.metric = b.metric AND a.row_index = b.row_index AND a.column_index = b.column_index
 AND a.source_id <> b.source_id AND a.edition < b.edition AND a.stage <> b.stage GROUP BY ALL"""
)
def theta_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same position in later publications of another source: equal keys first, inequalities as residual."""
    key = ["exercise", "perimeter", "entity", "metric", "row_index", "column_index"]
    facts = table(spark, sf_dir, "pdf_facts").select("id", *key, "stage", "source_id", "edition", "amount_cents")
    other = facts.drop("id").distinct().withColumnsRenamed({"stage": "other_stage", "source_id": "other_source", "edition": "other_edition", "amount_cents": "other_cents"})
    met = facts.join(other, key).where("source_id <> other_source AND edition < other_edition AND stage <> other_stage")
    equal = F.when(F.col("amount_cents") == F.col("other_cents"), 1).otherwise(0)
    return met.groupBy("id", "other_source").agg(F.count(F.lit(1)).alias("n"), F.sum(equal).alias("equal"))


@query(
    """SELECT l_suppkey, count(*) AS n, count(DISTINCT l_partkey) AS parts, CAST(min(CASE WHEN l_returnflag = 'R' THEN l_linenumber END) AS INTEGER) AS first_returned FROM lineitem GROUP BY 1"""
)
def coverage_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.min(F.when(F.col("l_returnflag") == "R", F.col("l_linenumber"))).alias("first_returned")
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_partkey").alias("parts"), first)


@query("SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicates_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query(
    """WITH a AS (SELECT o_orderkey AS k, CAST(round(o_totalprice * 100) AS BIGINT) AS actual FROM orders WHERE o_orderkey % 13 <> 0),
b AS (SELECT l_orderkey AS k, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS planned FROM lineitem GROUP BY 1)
SELECT k, actual, planned, CASE WHEN actual IS NULL THEN 'to_insert' WHEN planned IS NULL THEN 'unplanned' WHEN actual = planned THEN 'present' ELSE 'conflict' END AS kind FROM a FULL JOIN b USING (k)"""
)
def mission_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    actual = table(spark, sf_dir, "orders").where("o_orderkey % 13 <> 0").select(F.col("o_orderkey").alias("k"), cents("o_totalprice").alias("v"))
    plan = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum(cents("l_extendedprice")).alias("v"))
    return reconcile.plan_against(actual, plan, ["k"], "v")


@query(
    """WITH u AS (SELECT c_custkey AS k, c_nationkey AS n, 0 AS r FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT s_suppkey, s_nationkey, 1 FROM supplier)
SELECT k, CAST(min(r) AS INTEGER) AS source_rank, arg_min(n, (r, n)) AS n FROM u GROUP BY 1"""
)
def precedence_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"))
    second = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n"))
    return reconcile.precedence_merge([first, second], ["k"], ["n"])


@query(
    """WITH a AS (SELECT l_partkey, l_quantity, count(*) AS n FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL), b AS (SELECT l_partkey, l_quantity, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL)
SELECT coalesce(a.l_partkey, b.l_partkey) AS l_partkey, coalesce(a.l_quantity, b.l_quantity) AS l_quantity, abs(coalesce(a.n, 0) - coalesce(b.n, 0)) AS surplus,
  CASE WHEN coalesce(a.n, 0) > coalesce(b.n, 0) THEN 'only_first' ELSE 'only_second' END AS side
FROM a FULL JOIN b ON a.l_partkey = b.l_partkey AND a.l_quantity = b.l_quantity WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)"""
)
def multiset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return reconcile.difference(lines.where("l_returnflag <> 'N'").select("l_partkey", "l_quantity"), lines.where("l_linestatus = 'F'").select("l_partkey", "l_quantity"))


@query(
    """WITH c AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 5000 AND c_nationkey < 20), s AS (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_nationkey > 4)
SELECT 'union' AS op, k FROM (SELECT * FROM c UNION SELECT * FROM s) UNION ALL SELECT 'intersect', k FROM (SELECT * FROM c INTERSECT SELECT * FROM s)
UNION ALL SELECT 'except', k FROM (SELECT * FROM c EXCEPT SELECT * FROM s) UNION ALL SELECT 'union_all', k FROM (SELECT * FROM c UNION ALL SELECT * FROM s)"""
)
def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where("c_acctbal > 5000 AND c_nationkey < 20").select(F.col("c_nationkey").alias("k")).distinct()
    s = table(spark, sf_dir, "supplier").where("s_nationkey > 4").select(F.col("s_nationkey").alias("k")).distinct()
    parts = {"union": c.union(s).distinct(), "intersect": c.intersect(s), "except": c.exceptAll(s), "union_all": c.union(s)}
    whole = None
    for op, part in parts.items():
        part = part.select(F.lit(op).alias("op"), "k")
        whole = part if whole is None else whole.union(part)
    return whole


@query(
    "SELECT event_id, user_id, event_type, CAST(n AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS n FROM events) WHERE n <= 8"
)
def limit_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    from centime.operators.search import limit_per_group as first_n

    return first_n(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts"), ["user_id"], [F.desc("ts"), F.asc("event_id")], 8).drop("ts")


@query("SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 25")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderkey > 1000").orderBy("o_orderkey").limit(25).select("o_orderkey", cents("o_totalprice").alias("cents"))


@query(
    """WITH p AS (SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS n FROM orders)
SELECT o_orderkey, CAST(n - 201 AS INTEGER) AS place, (SELECT count(*) FROM orders) > 300 AS has_more FROM p WHERE n > 200 AND n <= 300"""
)
def offset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = table(spark, sf_dir, "orders").orderBy("o_orderdate", "o_orderkey").offset(200).limit(101).select("o_orderkey", "o_orderdate")
    whole = Window.orderBy("o_orderdate", "o_orderkey")  # 101 rows
    numbered = page.withColumn("place", F.row_number().over(whole) - 1).withColumn("has_more", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))) > 100)
    return numbered.where("place < 100").drop("o_orderdate")


@query(
    f"""WITH {_POSITIONS}, m AS (SELECT n_nationkey AS k, path, cents, split_part(path, '/', 3) AS program, {_GONE} AS gone, starts_with(path, '2/') AS inside FROM p),
w AS (SELECT * FROM m WHERE inside), x AS (SELECT count(DISTINCT program) AS expected_programs FROM w WHERE NOT gone),
g AS (SELECT k, count(*) FILTER (gone) AS g, count(*) FILTER (NOT gone) AS members, CAST(sum(cents) FILTER (NOT gone) AS BIGINT) AS s, count(DISTINCT program) FILTER (NOT gone) AS programs FROM w GROUP BY 1)
SELECT k, CASE WHEN members = 0 THEN 0 ELSE s END AS value, CASE WHEN members = 0 THEN 'excluded' WHEN s IS NULL THEN 'missing' WHEN programs < expected_programs THEN 'partial' ELSE 'ok' END AS status, members, programs, expected_programs FROM g, x"""
)
def position_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    from centime.operators.explorer import position_cells as build

    rows = positions(spark, sf_dir).withColumn("program", F.element_at(F.split("path", "/"), 3)).withColumnRenamed("n_nationkey", "k")
    return build(rows, "2", EXCLUDED, ["k"])


@query(
    """WITH s AS (SELECT DISTINCT source_id, exercise FROM pdf_facts WHERE exercise IS NOT NULL), r AS (SELECT source_id, unnest(range(min(exercise), max(exercise) + 1)) AS y FROM s GROUP BY 1)
SELECT r.source_id, CAST(y AS INTEGER) AS exercise FROM r WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.source_id IS NOT DISTINCT FROM r.source_id AND s.exercise = y)"""
)
def missing_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    from centime.operators.lookup import missing_years as gaps

    return gaps(table(spark, sf_dir, "pdf_facts").where("source_id IS NOT NULL"), ["source_id"], "exercise")


@query("SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) + CASE WHEN l_discount <> 0 THEN CAST(round(l_discount * 100) AS BIGINT) END + CAST(round(l_tax * 100) AS BIGINT) AS total FROM lineitem")
def strict_null_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    from centime.operators.lookup import strict_sum

    wide = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", cents("l_extendedprice").alias("a"), F.when(F.col("l_discount") != 0, cents("l_discount")).alias("b"), cents("l_tax").alias("c"))
    return wide.select("l_orderkey", "l_linenumber", strict_sum("a", "b", "c").alias("total"))


@query(
    """WITH f AS (SELECT p_type AS label FROM part WHERE p_type IS NOT NULL GROUP BY 1), c AS (SELECT DISTINCT substr(p_type, 1, 4 + CAST(p_partkey % 9 AS INTEGER)) AS label FROM part)
SELECT c.label, min(f.label) AS rescued FROM c JOIN f ON starts_with(f.label, c.label) WHERE length(c.label) >= 5 GROUP BY 1 HAVING count(*) = 1"""
)
def rescued_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from centime.operators.lookup import rescue_labels

    parts = table(spark, sf_dir, "part")
    cut = parts.select(F.expr("substring(p_type, 1, CAST(4 + p_partkey % 9 AS INT))").alias("label"))
    return rescue_labels(cut, parts.select(F.col("p_type").alias("label")), "label", least=5)


@query(
    """WITH u AS (SELECT c_nationkey AS k, c_mktsegment AS label, 0 AS r FROM customer UNION ALL SELECT s_nationkey, s_name, 1 FROM supplier WHERE s_nationkey % 2 = 0) SELECT k, arg_max(label, (r, label)) AS label FROM u GROUP BY 1"""
)
def nomenclature(spark: SparkSession, sf_dir: str) -> DataFrame:
    from centime.operators.lookup import nomenclature as labels

    first = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("label"))
    second = table(spark, sf_dir, "supplier").where("s_nationkey % 2 = 0").select(F.col("s_nationkey").alias("k"), F.col("s_name").alias("label"))
    return labels([first, second], ["k"], "label")
