"""Queries over published tables: labels, cells, checks and assembling, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from centime.functions import scalars
from centime.operators import labels, lookup, paths, reconcile, status
from centime.session import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


MARKED, PLAIN = scalars.MARKED, scalars.PLAIN


def _norm(text: str) -> str:
    return f"regexp_replace(translate(lower({text}), '{MARKED}', '{PLAIN}'), '[^a-z0-9]', '', 'g')"


@query(
    f"""WITH h AS (SELECT column_label, row_label, CASE WHEN {_norm("metric")} IN ('recettes') THEN 'RECETTES' WHEN {_norm("metric")} IN ('depenses') THEN 'DEPENSES' WHEN {_norm("metric")} = 'solde' THEN 'SOLDE' END AS metric,
  TRY_CAST(nullif(regexp_extract(trim(column_label), '^(20[0-9]{{2}})(?:\\s*\\([pP]\\))?$', 1), '') AS INTEGER) AS exact_year, TRY_CAST(list_last(regexp_extract_all(column_label, '20[0-9]{{2}}')) AS INTEGER) AS last_year,
  coalesce(regexp_matches({_norm("column_label")}, 'constat|realis|execut') AND NOT regexp_matches({_norm("column_label")}, 'ecart|revision|previs|evolution'), false) AS result FROM pdf_facts)
SELECT metric, exact_year, last_year, result, count(*) AS n FROM h GROUP BY ALL"""
)
def header_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the headings of columns stand for: metric, exact year, last year named, results."""
    held = table(spark, sf_dir, "pdf_facts").select(
        labels.header_metric(F.col("metric")).alias("metric"), scalars.year_header("column_label").alias("exact_year"), scalars.last_year("column_label").alias("last_year"),
        F.coalesce(labels.result_column(F.col("column_label")), F.lit(False)).alias("result"),
    )
    return held.groupBy("metric", "exact_year", "last_year", "result").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH p AS (SELECT source_id, table_index, regexp_replace(translate(raw, '−–', '--'), '[\\s\\p{Z}''’]', '', 'g') AS t FROM pdf_facts),
k AS (SELECT source_id, table_index, CASE WHEN coalesce(t, '') = '' THEN 'empty' WHEN suffix(t, '%') THEN 'percent' WHEN regexp_matches(t, '^[-+]?\\(?[0-9][0-9.,]*\\)?$') AND NOT regexp_matches(t, '[1-9]') THEN 'zero' WHEN regexp_matches(t, '^[-+]?\\(?[0-9][0-9.,]*\\)?$') THEN 'number' ELSE 'text' END AS kind FROM p)
SELECT source_id, table_index, count(*) AS cells, count(*) FILTER (kind = 'empty') AS empty, count(*) FILTER (kind = 'percent') AS percent, count(*) FILTER (kind = 'zero') AS zero, count(*) FILTER (kind = 'number') AS number FROM k GROUP BY ALL"""
)
def cell_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inventory of a table's cells by kind."""
    held = table(spark, sf_dir, "pdf_facts").select("source_id", "table_index", labels.cell_kind(F.col("raw")).alias("kind"))
    counts = [F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in ("empty", "percent", "zero", "number")]
    return held.groupBy("source_id", "table_index").agg(F.count(F.lit(1)).alias("cells"), *counts)


ROUTES = {"accounts": "^comptes", "bill": "^plf", "law": "^lf", "report": "^(rap|pap)", "note": "note"}


@query(
    """SELECT source_id, CASE WHEN regexp_matches(lower(title), '^comptes') THEN 'accounts' WHEN regexp_matches(lower(title), '^plf') THEN 'bill' WHEN regexp_matches(lower(title), '^lf') THEN 'law' WHEN regexp_matches(lower(title), '^(rap|pap)') THEN 'report'
  WHEN regexp_matches(lower(title), 'note') THEN 'note' ELSE 'other' END AS route, regexp_extract(url, '[.]([a-z0-9]+)$', 1) AS extension, CASE WHEN status <> 'downloaded' OR status IS NULL THEN 'absent' WHEN bytes IS NULL THEN 'unsized' WHEN path IS NULL THEN 'unplaced' ELSE 'ready' END AS state FROM sources"""
)
def source_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by rules over their titles and addresses, and whether they can be read."""
    state = status.first_reason((F.coalesce("status", F.lit("")) != "downloaded", "absent"), (F.col("bytes").isNull(), "unsized"), (F.col("path").isNull(), "unplaced"), otherwise="ready")
    kind = F.coalesce(labels.route(F.lower("title"), ROUTES, "other"), F.lit("other"))
    return table(spark, sf_dir, "sources").select("source_id", kind.alias("route"), F.regexp_extract("url", r"[.]([a-z0-9]+)$", 1).alias("extension"), state.alias("state"))


@query(
    """SELECT record_id, x.code AS code, CASE WHEN length(string_split(x.code, '.')[-1]) >= 2 THEN string_split(x.code, '.')[-1] ELSE lpad(string_split(x.code, '.')[-1], 2, '0') END AS part
FROM (SELECT record_id, unnest(s) AS x FROM (SELECT record_id, unnest(actions).subactions AS s FROM action_groups)) WHERE x IS NOT NULL"""
)
def code_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last part of each subaction's code."""
    held = table(spark, sf_dir, "action_groups").select("record_id", F.explode("actions").alias("a")).select("record_id", F.explode("a.subactions").alias("x")).where("x IS NOT NULL")
    return held.select("record_id", "x.code", labels.last_part(F.col("x.code")).alias("part"))


@query(
    """SELECT record_id, CASE WHEN gap_cents < 0 THEN '-' ELSE '' END || replace(format('{:,}', abs(gap_cents) // 100), ',', ' ') || ',' || lpad(CAST(abs(gap_cents) % 100 AS VARCHAR), 2, '0') AS printed FROM delivery_check WHERE gap_cents IS NOT NULL"""
)
def printed_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "delivery_check").where("gap_cents IS NOT NULL").select("record_id", labels.money_text(F.col("gap_cents")).alias("printed"))


@query(
    """WITH v AS (SELECT record_id, values_cents['RECETTES'] AS r, values_cents['DEPENSES'] AS d, values_cents['SOLDE'] AS s, TRY_CAST(published_rounding_cents AS BIGINT) AS q FROM delivery_check)
SELECT record_id, r - d - s AS gap, CASE WHEN r IS NULL OR d IS NULL OR s IS NULL THEN 'no_check' WHEN abs(r - d - s) = 0 THEN 'exact' WHEN abs(r - d - s) * 2 <= 3 * coalesce(q, 0) THEN 'rounding' ELSE 'differs' END AS result FROM v"""
)
def map_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts less expenditure against the balance of each notice, within half the rounding of three figures; a blank figure allows no check."""
    held = table(spark, sf_dir, "delivery_check").select("record_id", *(F.try_element_at("values_cents", F.lit(k)).alias(n) for k, n in (("RECETTES", "r"), ("DEPENSES", "d"), ("SOLDE", "s"))), F.col("published_rounding_cents").try_cast("bigint").alias("q"))
    gap = F.col("r") - F.col("d") - F.col("s")
    result = F.when(gap.isNull(), "no_check").when(gap == 0, "exact").when(F.abs(gap) * 2 <= 3 * F.coalesce("q", F.lit(0)), "rounding").otherwise("differs")
    return held.select("record_id", gap.alias("gap"), result.alias("result"))


@query(
    """WITH k AS (SELECT source_id, table_index, exercise, perimeter, entity, coalesce(balance_row_index, row_index) AS r, source_sha, metric, arg_min(amount_cents, id) AS told, min(id) AS record_id FROM pdf_facts WHERE amount_cents IS NOT NULL
  AND source_id IS NOT NULL AND table_index IS NOT NULL AND exercise IS NOT NULL AND perimeter IS NOT NULL AND entity IS NOT NULL AND coalesce(balance_row_index, row_index) IS NOT NULL AND source_sha IS NOT NULL AND metric IS NOT NULL GROUP BY ALL)
SELECT f.id, k.record_id FROM pdf_facts f JOIN k ON f.source_id = k.source_id AND f.table_index = k.table_index AND f.exercise = k.exercise AND f.perimeter = k.perimeter AND f.entity = k.entity AND coalesce(f.balance_row_index, f.row_index) = k.r
  AND f.source_sha = k.source_sha AND f.metric = k.metric AND f.amount_cents = k.told"""
)
def notice_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices on the first delivery of each figure: later deliveries keep theirs only while the amount is the same."""
    key = {"source_id": "string", "table_index": "int", "exercise": "int", "perimeter": "string", "entity": "string", "row": "int"}
    facts = table(spark, sf_dir, "pdf_facts").withColumn("row", F.coalesce("balance_row_index", "row_index")).select("id", *key, "source_sha", "metric", "amount_cents")
    first = facts.where("amount_cents IS NOT NULL").dropna(subset=[*key, "source_sha", "metric"]).groupBy(*key, "source_sha", "metric").agg(F.min(F.struct("id", "amount_cents")).alias("first"))
    notices = first.select(F.col("first.id").alias("record_id"), F.array(*(F.col(c).cast("string") for c in key)).alias("notice_key"), "source_sha", F.create_map("metric", "first.amount_cents").alias("values_cents"))
    return reconcile.notices_of(facts, notices, key, "metric", "amount_cents").select("id", "record_id")


@query("SELECT id, stage = CASE WHEN edition - exercise < 0 THEN 'PROJECTION' WHEN edition = exercise THEN kind WHEN edition - exercise = 1 THEN kind || '_RECTIF' ELSE 'CONSTATE' END AS stage_holds FROM pdf_facts WHERE edition IS NOT NULL AND exercise IS NOT NULL AND kind IS NOT NULL")
def stage_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a fact's stage is the one that its kind, edition and year give."""
    facts = table(spark, sf_dir, "pdf_facts").where("edition IS NOT NULL AND exercise IS NOT NULL AND kind IS NOT NULL")
    return facts.select("id", (F.col("stage") == scalars.stage_for("kind", "edition", "exercise")).alias("stage_holds"))


@query(
    """WITH t AS (SELECT id, regexp_replace(translate(replace(lower(raw), ',', '.'), '−', '-'), '[\\s\\p{Z}''’]', '', 'g') AS t FROM pdf_facts WHERE raw IS NOT NULL),
u AS (SELECT id, CASE WHEN regexp_matches(t, '^[–—][0-9]') THEN '-' || substr(t, 2) ELSE t END AS t FROM t)
SELECT id, CASE WHEN regexp_matches(t, '^[-+]?[0-9]+([.][0-9]+)?(e[-+]?[0-9]+)?$') THEN CAST(round(CAST(t AS DECIMAL(28,8)) * 100) AS BIGINT) END AS cents, coalesce(regexp_matches(t, '^[-+]?[0-9]+([.][0-9]+)?(e[-+]?[0-9]+)?$'), false) AS amount_like FROM u WHERE length(t) < 14"""
)
def plain_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that are a plain number as cents of euros, whatever marks the minus and parts the thousands."""
    facts = table(spark, sf_dir, "pdf_facts").where("raw IS NOT NULL")
    bare = F.length(F.regexp_replace("raw", r"(?U)[\s\p{Z}'’]", "")) < 14
    cents = scalars.amount_cents(F.col("raw"))
    return facts.where(bare).select("id", cents.alias("cents"), cents.isNotNull().alias("amount_like"))


@query(
    """SELECT source_id, trim(regexp_replace(title, '[\\s\\p{Z}]+', ' ', 'g')) AS clean, CASE WHEN regexp_matches(ltrim(title), '^[=+@-]') THEN '''' || title ELSE title END AS safe, strftime(make_timestamp(bytes * 1000), '%Y-%m-%d') AS day,
  CASE WHEN trim(title) <> '' THEN title WHEN trim(path) <> '' THEN path ELSE CASE WHEN trim(url) <> '' THEN url END END AS shown FROM sources"""
)
def source_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as shown: blanks collapsed, formulas defused, milliseconds as a date, the first name that is not blank."""
    held = table(spark, sf_dir, "sources")
    return held.select("source_id", scalars.clean("title").alias("clean"), scalars.safe_csv("title").alias("safe"), scalars.iso_date("bytes").alias("day"), lookup.first_filled(held, "title", "path", "absent", "url").alias("shown"))


@query(
    """WITH s AS (SELECT unnest(['M1/802', 'M2', '']) AS scope), n AS (SELECT DISTINCT mission || '/' || program AS path FROM action_groups WHERE mission IS NOT NULL AND program IS NOT NULL)
SELECT scope, path, scope = '' OR path = scope OR starts_with(path, scope || '/') AS inside, scope = '' OR path = scope OR starts_with(path, scope || '/') OR starts_with(scope, path || '/') AS overlaps FROM s CROSS JOIN n"""
)
def scope_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programmes against three scopes: whether they lie inside, and whether either holds the other."""
    found = table(spark, sf_dir, "action_groups").where("mission IS NOT NULL AND program IS NOT NULL").select(paths.node_path("mission", "program").alias("path")).distinct()
    rows = found.withColumn("scope", F.explode(F.array(*(F.lit(s) for s in ("M1/802", "M2", "")))))
    return rows.select("scope", "path", paths.within(F.col("path"), F.col("scope")).alias("inside"), paths.overlaps(F.col("path"), F.col("scope")).alias("overlaps"))


@query(
    """WITH w AS (SELECT DISTINCT id FROM passages), p AS (SELECT DISTINCT id, 1 AS part FROM passages WHERE tokens IS NULL UNION ALL SELECT DISTINCT id, 2 FROM passages WHERE tokens > 150 UNION ALL SELECT DISTINCT id, 3 FROM passages WHERE tokens < 160)
SELECT w.id AS id, true AS in_whole, CAST(count(p.id) AS BIGINT) AS parts FROM w LEFT JOIN p USING (id) GROUP BY 1 HAVING count(p.id) <> 1"""
)
def partition_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that three parts, which should be a partition, hold more than once or not at all."""
    whole = table(spark, sf_dir, "passages").select("id", "tokens").dropDuplicates(["id"])
    return lookup.partition_faults(whole.select("id"), [whole.where(c).select("id") for c in ("tokens IS NULL", "tokens > 150", "tokens < 160")], "id")


@query(
    """WITH r AS (SELECT source_id, table_index, row_index, min(id) AS a, max(id) AS b FROM pdf_facts WHERE source_id IS NOT NULL AND table_index IS NOT NULL GROUP BY ALL), l AS (SELECT *, lag(b) OVER (PARTITION BY source_id, table_index ORDER BY a, b) AS before FROM r)
SELECT source_id, table_index, CAST(sum(CASE WHEN before IS NOT NULL AND before <> a THEN 1 ELSE 0 END) AS BIGINT) AS breaks FROM l GROUP BY ALL HAVING sum(CASE WHEN before IS NOT NULL AND before <> a THEN 1 ELSE 0 END) > 0"""
)
def range_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables whose rows' ranges of ids do not follow on each other."""
    facts = table(spark, sf_dir, "pdf_facts").where("source_id IS NOT NULL AND table_index IS NOT NULL")
    ranges = facts.groupBy("source_id", "table_index", "row_index").agg(F.min("id").alias("a"), F.max("id").alias("b"))
    return lookup.contiguous(ranges, ["source_id", "table_index"], "a", "b")


@query("SELECT exercise, stage, CASE WHEN amount_cents IS NULL THEN 'missing' WHEN raw IS NULL THEN 'unprinted' ELSE 'published' END AS status, count(*) AS n FROM pdf_facts GROUP BY ALL")
def coverage_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of each year and stage by status."""
    told = status.first_reason((F.col("amount_cents").isNull(), "missing"), (F.col("raw").isNull(), "unprinted"))
    return status.coverage(table(spark, sf_dir, "pdf_facts").select("exercise", "stage", told.alias("status")), ["exercise", "stage"])


@query(
    """WITH d AS (SELECT exercise, arg_min(source_id, (loaded_at, source_id)) AS source_id FROM pdf_facts WHERE exercise IS NOT NULL AND loaded_at IS NOT NULL AND source_id IS NOT NULL GROUP BY 1) SELECT f.exercise, d.source_id, count(*) AS facts FROM pdf_facts f JOIN d ON f.exercise = d.exercise AND f.source_id = d.source_id GROUP BY ALL"""
)
def first_deposits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of each year's earliest source only."""
    facts = table(spark, sf_dir, "pdf_facts").select("exercise", "source_id", "loaded_at")
    first = facts.dropna().groupBy("exercise").agg(F.min(F.struct("loaded_at", "source_id"))["source_id"].alias("source_id"))
    return facts.join(first, ["exercise", "source_id"], "left_semi").groupBy("exercise", "source_id").agg(F.count(F.lit(1)).alias("facts"))


@query(
    """SELECT ps_suppkey, place, value FROM (SELECT s_suppkey AS ps_suppkey, unnest([0, 1]) AS place, unnest([CAST(round(s_acctbal * 100) AS BIGINT), CAST(s_nationkey AS BIGINT)]) AS value FROM supplier)"""
)
def positional_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns by their position as rows."""
    held = table(spark, sf_dir, "supplier")
    return held.select(F.col("s_suppkey").alias("ps_suppkey"), F.posexplode(F.array(F.round(F.col("s_acctbal") * 100).cast("bigint"), F.col("s_nationkey").cast("bigint"))).alias("place", "value"))


@query("SELECT doc_id, CASE WHEN years IS NULL THEN NULL ELSE array_to_string(list_transform(list_filter(list_zip(years, range(1, len(years) + 1)), lambda x: list_position(years, x[1]) = x[2]), lambda x: CAST(x[1] AS VARCHAR)), ',') END AS years FROM documents")
def ordered_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's years, each once, in the order they were given."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.filter(F.array_distinct("years"), lambda y: y.isNotNull()).cast("array<string>"), ",").alias("years"))


@query(
    """WITH p AS (SELECT program, fiscal_year AS year, stage, CAST(sum(published_total_euros * 100) AS BIGINT) AS part FROM action_groups WHERE measure = 'CP' AND published_total_euros IS NOT NULL GROUP BY ALL),
f AS (SELECT program, fiscal_year AS year, stage, CAST(sum(parent.cents) AS BIGINT) AS backing FROM action_groups WHERE measure = 'CP' AND parent.cents IS NOT NULL GROUP BY ALL)
SELECT program, year, stage, part, backing, CASE WHEN backing IS NULL THEN 'unbacked' WHEN part > backing THEN 'exceeds' ELSE 'backed' END AS status FROM p LEFT JOIN f USING (program, year, stage)"""
)
def backed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewed parts against the facts that back them."""
    groups = table(spark, sf_dir, "action_groups").where("measure = 'CP'").withColumnRenamed("fiscal_year", "year")
    key = ["program", "year", "stage"]
    part = groups.where("published_total_euros IS NOT NULL").groupBy(*key).agg(F.sum(F.col("published_total_euros") * 100).alias("part"))
    backing = groups.where("parent.cents IS NOT NULL").groupBy(*key).agg(F.sum("parent.cents").alias("backing"))
    told = F.when(F.col("backing").isNull(), "unbacked").when(F.col("part") > F.col("backing"), "exceeds").otherwise("backed")
    return part.join(backing, key, "left").withColumn("status", told)


@query(
    """WITH e AS (SELECT record_id, unnest(evidence) AS e FROM source_reconciliation), v AS (SELECT e.record_id, count(*) AS every, count(s.sha256) AS known FROM e LEFT JOIN (SELECT DISTINCT sha256 FROM sources) s ON s.sha256 = e.e.sha256 WHERE e.e IS NOT NULL GROUP BY 1),
r AS (SELECT n.record_id, n.category, coalesce(every, 0) AS every, coalesce(known, 0) AS known FROM source_reconciliation n LEFT JOIN v USING (record_id))
SELECT record_id, CASE WHEN every = 0 THEN 'no_evidence' WHEN known < every THEN 'unknown_evidence' ELSE 'valid' END AS evidence FROM r"""
)
def evidence_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all evidence of a reconciliation is there under its hash."""
    known = table(spark, sf_dir, "sources").select("sha256", F.lit(1).alias("known")).distinct()
    held = table(spark, sf_dir, "source_reconciliation").select("record_id", F.explode_outer("evidence").alias("e"))
    met = held.select("record_id", "e.sha256", F.col("e").isNotNull().cast("int").alias("there")).join(known, "sha256", "left")
    counted = met.groupBy("record_id").agg(F.sum("there").alias("every"), F.sum(F.col("known") * F.col("there")).alias("known"))
    told = F.when(F.col("every") == 0, "no_evidence").when(F.coalesce("known", F.lit(0)) < F.col("every"), "unknown_evidence").otherwise("valid")
    return counted.select("record_id", told.alias("evidence"))


@query(
    """WITH a AS (SELECT program, fiscal_year AS year, CAST(sum(published_total_euros) AS BIGINT) AS forecast FROM action_groups WHERE stage = 'PLF' GROUP BY ALL), b AS (SELECT program, fiscal_year AS year, CAST(sum(published_total_euros) AS BIGINT) AS baseline FROM action_groups WHERE stage = 'LFI' GROUP BY ALL)
SELECT program, year, forecast, baseline, CASE WHEN forecast IS NULL THEN 'to_insert' WHEN baseline IS NULL THEN 'unplanned' WHEN forecast = baseline THEN 'present' ELSE 'conflict' END AS kind FROM a FULL JOIN b USING (program, year)"""
)
def forecast_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts against their baseline: both sides kept, conflicts shown."""
    groups = table(spark, sf_dir, "action_groups").withColumnRenamed("fiscal_year", "year")
    sums = [groups.where(F.col("stage") == s).groupBy("program", "year").agg(F.sum("published_total_euros").alias("euros")) for s in ("PLF", "LFI")]
    return reconcile.plan_against(*sums, ["program", "year"], "euros").select("program", "year", F.col("actual").alias("forecast"), F.col("planned").alias("baseline"), "kind")


@query(
    """SELECT f.id, CASE WHEN s.source_id IS NULL THEN 'unknown_source' WHEN f.source_sha IS DISTINCT FROM s.sha256 THEN 'hash' WHEN f.unit_eur IS NULL THEN 'unit' WHEN f.raw IS NULL OR trim(f.raw) = '' THEN 'cell' WHEN TRY_CAST(list_last(regexp_extract_all(f.column_label, '20[0-9]{2}')) AS INTEGER) IS DISTINCT FROM f.exercise THEN 'year'
  WHEN f.row_label IS NULL THEN 'entity' ELSE 'confirmed' END AS reason FROM pdf_facts f LEFT JOIN (SELECT source_id, any_value(sha256) AS sha256 FROM sources GROUP BY 1) s ON s.source_id = f.source_id"""
)
def reread_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first reason why a fact cannot be confirmed from its source: hash, unit, cell, year or entity."""
    known = table(spark, sf_dir, "sources").groupBy("source_id").agg(F.first("sha256").alias("sha256"), F.lit(True).alias("there"))
    met = table(spark, sf_dir, "pdf_facts").join(known, "source_id", "left")
    reason = status.first_reason(
        (F.col("there").isNull(), "unknown_source"), (~F.col("source_sha").eqNullSafe(F.col("sha256")), "hash"), (F.col("unit_eur").isNull(), "unit"), (F.trim(F.coalesce("raw", F.lit(""))) == "", "cell"),
        (~scalars.last_year("column_label").eqNullSafe(F.col("exercise")), "year"), (F.col("row_label").isNull(), "entity"), otherwise="confirmed",
    )
    return met.select("id", reason.alias("reason"))


@query(
    """SELECT sha256(string_agg(t, chr(10) ORDER BY t)) AS fingerprint, count(*) AS n FROM (SELECT DISTINCT mission || '/' || program || '=' || stage AS t FROM action_groups WHERE mission IS NOT NULL AND program IS NOT NULL AND stage IS NOT NULL)"""
)
def selection_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One digest of a selection, whatever the order of its parts: positions and stages, a small set."""
    line = F.concat(paths.node_path("mission", "program"), F.lit("="), F.col("stage"))
    lines = table(spark, sf_dir, "action_groups").where("mission IS NOT NULL AND program IS NOT NULL AND stage IS NOT NULL").select(line.alias("t")).distinct()
    return lines.agg(F.sha2(F.array_join(F.sort_array(F.collect_list("t")), "\n"), 256).alias("fingerprint"), F.count(F.lit(1)).alias("n"))


@query("""SELECT n_nationkey, '{"k":' || n_nationkey || ',"n":"' || n_name || '","r":' || n_regionkey || '}' AS canonical FROM nation""")
def canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as JSON with members in alphabetical order."""
    return table(spark, sf_dir, "nation").select("n_nationkey", F.to_json(F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("n"), F.col("n_regionkey").alias("r"))).alias("canonical"))


@query(
    """WITH i AS (SELECT DISTINCT source_id, table_index, row_index FROM pdf_facts WHERE amount_cents IS NULL AND source_id IS NOT NULL AND table_index IS NOT NULL AND row_index IS NOT NULL) SELECT f.id FROM pdf_facts f JOIN i USING (source_id, table_index, row_index)"""
)
def facts_with_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of rows in which some figure is missing."""
    facts = table(spark, sf_dir, "pdf_facts").select("id", "source_id", "table_index", "row_index", "amount_cents")
    key = ["source_id", "table_index", "row_index"]
    return facts.join(facts.where("amount_cents IS NULL").select(*key), key, "left_semi").select("id")


@query(
    """SELECT id, record_id FROM (SELECT f.id, d.record_id, row_number() OVER (PARTITION BY f.id ORDER BY d.received_at NULLS LAST, d.record_id) AS n FROM pdf_facts f JOIN delivery_check d ON f.source_id = d.source_id AND f.table_index = d.table_index) WHERE n = 1"""
)
def first_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with the first notice on their table: notices are reduced to one a table before facts meet them."""
    notices = table(spark, sf_dir, "delivery_check").where("source_id IS NOT NULL AND table_index IS NOT NULL")
    first = notices.groupBy("source_id", "table_index").agg(F.min(F.struct(F.col("received_at").isNull(), "received_at", "record_id"))["record_id"].alias("record_id"))
    return table(spark, sf_dir, "pdf_facts").join(first, ["source_id", "table_index"]).select("id", "record_id")


@query(
    """SELECT exercise, stage, count(DISTINCT entity) AS covered, count(DISTINCT CASE WHEN amount_cents IS NOT NULL THEN entity END) AS valued, count(DISTINCT entity) - count(DISTINCT CASE WHEN amount_cents IS NOT NULL THEN entity END) AS unvalued FROM pdf_facts GROUP BY ALL"""
)
def coverage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that are there, and those with a figure, of each year and stage."""
    facts = table(spark, sf_dir, "pdf_facts")
    covered, valued = F.countDistinct("entity"), F.countDistinct(F.when(F.col("amount_cents").isNotNull(), F.col("entity")))
    return facts.groupBy("exercise", "stage").agg(covered.alias("covered"), valued.alias("valued"), (covered - valued).alias("unvalued"))


@query("SELECT l_orderkey, l_linenumber, l_quantity AS quantity FROM lineitem")
def public_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only columns that are not private."""
    held = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"), F.lit(1).alias("_proof"))
    return lookup.public(held)


@query(
    "WITH h AS (SELECT id, context, regexp_matches(lower(context), 'réalisations') AS r, CASE WHEN contains(context, 'locales') THEN length(context) - strpos(reverse(context), reverse('locales')) ELSE -1 END AS a, CASE WHEN contains(context, 'caisses') THEN length(context) - strpos(reverse(context), reverse('caisses')) ELSE -1 END AS b FROM pdf_facts WHERE context IS NOT NULL) SELECT id, CASE WHEN a > b THEN 'LOCAL' WHEN b >= 0 THEN 'FUND' END AS heading FROM h WHERE a >= 0 OR b >= 0"
)
def last_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several headings in a context, the last one counts."""
    heading = lookup.last_heading(F.col("context"), {"locales": "LOCAL", "caisses": "FUND"})
    return table(spark, sf_dir, "pdf_facts").where("context IS NOT NULL").select("id", heading.alias("heading")).where("heading IS NOT NULL")
