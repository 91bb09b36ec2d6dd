"""Queries over a budget's hierarchy, from the facts and details of the action groups, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from centime.operators import budget, explorer, paths, reconcile
from centime.session import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


_F = """x AS (SELECT parent AS p FROM action_groups UNION ALL SELECT unnest(parents) FROM action_groups),
f AS (SELECT DISTINCT p."year" AS year, p.stage AS stage, p.measure AS measure, p.budget AS budget, p.mission AS mission, p.mission_label AS mission_label, p."program" AS program, p.program_label AS program_label,
  p."action" AS action, p.subaction AS subaction, p.category AS category, p.title AS title, p.cents AS cents, p."source" AS source, p.line AS line, p.field AS field, p.approximate AS approximate,
  concat_ws('/', nullif(p.mission, ''), nullif(p."program", ''), nullif(p."action", ''), nullif(p.subaction, '')) AS path FROM x WHERE p IS NOT NULL)"""
_N = """g AS (SELECT *, concat_ws('/', nullif(mission, ''), nullif(program, '')) AS base FROM action_groups),
a AS (SELECT record_id, base, source, x FROM (SELECT record_id, base, source, unnest(actions) AS x FROM g) WHERE x IS NOT NULL),
b AS (SELECT record_id, above, source, x FROM (SELECT record_id, concat_ws('/', nullif(base, ''), nullif(x.code, '')) AS above, source, unnest(x.subactions) AS x FROM a) WHERE x IS NOT NULL),
n AS (SELECT record_id, base AS path, NULL AS parent_path, 2 AS depth, parent.program_label AS label, published_total_euros * 100 AS cents, source, page FROM g
  UNION ALL SELECT record_id, concat_ws('/', nullif(base, ''), nullif(x.code, '')), base, 3, x.label, coalesce(x.cents, x.euros * 100), source, x.page FROM a
  UNION ALL SELECT record_id, concat_ws('/', nullif(above, ''), nullif(x.code, '')), above, 4, x.label, coalesce(x.cents, x.euros * 100), source, x.page FROM b)"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = budget.facts_of(table(spark, sf_dir, "action_groups"))
    return found.withColumn("path", paths.node_path(*budget.LEVELS))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget.nodes_of(table(spark, sf_dir, "action_groups"))


@query(
    f"""WITH {_F} SELECT year, stage, CASE WHEN year = 2022 AND mission = 'M3' THEN 'M1' ELSE mission END AS mission, program, title, cents, source, CASE WHEN year = 2022 AND mission = 'M3' THEN 'carried over' END AS note
FROM f WHERE year BETWEEN 2018 AND 2024 AND measure = 'CP' AND budget = 'BG'"""
)
def budget_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of some years, one measure and budget; a mission that carries on another one's series is read as that one."""
    lineages = spark.createDataFrame([(2022, "M3", "M1", "carried over")], "year int, mission string, to_mission string, note string")
    found = facts(spark, sf_dir).where("year BETWEEN 2018 AND 2024 AND measure = 'CP' AND budget = 'BG'")
    return budget.remap(found, lineages, ["year", "mission"], "mission").select("year", "stage", "mission", "program", "title", "cents", "source", "note")


@query(
    f"""WITH {_F}, {_N}, d AS (SELECT g.fiscal_year AS year, g.stage AS stage, n.depth FROM n JOIN action_groups g USING (record_id))
SELECT year, stage, CAST(min(depth) AS INTEGER) AS coarsest, CAST(max(depth) AS INTEGER) AS finest, count(*) AS nodes FROM d GROUP BY ALL"""
)
def grain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coarsest and finest level published in each year and stage."""
    dated = table(spark, sf_dir, "action_groups").select("record_id", F.col("fiscal_year").alias("year"), "stage")
    return nodes(spark, sf_dir).join(dated, "record_id").groupBy("year", "stage").agg(F.min("depth").alias("coarsest"), F.max("depth").alias("finest"), F.count(F.lit(1)).alias("nodes"))


@query(
    f"""WITH {_F}, l AS (SELECT *, CASE WHEN coalesce(mission, '') = '' THEN 0 WHEN coalesce(program, '') = '' THEN 1 WHEN coalesce(action, '') = '' THEN 2 WHEN coalesce(subaction, '') = '' THEN 3 ELSE 4 END AS level FROM f)
SELECT year, stage, CAST(min(level) AS INTEGER) AS level, count(*) AS n, count(DISTINCT program) AS programs FROM l GROUP BY ALL"""
)
def fact_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).groupBy("year", "stage").agg(F.min(budget.level_of(*budget.LEVELS)).alias("level"), F.count(F.lit(1)).alias("n"), F.countDistinct("program").alias("programs"))


@query(
    f"""WITH {_F}, {_N}, d AS (SELECT n.path, n.label, g.fiscal_year AS year FROM n JOIN action_groups g USING (record_id) WHERE n.path = 'M1/802' OR starts_with(n.path, 'M1/802/')),
i AS (SELECT *, len(string_split(path, '/')) AS size, array_to_string(string_split(path, '/')[1:3], '/') AS node FROM d)
SELECT node, arg_max(label, (year, label)) FILTER (size = 3) AS label, count(*) AS rows FROM i WHERE size > 2 GROUP BY 1"""
)
def drilldown_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The actions of a programme with the label of their latest year."""
    dated = table(spark, sf_dir, "action_groups").select("record_id", F.col("fiscal_year").alias("year"))
    return budget.labelled_groups(nodes(spark, sf_dir).join(dated, "record_id"), "M1/802", 2)


STAGES, YEARS, SCOPES = ("PLF", "LFI", "EXEC"), (2022, 2023, 2024, 2025), ("", "M1", "M2", "M2/803", "M9")
_CELLS = f"""{_F}, s AS (SELECT unnest({list(SCOPES)}) AS scope), y AS (SELECT unnest({list(YEARS)}) AS year), t AS (SELECT unnest({list(STAGES)}) AS stage),
h AS (SELECT s.scope, f.* FROM f JOIN s ON scope = '' OR path = scope OR starts_with(path, scope || '/') WHERE measure = 'CP'),
v AS (SELECT scope, year, stage, CAST(sum(cents) AS BIGINT) AS value, count(DISTINCT program) AS programs FROM h GROUP BY ALL), e AS (SELECT scope, year, count(DISTINCT program) AS expected FROM h WHERE stage IN ('PLF', 'LFI', 'EXEC') GROUP BY ALL),
c AS (SELECT scope, year, stage, value, coalesce(programs, 0) AS programs, coalesce(expected, 0) AS expected, CASE WHEN value IS NULL THEN 'missing' WHEN coalesce(programs, 0) < coalesce(expected, 0) THEN 'partial' ELSE 'ok' END AS status
  FROM s CROSS JOIN y CROSS JOIN t LEFT JOIN v USING (scope, year, stage) LEFT JOIN e USING (scope, year))"""


@query(f"WITH {_CELLS} SELECT * FROM c")
def scope_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series of several scopes over years and stages: sums, programmes there and expected, missing cells too."""
    scopes, years, stages = (spark.createDataFrame([(v,) for v in values], f"{n} {kind}") for values, n, kind in ((SCOPES, "scope", "string"), (YEARS, "year", "int"), (STAGES, "stage", "string")))
    return budget.scope_cells(facts(spark, sf_dir).where("measure = 'CP'"), scopes, years, stages, STAGES)


@query(
    f"""WITH {_CELLS}, o AS (SELECT scope, year, stage, CAST(sum(cents) AS BIGINT) + CASE WHEN year = 2023 THEN 1 ELSE 0 END AS total FROM h WHERE stage = 'EXEC' GROUP BY scope, year, stage)
SELECT c.scope, c.year, c.stage, value, programs, expected, CASE WHEN status = 'partial' AND value = total THEN 'ok' ELSE status END AS status FROM c LEFT JOIN o USING (scope, year, stage)"""
)
def confirmed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial cells that equal a separately published total exactly are whole; a cent apart they are not."""
    cells = scope_cells(spark, sf_dir)
    totals = cells.where("stage = 'EXEC' AND value IS NOT NULL").select("scope", "year", "stage", (F.col("value") + F.when(F.col("year") == 2023, 1).otherwise(0)).alias("total"))
    return explorer.confirmed_totals(cells, totals, ["scope", "year", "stage"])


@query(
    f"""WITH {_CELLS}, q AS (SELECT scope, year, stage, CAST(sum(cents) AS BIGINT) + CASE WHEN year = 2024 THEN 5 ELSE 0 END AS part FROM h WHERE title = '2' GROUP BY scope, year, stage)
SELECT c.scope, c.year, c.stage, value, CASE WHEN value - part >= 0 THEN value - part END AS rest, CASE WHEN value - part IS NULL THEN 'unavailable' WHEN value - part < 0 THEN 'part_exceeds_whole' ELSE 'ok' END AS rest_status FROM c LEFT JOIN q USING (scope, year, stage)"""
)
def without_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells less a reviewed part of them; none where the part is unknown or exceeds the whole."""
    scopes = spark.createDataFrame([(s,) for s in SCOPES], "scope string")
    part = paths.under_scopes(facts(spark, sf_dir).where("measure = 'CP' AND title = '2'"), scopes).groupBy("scope", "year", "stage").agg(F.sum("cents").alias("part"))
    part = part.withColumn("part", F.col("part") + F.when(F.col("year") == 2024, 5).otherwise(0))
    return explorer.without_part(scope_cells(spark, sf_dir), part, ["scope", "year", "stage"]).select("scope", "year", "stage", "value", "rest", "rest_status")


_PARENTS = "CASE WHEN len(list_filter(parents, lambda p: p IS NOT NULL)) > 0 THEN list_filter(parents, lambda p: p IS NOT NULL) WHEN parent IS NOT NULL THEN [parent] ELSE [] END"
_FIELDS = ("year", "stage", "measure", "budget", "mission", "mission_label", "program", "program_label", "action", "action_label", "subaction", "subaction_label", "category", "title", "cents", "source", "line", "field", "approximate")


def _printed(row: str) -> str:
    return " || '|' || ".join(f"coalesce(CAST({row}.\"{c}\" AS VARCHAR), '~')" for c in _FIELDS)


@query(
    f"""WITH x AS (SELECT parent AS p FROM action_groups UNION ALL SELECT unnest(parents) FROM action_groups), d AS (SELECT DISTINCT p FROM x WHERE p IS NOT NULL),
h AS (SELECT p."year" AS year, p.stage AS stage, p.measure AS measure, p.budget AS budget, p.mission AS mission, p."program" AS program, list_sort(list({_printed("p")})) AS held FROM d GROUP BY ALL),
w AS (SELECT record_id, fiscal_year AS year, stage, measure, budget, mission, program, source, sha256, list_sort(list_transform({_PARENTS}, lambda p: {_printed("p")})) AS wanted FROM action_groups),
s AS (SELECT DISTINCT source, CASE WHEN fiscal_year <> 2019 THEN sha256 ELSE 'other' END AS sha FROM action_groups)
SELECT record_id, min(CASE WHEN coalesce(wanted = held AND len(wanted) > 0, false) THEN CASE WHEN sha = w.sha256 THEN 'attached' ELSE 'source_changed' END ELSE 'parents_changed' END) AS status
FROM w LEFT JOIN h USING (year, stage, measure, budget, mission, program) LEFT JOIN s USING (source) GROUP BY 1"""
)
def attached_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each group's details may be used: parents complete and unchanged, source unchanged (that of one year has changed)."""
    groups = table(spark, sf_dir, "action_groups")
    sources = groups.select("source", F.when(F.col("fiscal_year") != 2019, F.col("sha256")).otherwise("other").alias("sha256"))
    return budget.review_status(groups, budget.facts_of(groups), sources)


_SUMS = f"""s AS (SELECT record_id, review_required, reconciliation_note, CAST(published_total_euros * 100 AS BIGINT) AS published, CAST(list_sum(list_transform({_PARENTS}, lambda p: p.cents)) AS BIGINT) AS canonical,
  CAST(list_sum(list_transform(list_filter(actions, lambda a: a IS NOT NULL), lambda a: coalesce(a.cents, a.euros * 100))) AS BIGINT) AS actions, len(list_filter(actions, lambda a: a IS NOT NULL)) AS members FROM action_groups)"""


def _sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each group: the published total, that of its parents and that of its actions."""

    def total(items: F.Column, value) -> F.Column:  # noqa: ANN001
        amounts = F.filter(F.transform(items, value), lambda v: v.isNotNull())
        return F.when(F.size(amounts) > 0, F.aggregate(amounts, F.lit(0).cast("bigint"), lambda s, v: s + v))

    several = F.filter("parents", lambda p: p.isNotNull())
    listed = F.when(F.size(several) > 0, several).otherwise(F.filter(F.array("parent"), lambda p: p.isNotNull()))
    held = F.filter("actions", lambda a: a.isNotNull())
    return table(spark, sf_dir, "action_groups").select(
        "record_id", "review_required", "reconciliation_note", (F.col("published_total_euros") * 100).alias("published"), total(listed, lambda p: p["cents"]).alias("canonical"),
        total(held, lambda a: F.coalesce(a["cents"], a["euros"] * 100)).alias("actions"), F.when(F.col("actions").isNotNull(), F.size(held)).alias("members"),
    )


@query(
    f"""WITH {_SUMS} SELECT record_id, published - canonical AS difference, coalesce(abs(actions - published) <= 100, false) AS own_agrees,
  coalesce(reconciliation_note <> '' AND canonical <> published AND abs(actions - published) <= 100 AND abs(published - canonical) * 10000 <= abs(canonical) * 150, false) AS shown FROM s WHERE review_required"""
)
def published_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups under review; shown are those with a note whose actions agree with their own publication, which is up to 1.5 % off the parents."""
    near = "reconciliation_note <> '' AND canonical <> published AND abs(actions - published) <= 100 AND abs(published - canonical) * 10000 <= abs(canonical) * 150"
    own = F.coalesce(F.expr("abs(actions - published) <= 100"), F.lit(False))
    held = _sums(spark, sf_dir).where("review_required")
    return held.select("record_id", (F.col("published") - F.col("canonical")).alias("difference"), own.alias("own_agrees"), F.coalesce(F.expr(near), F.lit(False)).alias("shown"))


_CLASS = "CASE WHEN gap = 0 THEN 'exact' WHEN gap <= least(1000, greatest(100, (members + 1) * 50)) THEN 'published_rounding_difference' WHEN gap <= least(1000, abs(reference) // 1000) THEN 'source_difference' ELSE 'material_difference' END"


@query(
    f"""WITH {_SUMS}, {_N}, u AS (SELECT record_id, 'programme' AS level, '' AS path, actions AS total, canonical AS reference, members FROM s WHERE actions IS NOT NULL AND canonical IS NOT NULL
UNION ALL SELECT b.record_id, 'action', b.above, CAST(sum(coalesce(b.x.cents, b.x.euros * 100)) AS BIGINT), min(n.cents), count(*) FROM b JOIN n ON n.record_id = b.record_id AND n.path = b.above AND n.depth = 3 GROUP BY b.record_id, b.above),
c AS (SELECT *, abs(total - reference) AS gap FROM u WHERE total IS NOT NULL AND reference IS NOT NULL) SELECT record_id, level, path, total, reference, {_CLASS} AS class FROM c"""
)
def action_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of actions against their programme and of subactions against their action, with the class of the difference."""
    top = _sums(spark, sf_dir).where("actions IS NOT NULL AND canonical IS NOT NULL").select("record_id", F.lit("programme").alias("level"), F.lit("").alias("path"), F.col("actions").alias("total"), F.col("canonical").alias("reference"), F.col("members").cast("bigint").alias("members"))
    held = nodes(spark, sf_dir)
    actions = held.where("depth = 3").select("record_id", "path", F.col("cents").alias("own"))
    met = held.where("depth = 4").select("record_id", F.col("parent_path").alias("path"), "cents").join(actions, ["record_id", "path"])
    below = met.groupBy("record_id", "path").agg(F.sum("cents").alias("total"), F.min("own").alias("reference"), F.count(F.lit(1)).alias("members")).withColumn("level", F.lit("action"))
    both = top.unionByName(below.select(*top.columns)).where("total IS NOT NULL AND reference IS NOT NULL")
    return both.select("record_id", "level", "path", "total", "reference", reconcile.tolerance_class(F.col("total"), F.col("reference"), F.col("members")).alias("class"))


@query(
    f"""WITH {_F}, k AS (SELECT DISTINCT fiscal_year AS year, stage, measure, budget, mission, program, true AS active FROM action_groups WHERE mission IN ('M1', 'M2')),
m AS (SELECT f.*, coalesce(active, false) AS merged_key FROM f LEFT JOIN k USING (year, stage, measure, budget, mission, program))
SELECT year, stage, measure, budget, mission, program, CAST(sum(cents) AS BIGINT) AS cents, max(coalesce(approximate, 0)) AS approximate, count(*) AS merged, CASE WHEN count(*) > 1 THEN '' ELSE max(title) END AS title FROM m
GROUP BY year, stage, measure, budget, mission, program, CASE WHEN merged_key THEN '' ELSE concat_ws('|', coalesce(title, '~'), coalesce(category, '~'), source, line, field, CAST(cents AS VARCHAR)) END"""
)
def merged_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of one programme by title, joined where a finer scope is asked for (two missions), kept apart elsewhere."""
    active = table(spark, sf_dir, "action_groups").where("mission IN ('M1', 'M2')").select(F.col("fiscal_year").alias("year"), *budget.KEY[1:])
    return budget.merge_siblings(facts(spark, sf_dir), active)


EXCLUSIONS = ("M1/802/01", "M1/802/02", "M1/802/01/01.1", "M4/805/03/03.3", "M4/805/04/04.1", "M2/803", "M0/801/99", "M3/804/01/01.1", "M3/804/01/01.2")
_OFF = f"""{_N}, e AS (SELECT unnest({list(EXCLUSIONS)}) AS e), o AS (SELECT e FROM e WHERE NOT EXISTS (SELECT 1 FROM e q WHERE q.e <> e.e AND starts_with(e.e, q.e || '/'))),
m AS (SELECT n.*, EXISTS (SELECT 1 FROM o WHERE path = e OR starts_with(path, e || '/')) AS gone FROM n),
sb AS (SELECT record_id, parent_path AS path, count(*) AS every, count(*) FILTER (gone) AS off_n, sum(cents) FILTER (gone) AS off, count(*) FILTER (gone AND cents IS NULL) AS unknown_n FROM m WHERE depth = 4 GROUP BY ALL),
ac AS (SELECT m.record_id, m.path, m.cents, gone OR coalesce(off_n = every, false) AS whole, off_n, off, unknown_n FROM m LEFT JOIN sb USING (record_id, path) WHERE depth = 3),
av AS (SELECT record_id, path, cents, whole, CASE WHEN whole THEN cents WHEN coalesce(off_n, 0) > 0 THEN off END AS off, CASE WHEN whole THEN cents IS NULL ELSE coalesce(unknown_n > 0, false) END AS unknown FROM ac),
sm AS (SELECT record_id, count(*) AS every, count(*) FILTER (whole) AS whole_n, sum(off) AS off, count(off) AS parts, count(*) FILTER (unknown) AS unknown_n FROM av GROUP BY 1),
lo AS (SELECT DISTINCT g.record_id FROM m g JOIN o ON starts_with(e, g.path || '/') WHERE g.depth = 2 AND array_to_string(string_split(e, '/')[1:2], '/') = g.path AND NOT EXISTS (SELECT 1 FROM m k WHERE k.record_id = g.record_id AND k.path = e)),
r AS (SELECT m.record_id, m.path, m.cents AS own, sm.off, CASE WHEN gone THEN 'fully_excluded' WHEN lo.record_id IS NOT NULL OR coalesce(unknown_n, 0) > 0 THEN 'detail_unavailable' WHEN coalesce(whole_n = every, false) THEN 'fully_excluded'
  WHEN coalesce(parts, 0) > 0 THEN 'computed' ELSE 'unchanged' END AS status FROM m LEFT JOIN sm USING (record_id) LEFT JOIN lo USING (record_id) WHERE depth = 2)"""


@query(f"WITH {_OFF} SELECT record_id, path, CAST(CASE status WHEN 'fully_excluded' THEN 0 WHEN 'computed' THEN own - off WHEN 'unchanged' THEN own END AS BIGINT) AS cents, status FROM r")
def subtracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programmes less excluded actions and subactions; branches excluded to the last part go whole."""
    return budget.subtract(nodes(spark, sf_dir), spark.createDataFrame([(e,) for e in EXCLUSIONS], "path string"))[0]


@query(
    f"""WITH {_OFF} SELECT record_id, path, own AS cents, 'published' AS operation FROM r WHERE status IN ('computed', 'unchanged')
UNION ALL SELECT record_id, av.path, -cents, 'subtract' FROM av JOIN r USING (record_id) WHERE whole AND status = 'computed'
UNION ALL SELECT m.record_id, m.path, -m.cents, 'subtract' FROM m JOIN r USING (record_id) WHERE m.depth = 4 AND gone AND status = 'computed' AND NOT EXISTS (SELECT 1 FROM av WHERE av.record_id = m.record_id AND av.path = m.parent_path AND whole)"""
)
def exclusion_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signed rows that each figure of subtracted comes from."""
    return budget.subtract(nodes(spark, sf_dir), spark.createDataFrame([(e,) for e in EXCLUSIONS], "path string"))[1]


@query(f"WITH {_OFF} SELECT DISTINCT path FROM (SELECT e AS path FROM e UNION ALL SELECT path FROM r WHERE status = 'fully_excluded')")
def effective_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exclusions asked for, and the programmes that they leave nothing of."""
    asked = spark.createDataFrame([(e,) for e in EXCLUSIONS], "path string")
    return asked.unionByName(budget.subtract(nodes(spark, sf_dir), asked)[0].where("status = 'fully_excluded'").select("path")).distinct()


@query(
    f"""WITH {_SUMS}, {_N}, u AS (SELECT b.record_id, b.above AS path, CAST(sum(coalesce(b.x.cents, b.x.euros * 100)) AS BIGINT) AS total, min(n.cents) AS reference, count(*) AS members FROM b JOIN n ON n.record_id = b.record_id AND n.path = b.above AND n.depth = 3 GROUP BY b.record_id, b.above),
c AS (SELECT *, abs(total - reference) AS gap FROM u) SELECT g.record_id, g.base AS path, 'review_required' AS reason FROM g WHERE review_required
UNION ALL SELECT record_id, path, 'parts_differ' FROM c WHERE {_CLASS} = 'material_difference'"""
)
def blocked_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branches whose details may not be used: groups under review, and actions whose subactions do not add up."""
    groups = table(spark, sf_dir, "action_groups").where("review_required").select("record_id", paths.node_path("mission", "program").alias("path"), F.lit("review_required").alias("reason"))
    apart = action_sums(spark, sf_dir).where("level = 'action' AND class = 'material_difference'").select("record_id", "path", F.lit("parts_differ").alias("reason"))
    return groups.unionByName(apart)


@query(
    f"""WITH {_N} SELECT path, array_to_string(list_sort(list(DISTINCT source)), '|') AS sources, coalesce(array_to_string(list_sort(list(DISTINCT page) FILTER (page IS NOT NULL)), '|'), '') AS pages, count(DISTINCT (source, page)) FILTER (page IS NOT NULL) AS citations FROM n WHERE depth = 3 GROUP BY 1"""
)
def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources, pages and citations of each action."""
    actions = nodes(spark, sf_dir).where("depth = 3")
    return actions.groupBy("path").agg(
        F.array_join(F.array_sort(F.collect_set("source")), "|").alias("sources"), F.array_join(F.array_sort(F.collect_set("page")).cast("array<string>"), "|").alias("pages"),
        F.countDistinct(F.when(F.col("page").isNotNull(), F.struct("source", "page"))).alias("citations"),
    )


@query(
    f"""WITH {_F}, p AS (SELECT year, stage, measure, f.path, f.cents, f.source, s.title AS document, s.url, line, field, f.title FROM f LEFT JOIN (SELECT left(source_id, 20) AS source, title, url FROM sources) s USING (source)),
q AS (SELECT *, row_number() OVER (ORDER BY year DESC NULLS LAST, path, stage, measure, cents, source, line NULLS FIRST, field, title NULLS FIRST) AS place, count(*) OVER () > 300 AS truncated FROM p) SELECT CAST(place AS INTEGER) AS place, year, stage, measure, path, cents, source, document, url, truncated FROM q WHERE place <= 300"""
)
def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 300 facts with their documents, and whether there are more: a report of bounded length."""
    from centime.operators.search import first_rows

    documents = table(spark, sf_dir, "sources").select(F.substring("source_id", 1, 20).alias("source"), F.col("title").alias("document"), "url")
    met = facts(spark, sf_dir).join(documents, "source", "left")
    order = [F.desc_nulls_last("year"), F.asc("path"), F.asc("stage"), F.asc("measure"), F.asc("cents"), F.asc("source"), F.asc_nulls_first("line"), F.asc("field"), F.asc_nulls_first("title")]
    return first_rows(met, order, 300).select("place", "year", "stage", "measure", "path", "cents", "source", "document", "url", "truncated")


@query(
    f"""WITH {_F} SELECT year, measure, program FROM f WHERE stage = 'PLF' EXCEPT SELECT year, measure, program FROM f WHERE stage = 'EXEC'"""
)
def programs_not_executed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programmes that a year expects and its execution lacks."""
    held = facts(spark, sf_dir)
    key = ["year", "measure", "program"]
    return held.where("stage = 'PLF'").select(*key).distinct().join(held.where("stage = 'EXEC'").select(*key).distinct(), key, "left_anti")


@query(f"WITH {_F} SELECT program, min(mission) AS mission, count(DISTINCT mission) AS missions, count(DISTINCT mission) = 1 AS is_unique FROM f WHERE program IS NOT NULL GROUP BY 1")
def program_missions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mission of each programme, and whether it is the only one."""
    held = facts(spark, sf_dir).where("program IS NOT NULL").groupBy("program").agg(F.min("mission").alias("mission"), F.countDistinct("mission").alias("missions"))
    return held.withColumn("is_unique", F.col("missions") == 1)


@query(
    f"""WITH {_F}, k AS (SELECT DISTINCT year, program, program_label FROM f) SELECT year, program, program_label, CAST(row_number() OVER (PARTITION BY year ORDER BY TRY_CAST(program AS INTEGER) NULLS LAST, program_label NULLS LAST) AS INTEGER) AS natural_place,
CAST(row_number() OVER (PARTITION BY year ORDER BY regexp_replace(lower(strip_accents(program_label)), '[^a-z0-9]', '', 'g') NULLS LAST, program_label NULLS LAST, TRY_CAST(program AS INTEGER) NULLS LAST) AS INTEGER) AS label_place FROM k"""
)
def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programmes in the order of their numbers, and in that of their normalised labels."""
    from centime.functions.scalars import norm

    held = facts(spark, sf_dir).select("year", "program", "program_label").distinct()
    number, label = F.asc_nulls_last(F.col("program").try_cast("int")), F.asc_nulls_last("program_label")
    placed = budget.numbered(held, ["year"], [number, label], "natural_place")
    return budget.numbered(placed, ["year"], [norm("program_label").asc_nulls_last(), label, number], "label_place")


@query(
    f"""WITH {_F}, c AS (SELECT year, stage, measure, budget, mission, program, count(*) AS n, max(cents) AS held FROM f GROUP BY ALL),
d AS (SELECT record_id, fiscal_year AS year, stage, measure, budget, mission, program, parent.cents AS before, published_total_euros * 100 AS after FROM action_groups),
m AS (SELECT d.*, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' WHEN held IS NOT DISTINCT FROM before THEN 'applied' ELSE 'value_changed' END AS status FROM d LEFT JOIN c USING (year, stage, measure, budget, mission, program))
SELECT record_id, status, CASE WHEN status = 'applied' THEN after - before END AS impact FROM m"""
)
def change_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published totals as corrections of the facts: which ones still apply, and by how much."""
    changes = table(spark, sf_dir, "action_groups").select("record_id", F.col("fiscal_year").alias("year"), *budget.KEY[1:], F.col("parent.cents").alias("before"), (F.col("published_total_euros") * 100).alias("after"))
    return budget.apply_changes(facts(spark, sf_dir), changes, list(budget.KEY), "cents").select("record_id", "status", "impact")


@query(
    f"""WITH {_F}, c AS (SELECT year, stage, measure, budget, mission, program, count(*) AS n, max(cents) AS held FROM f GROUP BY ALL),
d AS (SELECT source, fiscal_year AS year, stage, measure, budget, mission, program, parent.cents AS before, published_total_euros * 100 AS after FROM action_groups)
SELECT year, stage, measure, budget, mission, CAST(sum(after - before) AS BIGINT) AS impact, count(*) AS changes, array_to_string(list_sort(list(DISTINCT source)), '|') AS sources FROM d JOIN c USING (year, stage, measure, budget, mission, program) WHERE n = 1 AND held = before GROUP BY ALL"""
)
def change_impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the corrections that apply add up to, by mission."""
    changes = table(spark, sf_dir, "action_groups").select("source", F.col("fiscal_year").alias("year"), *budget.KEY[1:], F.col("parent.cents").alias("before"), (F.col("published_total_euros") * 100).alias("after"))
    applied = budget.apply_changes(facts(spark, sf_dir).drop("source"), changes, list(budget.KEY), "cents").where("status = 'applied' AND before IS NOT NULL")
    return applied.groupBy(*budget.KEY[:5]).agg(F.sum("impact").alias("impact"), F.count(F.lit(1)).alias("changes"), F.array_join(F.array_sort(F.collect_set("source")), "|").alias("sources"))


@query("SELECT fiscal_year, measure, count(*) AS n, count(*) = 1 AS single FROM action_groups WHERE reconciliation_note IS NOT NULL GROUP BY ALL")
def annual_adjustments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documented adjustments of a year and measure, of which there may be one."""
    noted = table(spark, sf_dir, "action_groups").where("reconciliation_note IS NOT NULL")
    return noted.groupBy("fiscal_year", "measure").agg(F.count(F.lit(1)).alias("n")).withColumn("single", F.col("n") == 1)


@query(
    f"""WITH {_SUMS}, t AS (SELECT g.fiscal_year, g.stage, g.measure, g.mission, CAST(sum(s.published) AS BIGINT) AS total, CAST(sum(s.canonical) AS BIGINT) AS reference, count(*) AS members FROM s JOIN action_groups g USING (record_id) WHERE s.published IS NOT NULL AND s.canonical IS NOT NULL GROUP BY ALL),
c AS (SELECT *, abs(total - reference) AS gap FROM t) SELECT fiscal_year, stage, measure, mission, total, reference, {_CLASS} AS class FROM c"""
)
def mission_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published totals of each mission against those of the parents."""
    of = table(spark, sf_dir, "action_groups").select("record_id", "fiscal_year", "stage", "measure", "mission")
    sums = _sums(spark, sf_dir).where("published IS NOT NULL AND canonical IS NOT NULL").join(of, "record_id")
    totals = sums.groupBy("fiscal_year", "stage", "measure", "mission").agg(F.sum("published").alias("total"), F.sum("canonical").alias("reference"), F.count(F.lit(1)).alias("members"))
    return totals.withColumn("class", reconcile.tolerance_class(F.col("total"), F.col("reference"), F.col("members"))).drop("members")
