"""Queries over documents, passages and registries, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from centime.functions import scalars
from centime.operators import hierarchy, reconcile, search, status, textprep
from centime.operators.flatten import SCHEMAS
from centime.session import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query("SELECT seq, id FROM passages p WHERE EXISTS (SELECT 1 FROM occurrences o JOIN sources s ON o.asset_sha = s.sha256 WHERE o.passage_id = p.id AND s.status = 'downloaded')")
def semi_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = table(spark, sf_dir, "sources").where("status = 'downloaded'").select(F.col("sha256").alias("asset_sha"))
    cited = table(spark, sf_dir, "occurrences").join(sources, "asset_sha", "left_semi").select(F.col("passage_id").alias("id"))
    return table(spark, sf_dir, "passages").select("seq", "id").join(cited, "id", "left_semi").select("seq", "id")


@query("SELECT seq FROM passages p WHERE NOT EXISTS (SELECT 1 FROM occurrences o WHERE o.passage_id = p.id)")
def anti_uncited(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = table(spark, sf_dir, "occurrences").select(F.col("passage_id").alias("id"))
    return table(spark, sf_dir, "passages").select("seq", "id").join(cited, "id", "left_anti").select("seq")


@query(
    """WITH o AS (SELECT DISTINCT passage_id, asset_sha, locator FROM occurrences WHERE passage_id IS NOT NULL),
c AS (SELECT o.passage_id, s.source_id, o.locator, row_number() OVER (PARTITION BY passage_id ORDER BY CASE WHEN s.status = 'downloaded' THEN 0 ELSE 1 END, s.title NULLS LAST, o.locator NULLS LAST, s.source_id) AS n
  FROM o JOIN sources s ON o.asset_sha = s.sha256)
SELECT passage_id, source_id, locator, TRY_CAST(nullif(regexp_extract(locator, 'page:([0-9]+)', 1), '') AS INTEGER) AS page, CAST(n AS INTEGER) AS place FROM c WHERE n <= 8"""
)
def ranked_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = table(spark, sf_dir, "sources").select("source_id", "title", "status", F.col("sha256").alias("asset_sha"))
    cited = table(spark, sf_dir, "occurrences").select("passage_id", "asset_sha", "locator").where("passage_id IS NOT NULL").distinct().join(sources, "asset_sha")
    order = [F.when(F.col("status") == "downloaded", 0).otherwise(1), F.asc_nulls_last("title"), F.asc_nulls_last("locator"), F.asc("source_id")]
    return search.limit_per_group(cited, ["passage_id"], order, 8).select("passage_id", "source_id", "locator", search.page_of(F.col("locator")).alias("page"), "place")


MARKED, PLAIN = scalars.MARKED, scalars.PLAIN
_WORDS = f"regexp_extract_all(translate(lower(text), '{MARKED}', '{PLAIN}'), '[a-z0-9]+')"
TERMS = ["fonds", "solidarite", "deficit"]


def _bm25_sql(terms: list[str]) -> str:
    counts = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS t{i}" for i, t in enumerate(terms))
    totals = ", ".join(f"count(*) FILTER (t{i} > 0) AS d{i}" for i in range(len(terms)))
    score = " + ".join(
        f"ln(1.0::DOUBLE + (n - d{i} + 0.5::DOUBLE) / (d{i} + 0.5::DOUBLE)) * (t{i} * 2.2::DOUBLE / (t{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / a)))" for i in range(len(terms))
    )
    hit = " AND ".join(f"t{i} > 0" for i in range(len(terms)))
    return f"""t AS (SELECT doc_id, len(w) AS l, {counts} FROM (SELECT doc_id, {_WORDS} AS w FROM documents)), s AS (SELECT count(*) AS n, avg(l) AS a, {totals} FROM t WHERE l > 0),
lexical AS (SELECT doc_id, round({score}, 6) AS score FROM t, s WHERE {hit})"""


def lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", TERMS)


@query(f"WITH {_bm25_sql(TERMS)} SELECT doc_id, round(score, 4) AS score FROM lexical")
def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical(spark, sf_dir).select("doc_id", F.round("score", 4).alias("score"))


@query(f"WITH {_bm25_sql(TERMS)} SELECT doc_id, CAST(row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS INTEGER) AS place FROM lexical ORDER BY score DESC, doc_id LIMIT 240")
def topk_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(lexical(spark, sf_dir), "doc_id")


_DENSE = """q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)),
dense AS (SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], q) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q, q))), 6) AS score FROM embeddings, q)"""


def _first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").orderBy("vec_id").limit(1).first()["embedding"])


@query(f"WITH {_DENSE} SELECT vec_id, score FROM dense ORDER BY score DESC, vec_id LIMIT 20")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.dense_topk(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", _first_vector(spark, sf_dir), 20)


SPARSE_QUERY = {11: 0.5, 64: 0.25, 309: 1.0, 1716: 2.0}
_SPARSE = (
    "sparse AS (SELECT seq, sum(w::DOUBLE * q) AS score FROM (SELECT seq, unnest(sparse_ids) AS i, unnest(sparse_weights) AS w FROM passages) JOIN (VALUES "
    + ", ".join(f"({t}, {w}::DOUBLE)" for t, w in SPARSE_QUERY.items())
    + ") v(t, q) ON i = t GROUP BY 1 HAVING sum(w::DOUBLE * q) > 0)"
)


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.sparse_scores(table(spark, sf_dir, "passages"), "seq", "sparse_ids", "sparse_weights", SPARSE_QUERY)


@query(f"WITH {_SPARSE} SELECT seq, round(score, 6) AS score FROM sparse")
def sparse_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse(spark, sf_dir).select("seq", F.round("score", 6).alias("score"))


@query(
    f"""WITH {_bm25_sql(TERMS)}, {_DENSE},
l AS (SELECT doc_id AS k, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS p FROM lexical QUALIFY p < 240),
d AS (SELECT vec_id AS k, row_number() OVER (ORDER BY score DESC, vec_id) - 1 AS p FROM dense QUALIFY p < 240),
u AS (SELECT k, 'lexical' AS m, 1.0::DOUBLE / (p + 60) AS g FROM l UNION ALL SELECT k, 'dense', 0.5::DOUBLE / (p + 60) FROM d)
SELECT k, round(sum(g), 9) AS score, array_to_string(list_sort(list(DISTINCT m)), '+') AS methods FROM u GROUP BY 1"""
)
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = search.ranked(lexical(spark, sf_dir).withColumnRenamed("doc_id", "k"), "k")
    vectors = table(spark, sf_dir, "embeddings")
    second = search.ranked(search.dense_topk(vectors, "vec_id", "embedding", _first_vector(spark, sf_dir), search.DEPTH).withColumnRenamed("vec_id", "k"), "k")
    return search.fuse("k", lexical=(first, 1.0), dense=(second, 0.5))


@query(
    f"""SELECT n_name, translate(lower(n_name), '{MARKED}', '{PLAIN}') AS folded, regexp_replace(translate(lower(n_name), '{MARKED}', '{PLAIN}'), '[^a-z0-9]', '', 'g') AS norm,
  CASE WHEN length(CAST(n_nationkey AS VARCHAR)) >= 3 THEN CAST(n_nationkey AS VARCHAR) ELSE lpad(CAST(n_nationkey AS VARCHAR), 3, '0') END AS code, substr(sha256(n_name), 1, 24) AS identity FROM nation"""
)
def scalars_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        "n_name", scalars.fold("n_name").alias("folded"), scalars.norm("n_name").alias("norm"), scalars.code(F.col("n_nationkey").cast("string"), 3).alias("code"), scalars.identity("n_name").alias("identity")
    )


@query(
    """SELECT doc_id, '|' || array_to_string(list_sort(list_distinct(years)), '|') || '|' AS key, len(list_distinct(list_filter(years, lambda x: x IS NOT NULL))) AS n FROM documents WHERE len(years) > 0"""
)
def path_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = scalars.years_key(F.col("years"))
    return table(spark, sf_dir, "documents").where(F.size("years") > 0).select("doc_id", key.alias("key"), F.size(F.filter(scalars.years_of(key), lambda y: y.isNotNull())).cast("bigint").alias("n"))


@query("SELECT sha256(text) AS digest, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textprep.exact_dedup(table(spark, sf_dir, "documents"), "text", "doc_id")


@query("SELECT event_type, json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY ALL")
def json_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type", F.get_json_object("props", "$.k").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query()
def content_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.content_digest(table(spark, sf_dir, "pdf_facts"))


@query(
    """WITH r AS (SELECT id, coalesce(passage_id, '~') || '|' || coalesce(asset_sha, '~') || '|' || coalesce(record_ref, '~') || '|' || coalesce(locator, '~') || '|' || coalesce(chunk_json, '~') AS t FROM occurrences),
b AS (SELECT substr(id, 1, 2) AS b, sha256(string_agg(sha256(id || '|' || t), '' ORDER BY id, sha256(id || '|' || t))) AS d, count(*) AS n FROM r GROUP BY 1)
SELECT sha256(string_agg(b || d, '' ORDER BY b)) AS digest, CAST(sum(n) AS BIGINT) AS n FROM b"""
)
def ordered_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of all occurrences in the order of their ids."""
    occurrences = table(spark, sf_dir, "occurrences")
    return reconcile.ordered_digest(occurrences, "id", ["passage_id", "asset_sha", "record_ref", "locator", "chunk_json"])


@query(
    """WITH r AS (SELECT source_id, table_index, id, coalesce(row_label, '') || ' : ' || coalesce(raw, '') AS line, row_number() OVER (PARTITION BY source_id, table_index ORDER BY row_index, column_index, id) - 1 AS n FROM pdf_facts)
SELECT source_id, table_index, CAST(n // 32 AS INTEGER) AS block, count(*) AS lines, string_agg(line, chr(10) ORDER BY n) AS text FROM r GROUP BY ALL"""
)
def passage_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "pdf_facts")
    line = F.concat(F.coalesce("row_label", F.lit("")), F.lit(" : "), F.coalesce("raw", F.lit("")))
    rows = facts.select("source_id", "table_index", "row_index", "column_index", "id", line.alias("line"))
    return textprep.row_blocks(rows, ["source_id", "table_index"], [F.asc_nulls_last("row_index"), F.asc_nulls_last("column_index"), F.asc("id")], "line", stretch=F.floor(F.col("row_index") / 512))


SEGMENTS = "array<struct<block:int,char_start:int,char_end:int,text:string>>"


@query(
    """WITH o AS (SELECT DISTINCT id, chunk_json FROM occurrences WHERE json_valid(chunk_json) AND json_type(chunk_json, '$.segments') = 'ARRAY'),
s AS (SELECT id, TRY_CAST(x->>'$.block' AS INTEGER) AS block, TRY_CAST(x->>'$.char_start' AS INTEGER) AS b, TRY_CAST(x->>'$.char_end' AS INTEGER) AS e FROM (SELECT id, unnest(CAST(chunk_json->'$.segments' AS JSON[])) AS x FROM o)),
l AS (SELECT id, block, b, e, b - lag(e) OVER (PARTITION BY id, block ORDER BY b, e) AS shift FROM s WHERE b IS NOT NULL AND e IS NOT NULL)
SELECT id, count(*) AS segments, CAST(sum(CASE WHEN shift <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS breaks, CAST(sum(e - b) AS BIGINT) AS characters FROM l GROUP BY 1"""
)
def segment_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "occurrences").select("id", "chunk_json").distinct()
    read = chunks.select("id", F.explode(F.from_json("chunk_json", f"struct<segments:{SEGMENTS}>").segments).alias("s")).select("id", "s.*").where("char_start IS NOT NULL AND char_end IS NOT NULL")
    whole = read.groupBy("id").agg(F.count(F.lit(1)).alias("segments"), F.sum((F.col("char_end") - F.col("char_start")).cast("bigint")).alias("characters"))
    broken = textprep.segment_breaks(read, ["id", "block"], "char_start", "char_end").groupBy("id").agg(F.count(F.lit(1)).alias("breaks"))
    return whole.join(broken, "id", "left").select("id", "segments", F.coalesce("breaks", F.lit(0)).cast("bigint").alias("breaks"), "characters")


@query()
def coverage_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the segments of a chunk tile its body."""
    chunks = table(spark, sf_dir, "occurrences").select("id", F.from_json("chunk_json", f"struct<body:string,segments:{SEGMENTS}>").alias("c"))
    return textprep.tiling(chunks.select("id", F.col("c.body").alias("body"), F.col("c.segments.text").alias("parts")), "id", "body", "parts")


@query(
    """WITH e AS (SELECT event_id, event_type, CAST(round(value * 100) AS BIGINT) AS cents FROM events)
SELECT event_id, s AS status, CASE WHEN s = 'published' THEN cents END AS cents FROM (SELECT *, CASE WHEN event_id % 17 = 0 THEN 'source_unverified' WHEN event_type = 'error' THEN 'not_applicable' WHEN event_id % 5 = 0 THEN 'detail_unavailable'
  WHEN cents IS NULL THEN 'not_reported' WHEN event_id % 7 = 0 THEN 'inflation_missing' ELSE 'published' END AS s FROM e)"""
)
def status_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "event_type", F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    rules = (
        (F.col("event_id") % 17 == 0, "source_unverified"),
        (F.col("event_type") == "error", "not_applicable"),
        (F.col("event_id") % 5 == 0, "detail_unavailable"),
        (F.col("cents").isNull(), "not_reported"),
        (F.col("event_id") % 7 == 0, "inflation_missing"),
    )
    return status.with_status(events, "cents", *rules).select("event_id", "status", "cents")


@query(
    """WITH a AS (SELECT record_id, actions FROM action_groups),
t AS (SELECT record_id, generate_subscripts(actions, 1) - 1 AS no, unnest(actions) AS x FROM a), s AS (SELECT record_id, no, generate_subscripts(x.subactions, 1) - 1 AS i, unnest(x.subactions) AS y FROM t)
SELECT record_id, 1 AS depth, CAST(no AS INTEGER) AS no, -1 AS inner_no, x.code AS code, x.label AS label, coalesce(x.cents, x.euros * 100) AS cents FROM t
UNION ALL SELECT record_id, 2, CAST(no AS INTEGER), CAST(i AS INTEGER), y.code, y.label, coalesce(y.cents, y.euros * 100) FROM s"""
)
def action_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.walk(table(spark, sf_dir, "action_groups"), ["record_id"])


NOTICE_KEY = {"source_id": "string", "table_index": "int", "exercise": "int", "perimeter": "string", "entity": "string", "row": "int"}


def _facts_with_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "pdf_facts")
    return facts.select("id", "source_id", "source_sha", "table_index", "exercise", "perimeter", "entity", "metric", "amount_cents", F.coalesce("balance_row_index", "row_index").alias("row"))


def _notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, n).select("record_id", "notice_key", "source_sha", "values_cents") for n in ("delivery_check", "source_reconciliation")]
    return parts[0].unionByName(parts[1])


@query(
    """WITH n AS (SELECT record_id, notice_key AS k, source_sha FROM delivery_check WHERE len(notice_key) = 6 UNION ALL SELECT record_id, notice_key, source_sha FROM source_reconciliation WHERE len(notice_key) = 6)
SELECT n.record_id, count(*) AS facts FROM pdf_facts f JOIN n ON n.k[1] = f.source_id AND TRY_CAST(n.k[2] AS INTEGER) = f.table_index AND TRY_CAST(n.k[3] AS INTEGER) = f.exercise AND n.k[4] = f.perimeter AND n.source_sha = f.source_sha GROUP BY 1"""
)
def notice_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many facts of a notice's table, year and perimeter are there at all."""
    key = {k: v for k, v in NOTICE_KEY.items() if k not in ("entity", "row")}
    return reconcile.notices_of(_facts_with_row(spark, sf_dir), _notices(spark, sf_dir), key).groupBy("record_id").agg(F.count(F.lit(1)).alias("facts"))


@query(
    """SELECT source_id, count(DISTINCT source_sha) AS hashes, count(*) AS facts, bool_and(source_sha = sha256) AS verified FROM pdf_facts JOIN (SELECT source_id AS s, sha256 FROM sources) ON s = source_id GROUP BY 1"""
)
def verified_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "sources").select("source_id", "sha256")
    met = table(spark, sf_dir, "pdf_facts").join(known, "source_id")
    return met.groupBy("source_id").agg(F.countDistinct("source_sha").alias("hashes"), F.count(F.lit(1)).alias("facts"), F.bool_and(F.col("source_sha") == F.col("sha256")).alias("verified"))


@query(
    """WITH d AS (SELECT sha256, list_sort(list(source_id)) AS ids, max(publication_year) AS y, count(*) AS n FROM sources WHERE path IS NOT NULL GROUP BY 1) SELECT sha256, array_to_string(ids, '|') AS ids, y, n FROM d"""
)
def source_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "sources").where("path IS NOT NULL")
    return held.groupBy("sha256").agg(F.array_join(F.sort_array(F.collect_list("source_id")), "|").alias("ids"), F.max("publication_year").alias("y"), F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, doc_format, source FROM documents WHERE list_contains(years, 2024) AND doc_format = 'pdf' AND contains(lower(title), 'comptes')")
def document_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = F.array_contains("years", 2024) & (F.col("doc_format") == "pdf") & F.lower("title").contains("comptes")
    return table(spark, sf_dir, "documents").where(wanted).select("doc_id", "doc_format", "source")


@query("SELECT fiscal_year, stage, budget, count(*) AS n, count(DISTINCT program) AS programs, CAST(sum(published_total_euros) AS BIGINT) AS euros FROM action_groups WHERE NOT review_required GROUP BY ALL")
def registry_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = table(spark, sf_dir, "action_groups").where("NOT review_required")
    return groups.groupBy("fiscal_year", "stage", "budget").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("program").alias("programs"), F.sum("published_total_euros").alias("euros"))


_REGISTRY = r"""r AS (SELECT registry, record_id, CAST(payload AS JSON) AS p FROM registry_raw WHERE json_valid(payload)),
c AS (SELECT registry, record_id, CASE WHEN json_type(p) = 'ARRAY' THEN p WHEN json_type(p) <> 'OBJECT' THEN '[]'::JSON WHEN json_exists(p, '$.items') THEN p -> '$.items' WHEN json_exists(p, '$.source_arithmetic_notices') THEN p -> '$.source_arithmetic_notices'
  WHEN json_exists(p, '$.groups') THEN p -> '$.groups' ELSE json_array(p) END AS a FROM r),
i AS (SELECT registry, record_id, unnest(range(len(l))) AS item_no, unnest(l) AS it FROM (SELECT registry, record_id, CAST(CASE WHEN json_type(a) = 'ARRAY' THEN a WHEN json_type(a) = 'NULL' THEN '[]'::JSON ELSE json_array(a) END AS JSON[]) AS l FROM c)
  UNION ALL SELECT 'source-reconciliation', record_id, 0, to_json(source_reconciliation) FROM source_reconciliation UNION ALL SELECT 'delivery-check', record_id, 0, to_json(delivery_check) FROM delivery_check
  UNION ALL SELECT 'actions-p174', record_id, 0, to_json(action_groups) FROM action_groups),
o AS (SELECT * FROM i WHERE json_type(it) = 'OBJECT'),
f AS (SELECT registry, record_id, item_no, 'comparison' AS tag, 'comparisons' AS field, it -> '$.comparisons' AS x FROM o UNION ALL SELECT registry, record_id, item_no, 'document', 'supporting_documents', it -> '$.supporting_documents' FROM o
  UNION ALL SELECT registry, record_id, item_no, 'evidence', 'evidence', it -> '$.evidence' FROM o UNION ALL SELECT registry, record_id, item_no, 'parent', 'parent', it -> '$.parent' FROM o
  UNION ALL SELECT registry, record_id, item_no, 'parent', 'parents', it -> '$.parents' FROM o UNION ALL SELECT registry, record_id, item_no, 'action', 'actions', it -> '$.actions' FROM o),
k AS (SELECT registry, record_id, item_no, tag, field, unnest(range(len(l))) AS child_no, unnest(l) AS y FROM (SELECT registry, record_id, item_no, tag, field, CAST(CASE WHEN json_type(x) = 'ARRAY' THEN x ELSE json_array(x) END AS JSON[]) AS l FROM f WHERE x IS NOT NULL AND json_type(x) <> 'NULL')),
d AS (SELECT * FROM k WHERE json_type(y) = 'OBJECT'),
n AS (SELECT registry, record_id, item_no, 'subaction' AS tag, 'subactions' AS field, child_no AS parent_no, y -> '$.subactions' AS x FROM d WHERE tag = 'action'),
m AS (SELECT registry, record_id, item_no, tag, field, parent_no, unnest(range(len(l))) AS child_no, unnest(l) AS y FROM (SELECT registry, record_id, item_no, tag, field, parent_no, CAST(CASE WHEN json_type(x) = 'ARRAY' THEN x ELSE json_array(x) END AS JSON[]) AS l FROM n WHERE x IS NOT NULL AND json_type(x) <> 'NULL')),
every AS (SELECT registry, record_id, item_no, 'item' AS tag, NULL AS field, 0 AS child_no, NULL AS parent_tag, NULL AS parent_no, it AS y FROM o UNION ALL SELECT registry, record_id, item_no, tag, field, child_no, 'item', 0, y FROM d
  UNION ALL SELECT registry, record_id, item_no, tag, field, child_no, 'action', parent_no, y FROM m WHERE json_type(y) = 'OBJECT')"""


@query(f"WITH {_REGISTRY} SELECT registry, tag, count(*) AS n FROM every GROUP BY ALL")
def registry_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of rows of each flat table below the registries, all from one pass; registry_TAG has the rows."""
    from centime.operators.flatten import REGISTRIES, flatten

    tagged = flatten(table(spark, sf_dir, "registry_raw"), **{n: table(spark, sf_dir, n) for n in REGISTRIES})
    return tagged.groupBy("registry", "tag").agg(F.count(F.lit(1)).alias("n"))


METRICS = ("RECETTES", "DEPENSES", "SOLDE")


def _registry_sql(tag: str) -> str:
    """The flat table of a tag in SQL; a map of figures has a column for each metric."""
    keys = ("registry", "record_id", "item_no", "field", "child_no", "parent_tag", "parent_no")
    columns = []
    for name, kind in (part.strip().split(" ", 1) for part in SCHEMAS[tag].replace("string,string", "string").split(",")):
        if kind.startswith("map"):
            columns += [f"""y ->> '$.{name}.{m}' AS {name}_{m.lower()}""" for m in METRICS]
        else:
            columns.append(f"""y ->> '$.{name}' AS "{f'{tag}_{name}' if name in keys else name}\"""")
    return f"WITH {_REGISTRY} SELECT registry, record_id, CAST(item_no AS INTEGER) AS item_no, field, CAST(child_no AS INTEGER) AS child_no, parent_tag, CAST(parent_no AS INTEGER) AS parent_no, {', '.join(columns)} FROM every WHERE tag = '{tag}'"


def _registry_table(tag: str) -> None:
    def flat(spark: SparkSession, sf_dir: str) -> DataFrame:
        from centime.operators.flatten import REGISTRIES, flatten, table_of

        found = table_of(flatten(table(spark, sf_dir, "registry_raw"), tags=(tag,), **{n: table(spark, sf_dir, n) for n in REGISTRIES}), tag)
        maps = [c for c, kind in found.dtypes if kind.startswith("map")]
        return found.select("*", *(F.try_element_at(c, F.lit(m)).alias(f"{c}_{m.lower()}") for c in maps for m in METRICS)).drop(*maps)

    flat.__name__ = f"registry_{tag}"
    flat.__doc__ = f"The flat table of tag {tag} below the registries, with its keys and columns."
    query(_registry_sql(tag))(flat)


for _tag in SCHEMAS:
    _registry_table(_tag)


@query(
    """SELECT seq, CASE WHEN sparse_weights IS NULL OR len(sparse_weights) <> 44 THEN 'size' WHEN len(list_filter(sparse_weights, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0 THEN 'entry' ELSE 'norm' END AS fault FROM passages
WHERE sparse_weights IS NULL OR len(sparse_weights) <> 44 OR len(list_filter(sparse_weights, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0 OR abs(sqrt(list_dot_product(sparse_weights::DOUBLE[], sparse_weights::DOUBLE[])) - 1) > 0.006"""
)
def vector_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights as vectors of 44 entries and unit length, which most are not."""
    from centime.operators.lookup import vector_faults as faults

    return faults(table(spark, sf_dir, "passages"), "seq", "sparse_weights", 44)


@query("SELECT doc_id, source, title FROM documents QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY loaded_at DESC) = 1")
def latest_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    from centime.streaming.ingest import latest

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "title", "loaded_at")
    return latest(docs, ["doc_id"], "loaded_at").select("doc_id", "source", "title")


@query("SELECT event_type, epoch_ms(CAST(epoch_ms(ts) // 3600000 * 3600000 AS BIGINT)) AS hour, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def events_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: event counts in windows, the same function batch or stream."""
    from centime.streaming.ingest import events_by_window

    windows = events_by_window(table(spark, sf_dir, "events"))
    return windows.select("event_type", F.col("window.start").cast("timestamp_ntz").alias("hour"), "n", F.round("value", 4).alias("value"))
