"""Queries of search and of the passages' upkeep, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from centime.functions import scalars
from centime.operators import search, textprep
from centime.session import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


_FOLDED = f"translate(lower(text), '{scalars.MARKED}', '{scalars.PLAIN}')"
_WORDS = f"regexp_extract_all({_FOLDED}, '[a-z0-9]+')"
TERMS = ("solidarite", "budget")
SPARSE = {11: 0.5, 64: 0.25, 309: 1.0, 1716: 2.0, 41: 0.5}
WIDTH = 16


def _dense_query() -> list[float]:
    wide = [0.0] * WIDTH
    for term, weight in SPARSE.items():
        wide[term % WIDTH] += weight
    return wide


_ALLOWED = """c AS (SELECT p.seq, o.asset_sha, o.locator, s.title, s.source_id, TRY_CAST(nullif(regexp_extract(o.locator, 'page:([0-9]+)', 1), '') AS INTEGER) AS page
  FROM (SELECT DISTINCT passage_id, asset_sha, locator FROM occurrences) o JOIN passages p ON p.id = o.passage_id JOIN sources s ON s.sha256 = o.asset_sha WHERE s.family = 'social' AND s.status = 'downloaded'),
allowed AS (SELECT DISTINCT seq FROM c)"""
_COUNTS = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS t{i}" for i, t in enumerate(TERMS))
_SCORE = " + ".join(f"ln(1.0::DOUBLE + (n - d{i} + 0.5::DOUBLE) / (d{i} + 0.5::DOUBLE)) * (t{i} * 2.2::DOUBLE / (t{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / a)))" for i in range(len(TERMS)))
_SPARSE_VALUES = ", ".join(f"({t}, {w}::DOUBLE)" for t, w in SPARSE.items())
_DENSE_VALUES = ", ".join(f"({i}, {w}::DOUBLE)" for i, w in enumerate(_dense_query()))
_HYBRID = f"""{_ALLOWED},
t AS (SELECT seq, len(w) AS l, {_COUNTS} FROM (SELECT seq, {_WORDS} AS w FROM passages)),
tot AS (SELECT count(*) AS n, avg(l) AS a, {", ".join(f"count(*) FILTER (t{i} > 0) AS d{i}" for i in range(len(TERMS)))} FROM t WHERE l > 0),
lx AS (SELECT seq, round({_SCORE}, 6) AS score FROM t, tot WHERE {" AND ".join(f"t{i} > 0" for i in range(len(TERMS)))}),
l AS (SELECT seq, row_number() OVER (ORDER BY score DESC, seq) - 1 AS p FROM lx JOIN allowed USING (seq) QUALIFY p < 240),
e AS (SELECT seq, i, w::DOUBLE AS w FROM (SELECT seq, unnest(sparse_ids) AS i, unnest(sparse_weights) AS w FROM passages) WHERE i IS NOT NULL AND w IS NOT NULL),
dv AS (SELECT seq, i % {WIDTH} AS k, sum(w) AS w FROM e GROUP BY ALL),
dn AS (SELECT seq, round(sum(w * q) / sqrt(sum(w * w)), 6) AS score FROM dv JOIN (VALUES {_DENSE_VALUES}) v(k, q) USING (k) GROUP BY 1 HAVING sum(w * w) > 0),
dk AS (SELECT * FROM dn ORDER BY score DESC, seq LIMIT 4000),
d AS (SELECT seq, row_number() OVER (ORDER BY score DESC, seq) - 1 AS p FROM dk JOIN allowed USING (seq) QUALIFY p < 240),
both_legs AS (SELECT seq FROM l UNION SELECT seq FROM d),
sp AS (SELECT seq, round(sum(w * q), 6) AS score FROM e JOIN (VALUES {_SPARSE_VALUES}) v(i, q) USING (i) JOIN both_legs USING (seq) GROUP BY 1 HAVING sum(w * q) > 0),
s AS (SELECT seq, row_number() OVER (ORDER BY score DESC, seq DESC) - 1 AS p FROM sp),
u AS (SELECT seq, 'text' AS m, 1.0::DOUBLE / (60 + p) AS g FROM l UNION ALL SELECT seq, 'dense', 1.0::DOUBLE / (60 + p) FROM d UNION ALL SELECT seq, 'sparse_rerank', 0.5::DOUBLE / (60 + p) FROM s),
x AS (SELECT seq, round(sum(g), 9) AS score, array_to_string(list_sort(list(DISTINCT m)), '+') AS methods FROM u GROUP BY 1),
f AS (SELECT seq, asset_sha, coalesce(CAST(page AS VARCHAR), locator) AS page_key FROM c QUALIFY row_number() OVER (PARTITION BY seq ORDER BY title NULLS LAST, locator NULLS LAST, source_id, asset_sha) = 1),
h AS (SELECT x.*, asset_sha, page_key FROM x JOIN f USING (seq) QUALIFY row_number() OVER (PARTITION BY asset_sha, page_key ORDER BY score DESC, seq) = 1)"""


def _citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations that pass the document filter: seq, asset_sha, locator, title, source_id, page."""
    sources = table(spark, sf_dir, "sources").where("family = 'social' AND status = 'downloaded'").select("source_id", "title", F.col("sha256").alias("asset_sha"))
    cited = table(spark, sf_dir, "occurrences").select(F.col("passage_id").alias("id"), "asset_sha", "locator").distinct().join(sources, "asset_sha")
    return cited.join(table(spark, sf_dir, "passages").select("seq", "id"), "id").select("seq", "asset_sha", "locator", "title", "source_id", search.page_of(F.col("locator")).alias("page"))


@query(f"WITH {_HYBRID} SELECT seq, score, methods, asset_sha, page_key, CAST(row_number() OVER (ORDER BY score DESC, seq) AS INTEGER) AS place FROM h QUALIFY place <= 20")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three legs over one key, filtered by document before a hit is accepted, one hit a page, the best twenty."""
    passages = table(spark, sf_dir, "passages")
    dense = search.folded_vectors(passages, "seq", "sparse_ids", "sparse_weights", WIDTH)
    return search.hybrid(passages.select("seq", "text"), dense, passages.select("seq", "sparse_ids", "sparse_weights"), _citations(spark, sf_dir), list(TERMS), _dense_query(), SPARSE, 20)


@query(
    f"""WITH {_ALLOWED.replace("WHERE s.family = 'social' AND s.status = 'downloaded'", "")} SELECT p.seq, p.id, p.tokens, p.text_sha256, left(p.text, 1900) AS excerpt, count(c.seq) AS citations FROM passages p LEFT JOIN c USING (seq) WHERE p.id = (SELECT min(passage_id) FROM occurrences) GROUP BY ALL"""
)
def passage_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One passage with its excerpt and the number of its citations; the id is a parameter, read here from the occurrences."""
    ident = table(spark, sf_dir, "occurrences").agg(F.min("passage_id")).first()[0]
    one = table(spark, sf_dir, "passages").where(F.col("id") == F.lit(ident))
    sources = table(spark, sf_dir, "sources").select(F.col("sha256").alias("asset_sha"))
    cited = table(spark, sf_dir, "occurrences").where(F.col("passage_id") == F.lit(ident)).select(F.col("passage_id").alias("id"), "asset_sha", "locator").distinct().join(sources, "asset_sha")
    counted = cited.groupBy("id").agg(F.count(F.lit(1)).alias("citations"))
    return one.join(counted, "id", "left").select("seq", "id", "tokens", "text_sha256", search.excerpt(F.col("text")).alias("excerpt"), F.coalesce("citations", F.lit(0)).alias("citations"))


@query(
    f"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '\\S+') AS w, regexp_extract_all({_FOLDED}, '\\S+') AS v FROM documents WHERE contains({_FOLDED}, 'solidarite')),
h AS (SELECT *, list_position(list_transform(v, lambda x: contains(x, 'solidarite')), true) AS hit FROM t)
SELECT doc_id, array_to_string(w[greatest(hit - 8, 1):greatest(hit - 8, 1) + 33], ' ') AS snippet FROM h WHERE hit > 0"""
)
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """34 words around the first one that has the term."""
    docs = table(spark, sf_dir, "documents").where(scalars.fold("text").contains("solidarite"))
    return docs.select("doc_id", search.snippet(F.col("text"), "solidarite").alias("snippet")).where("snippet IS NOT NULL")


GROUPS = (("fonds", "caisse", "regime"), ("deficit", "solde"))


@query(
    "SELECT doc_id FROM (SELECT doc_id, " + _WORDS + " AS w FROM documents) WHERE " + " AND ".join(f"list_has_any(w, {list(g)})" for g in GROUPS)
)
def expanded_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with at least one word of each group of synonyms."""
    return table(spark, sf_dir, "documents").where(search.one_of_each(F.col("text"), GROUPS)).select("doc_id")


@query("SELECT i AS token, round(max(w::DOUBLE), 6) AS weight, count(*) AS n FROM (SELECT unnest(sparse_ids) AS i, unnest(sparse_weights) AS w FROM passages) WHERE i IS NOT NULL GROUP BY 1")
def sparse_max_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest weight of each token, combined before the shuffle."""
    entries = table(spark, sf_dir, "passages").select(F.explode(F.arrays_zip("sparse_ids", "sparse_weights")).alias("e")).where("e.sparse_ids IS NOT NULL")
    return entries.groupBy(F.col("e.sparse_ids").alias("token")).agg(F.round(F.max(F.col("e.sparse_weights").cast("double")), 6).alias("weight"), F.count(F.lit(1)).alias("n"))


@query(
    """SELECT seq, CASE WHEN sparse_ids IS NULL OR sparse_weights IS NULL THEN 'null' WHEN len(sparse_ids) <> len(sparse_weights) THEN 'size' WHEN len(sparse_ids) = 0 THEN 'empty'
  WHEN len(list_filter(sparse_weights, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0 THEN 'entry' WHEN len(list_distinct(sparse_ids)) < len(sparse_ids) THEN 'repeated'
  WHEN len(list_filter(sparse_weights, lambda x: x <= 0)) > 0 THEN 'weight' WHEN list_sort(sparse_ids) <> sparse_ids THEN 'order' END AS fault FROM passages"""
)
def sparse_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fault of each sparse vector; null where there is none."""
    return table(spark, sf_dir, "passages").select("seq", search.sparse_fault(F.col("sparse_ids"), F.col("sparse_weights")).alias("fault"))


SEGMENTS = "array<struct<block:int,char_start:int,char_end:int,text:string>>"
_SEGMENTS = """o AS (SELECT DISTINCT id, chunk_json AS j FROM occurrences WHERE json_valid(chunk_json) AND json_type(chunk_json, '$.segments') = 'ARRAY'),
s AS (SELECT id, md5(j) AS v, TRY_CAST(x->>'$.block' AS INTEGER) AS block, TRY_CAST(x->>'$.char_start' AS INTEGER) AS b, TRY_CAST(x->>'$.char_end' AS INTEGER) AS e, x->>'$.text' AS t FROM (SELECT id, j, unnest(CAST(j->'$.segments' AS JSON[])) AS x FROM o))"""


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "occurrences").select("id", "chunk_json").distinct()
    read = chunks.select("id", F.md5("chunk_json").alias("v"), F.explode(F.from_json("chunk_json", f"struct<segments:{SEGMENTS}>").segments).alias("s"))
    return read.select("id", "v", "s.block", F.col("s.char_start").alias("b"), F.col("s.char_end").alias("e"), F.col("s.text").alias("t"))


@query(
    f"""WITH {_SEGMENTS}, p AS (SELECT *, coalesce(lag(e) OVER w, 0) AS expected, lag(t) OVER w AS before FROM s WHERE block IS NOT NULL AND b IS NOT NULL AND e IS NOT NULL AND t IS NOT NULL WINDOW w AS (PARTITION BY id, v, block ORDER BY b, e, t))
SELECT id, v AS version, block, sha256(string_agg(t, '' ORDER BY b, e, t)) AS digest, count(*) AS segments, bool_or(b <> expected) AS moved, bool_or(e - b <> length(t)) AS wrong_length,
  bool_or(coalesce(before <> '' AND t <> '' AND NOT regexp_matches(right(before, 1), '\\s') AND NOT regexp_matches(left(t, 1), '\\s'), false)) AS word_split FROM p GROUP BY ALL"""
)
def recovered_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each block put together again from its segments, and what is wrong with their places."""
    held = _segments(spark, sf_dir).where("block IS NOT NULL AND b IS NOT NULL AND e IS NOT NULL AND t IS NOT NULL")
    return textprep.recover(held, ["id", "v", "block"], "b", "e", "t").withColumnRenamed("v", "version")


@query(
    """WITH o AS (SELECT DISTINCT id, chunk_json AS j FROM occurrences WHERE json_valid(chunk_json) AND json_type(chunk_json) = 'OBJECT'),
c AS (SELECT id, CASE WHEN json_type(j, '$.text') = 'VARCHAR' THEN j->>'$.text' END AS t, CASE WHEN json_type(j, '$.body') = 'VARCHAR' THEN j->>'$.body' END AS b, TRY_CAST(j->>'$.tokens' AS INTEGER) AS n FROM o)
SELECT CASE WHEN t IS NULL THEN 'no_text' WHEN b IS NULL THEN 'no_body' WHEN NOT contains(t, b) THEN 'body_changed' WHEN n IS NULL THEN 'no_tokens'
  WHEN n <> len(regexp_extract_all(t, '[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}\\p{Z}\\p{C}\\p{M}]')) THEN 'stale_tokens' ELSE 'kept' END AS reason, count(*) AS n FROM c GROUP BY 1"""
)
def conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether chunks keep their body and their number of tokens, by the first reason why not."""
    chunks = table(spark, sf_dir, "occurrences").select("id", "chunk_json").distinct()
    read = chunks.select(F.try_parse_json("chunk_json").alias("j")).where("j IS NOT NULL AND schema_of_variant(j) LIKE 'OBJECT%'")

    def member(name: str) -> F.Column:
        held = F.try_variant_get("j", f"$.{name}", "variant")
        return F.when(F.schema_of_variant(held) == "STRING", F.try_variant_get("j", f"$.{name}", "string"))

    parts = read.select(member("text").alias("t"), member("body").alias("b"), F.try_variant_get("j", "$.tokens", "string").try_cast("int").alias("n"))
    tokens = F.regexp_count("t", F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\p{Z}\p{C}\p{M}]"))
    reason = (
        F.when(F.col("t").isNull(), "no_text").when(F.col("b").isNull(), "no_body").when(~F.contains("t", "b"), "body_changed").when(F.col("n").isNull(), "no_tokens")
        .when(F.col("n") != tokens, "stale_tokens").otherwise("kept")
    )
    return parts.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT id, CASE WHEN passage_id IS NULL THEN 'no_passage' WHEN passage_id NOT IN (SELECT id FROM passages) THEN 'unknown_passage' ELSE 'unknown_asset' END AS fault FROM occurrences
WHERE passage_id IS NULL OR passage_id NOT IN (SELECT id FROM passages) OR asset_sha IS NULL OR asset_sha NOT IN (SELECT sha256 FROM sources)"""
)
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences without a passage or an asset."""
    known = table(spark, sf_dir, "passages").select(F.col("id").alias("passage_id"), F.lit(True).alias("_p")).distinct()
    assets = table(spark, sf_dir, "sources").select(F.col("sha256").alias("asset_sha"), F.lit(True).alias("_a")).distinct()
    met = table(spark, sf_dir, "occurrences").select("id", "passage_id", "asset_sha").join(known, "passage_id", "left").join(assets, "asset_sha", "left")
    fault = F.when(F.col("passage_id").isNull(), "no_passage").when(F.col("_p").isNull(), "unknown_passage").when(F.col("_a").isNull(), "unknown_asset")
    return met.select("id", fault.alias("fault")).where("fault IS NOT NULL")


@query(
    """SELECT DISTINCT o.asset_sha, o.locator, CASE WHEN s.sha256 IS NULL THEN 'unknown' WHEN coalesce(s.status, '') <> 'downloaded' THEN 'not_downloaded' WHEN s.path IS NULL OR s.path LIKE '%..%' OR NOT starts_with(s.path, 'documents/') THEN 'outside' ELSE 'local' END AS availability
FROM occurrences o LEFT JOIN sources s ON s.sha256 = o.asset_sha"""
)
def citation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the file of a citation may be shown: downloaded, and its path inside the folder of documents."""
    sources = table(spark, sf_dir, "sources").select(F.col("sha256").alias("asset_sha"), "status", "path", F.lit(True).alias("known"))
    met = table(spark, sf_dir, "occurrences").select("asset_sha", "locator").distinct().join(sources, "asset_sha", "left")
    outside = F.col("path").isNull() | F.col("path").contains("..") | ~F.col("path").startswith("documents/")
    kind = F.when(F.col("known").isNull(), "unknown").when(F.coalesce("status", F.lit("")) != "downloaded", "not_downloaded").when(outside, "outside").otherwise("local")
    return met.select("asset_sha", "locator", kind.alias("availability")).distinct()


@query(
    """WITH u AS (SELECT 'base' AS collection, 0 AS r, text_sha256, seq FROM passages WHERE tokens IS NOT NULL UNION ALL SELECT 'supplement', 1, text_sha256, seq FROM passages WHERE tokens IS NULL
UNION ALL SELECT 'supplement', 1, text_sha256, seq FROM passages WHERE sparse_ids IS NULL)
SELECT text_sha256, seq, collection FROM u QUALIFY row_number() OVER (PARTITION BY text_sha256 ORDER BY r, seq) = 1"""
)
def federated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of a base and a supplement as one collection: the base's where both have a text."""
    passages = table(spark, sf_dir, "passages")
    parts = {"base": passages.where("tokens IS NOT NULL"), "supplement": passages.where("tokens IS NULL").unionByName(passages.where("sparse_ids IS NULL"))}
    return search.federate({name: df.select("text_sha256", "seq") for name, df in parts.items()}, "text_sha256", "seq")


@query(
    """SELECT seq, id = sha256('public' || chr(10) || text) AS id_holds, text_sha256 = sha256(text) AS hash_holds, TRY_CAST(tokens AS BIGINT) = len(regexp_extract_all(text, '[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}\\p{Z}\\p{C}\\p{M}]')) AS tokens_hold FROM passages"""
)
def passage_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a passage's id, hash and number of tokens are those of its text."""
    tokens = F.regexp_count("text", F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\p{Z}\p{C}\p{M}]"))
    return table(spark, sf_dir, "passages").select(
        "seq", (F.col("id") == F.sha2(F.concat(F.lit("public\n"), F.col("text")), 256)).alias("id_holds"), (F.col("text_sha256") == F.sha2("text", 256)).alias("hash_holds"), (F.col("tokens") == tokens).alias("tokens_hold")
    )


@query("SELECT doc_id, coalesce(years = [2024], false) AS only_2024, coalesce(list_contains(years, 2024), false) AS with_2024 FROM documents WHERE contains(regexp_replace(lower(strip_accents(coalesce(title, '') || ' ' || coalesce(source, ''))), '[^a-z0-9]', '', 'g'), 'soinscourants')")
def haystack_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose title and source, normalised, have a needle; whether they are of exactly one year, or of that year among others."""
    haystack = scalars.norm(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("source", F.lit(""))))
    only, among = F.col("years") == F.array(F.lit(2024)), F.array_contains("years", 2024)
    return table(spark, sf_dir, "documents").where(haystack.contains("soinscourants")).select("doc_id", F.coalesce(only, F.lit(False)).alias("only_2024"), F.coalesce(among, F.lit(False)).alias("with_2024"))


@query("SELECT doc_id, CAST(row_number() OVER (ORDER BY list_max(years) DESC NULLS LAST, title NULLS LAST, doc_id) AS INTEGER) AS place FROM documents WHERE doc_format = 'pdf' QUALIFY place <= 100")
def document_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred documents of one format by latest year and title; filters that are not set are not applied."""
    wanted = search.optional(table(spark, sf_dir, "documents"), doc_format="pdf", lang="", stage=None)
    order = [F.array_max("years").desc_nulls_last(), F.asc_nulls_last("title"), F.asc("doc_id")]
    return search.first_rows(wanted.select("doc_id", "years", "title"), order, 100).select("doc_id", "place")


@query(
    """WITH r AS (SELECT source_id, table_index, row_index, column_index, id, row_label, context, CASE WHEN context IS DISTINCT FROM lag(context) OVER w THEN 1 ELSE 0 END AS new FROM pdf_facts WINDOW w AS (PARTITION BY source_id, table_index ORDER BY row_index NULLS LAST, column_index NULLS LAST, id)),
g AS (SELECT *, sum(new) OVER (PARTITION BY source_id, table_index ORDER BY row_index NULLS LAST, column_index NULLS LAST, id) AS run FROM r)
SELECT id, last_value(row_label IGNORE NULLS) OVER (PARTITION BY source_id, table_index, run ORDER BY row_index NULLS LAST, column_index NULLS LAST, id) AS label FROM g"""
)
def filled_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels carried down a table's rows, until another heading begins."""
    from centime.operators.lookup import forward_fill

    facts = table(spark, sf_dir, "pdf_facts").select("id", "source_id", "table_index", "row_index", "column_index", "row_label", "context")
    order = [F.asc_nulls_last("row_index"), F.asc_nulls_last("column_index"), F.asc("id")]
    return forward_fill(facts, ["source_id", "table_index"], order, {"row_label": "label"}, changes="context").select("id", "label")


@query(
    """WITH c AS (SELECT source_id, title, sha256, count(*) AS n, bool_or(status = 'downloaded') AS there FROM sources GROUP BY ALL)
SELECT md5(coalesce(category, '~') || '|' || coalesce(analysis_status, '~') || '|' || coalesce(explanation, '~') || '|' || coalesce(source_sha, '~') || '|' || array_to_string(list_transform(coalesce(notice_key, []), lambda x: coalesce(x, '~')), '/')) AS digest,
  min(record_id) AS record_id, count(*) AS copies FROM source_reconciliation GROUP BY 1"""
)
def distinct_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices by their canonical form, whatever record they came in."""
    key = F.array_join(F.transform(F.coalesce("notice_key", F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("~"))), "/")
    text = F.concat_ws("|", *(F.coalesce(c, F.lit("~")) for c in ("category", "analysis_status", "explanation", "source_sha")), key)
    return table(spark, sf_dir, "source_reconciliation").groupBy(F.md5(text).alias("digest")).agg(F.min("record_id").alias("record_id"), F.count(F.lit(1)).alias("copies"))
