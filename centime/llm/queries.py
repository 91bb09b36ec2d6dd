"""Queries of this subpackage, registered by the driver's entry module if it is there."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from centime.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from centime.llm.neighbours import similar_pairs

    return similar_pairs(table(spark, sf_dir, "passages"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from centime.llm.signatures import duplicate_pairs

    return duplicate_pairs(table(spark, sf_dir, "passages"), table(spark, sf_dir, "occurrences"))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage that has a near-duplicate, with its group."""
    from centime.llm.signatures import near_duplicates, referred

    return near_duplicates(referred(table(spark, sf_dir, "passages"), table(spark, sf_dir, "occurrences")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from centime.llm.lookalikes import same_look

    return same_look(table(spark, sf_dir, "pdf_facts"))


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell that looks like another string of its table, with its class: one row a cell, however many look alike."""
    from centime.llm.lookalikes import look_classes

    return look_classes(table(spark, sf_dir, "pdf_facts"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from centime.llm.splitting import oversized

    return oversized(table(spark, sf_dir, "passages"), table(spark, sf_dir, "occurrences"))


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every text of passages and of occurrences' JSON, those within the limit included."""
    from centime.llm.splitting import pieces

    return pieces(table(spark, sf_dir, "passages"), table(spark, sf_dir, "occurrences"))


def p6_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all pieces: texts and characters covered, pieces over the limit, overlaps over theirs, and gaps between consecutive pieces."""
    from pyspark.sql import Window

    from centime.llm.splitting import pieces

    found = pieces(table(spark, sf_dir, "passages"), table(spark, sf_dir, "occurrences"))
    before = F.lag("char_end").over(Window.partitionBy("item", "id", "pieces").orderBy("piece"))
    tokens = F.regexp_count("text", F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\p{Z}\p{C}\p{M}]"))
    marked = found.withColumn("apart", F.coalesce(F.col("char_begin") > before, F.col("char_begin") > 0)).withColumn("tokens_in", tokens)
    last = F.col("piece") == F.col("pieces") - 1
    return marked.groupBy("item").agg(
        F.count(F.when(last, 1)).alias("texts"), F.sum(F.when(last, F.col("char_end").cast("bigint"))).alias("characters"), F.count(F.when(F.col("tokens_in") > 800, 1)).alias("over"),
        F.count(F.when(F.col("overlap") > 150, 1)).alias("shared"), F.count(F.when(F.col("apart"), 1)).alias("gaps"),
    )


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from centime.llm.bpe import encode_texts

    return encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from centime.llm.fmindex import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans to remove: maximal runs of words that a document shares with an item."""
    from centime.llm.fmindex import leaked_spans

    return leaked_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from centime.llm.quality import no_prose

    return no_prose(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words"), table(spark, sf_dir, "doc_labels"))


def p9_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics, posterior and type of every document."""
    from centime.llm.quality import text_types

    return text_types(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words"), table(spark, sf_dir, "doc_labels"))


def p7_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again: (doc_id, characters, digest)."""
    from centime.llm.bpe import decode_texts, encode_texts

    back = decode_texts(encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id", "ids")
    return back.select("doc_id", F.length("text").cast("bigint").alias("characters"), F.sha2("text", 256).alias("digest"))


def p9_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word count, mean word length, symbol ratio, share of lines ending in punctuation and share of common words of every document."""
    from centime.llm.quality import text_statistics

    found = text_statistics(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words"))
    return found.select("doc_id", "words", *(F.round(c, 6).alias(c) for c in ("mean_word_length", "symbol_ratio", "line_end_share", "common_share")))


def p9_accuracies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the labelling functions were found to be worth."""
    from centime.llm.quality import voter_accuracies

    return voter_accuracies(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words"), table(spark, sf_dir, "doc_labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p2_found, p2_groups, p5_found, p5_classes, p6_found, p6_pieces, p6_checks, p7_ids, p7_texts, p8_found, p8_spans, p9_found, p9_statistics, p9_measures, p9_accuracies)}


_WORDS = r"regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+')"
_COUNT = r"len(regexp_extract_all({}, '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}\p{{Z}}\p{{C}}\p{{M}}]'))"

_P2 = f"""WITH RECURSIVE p AS (SELECT seq, {_WORDS} AS w FROM passages WHERE text IS NOT NULL AND id IN (SELECT passage_id FROM occurrences)),
t AS (SELECT DISTINCT seq, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT seq, w, unnest(range(1, len(w) - 1)) AS i FROM p)),
n AS (SELECT seq, count(*) AS n FROM t GROUP BY 1),
c AS (SELECT a.seq AS x, b.seq AS y, count(*) AS k FROM t a JOIN t b ON a.s = b.s AND a.seq < b.seq GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n u ON u.seq = x JOIN n v ON v.seq = y WHERE k >= 0.6 * (u.n + v.n - k) - 1e-9),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT x AS node, x AS other FROM e UNION SELECT r.node, e.y FROM r JOIN e ON r.other = e.x)"""

_P6 = f"""SELECT DISTINCT item, id FROM (SELECT 'passage' AS item, id, text FROM passages UNION ALL
SELECT 'chunk', id, CASE WHEN json_valid(chunk_json) THEN CASE WHEN json_type(chunk_json, '$.text') = 'VARCHAR' THEN json_extract_string(chunk_json, '$.text') END END FROM occurrences)
WHERE text IS NOT NULL AND {_COUNT.format("text")} > 800"""

_P6_CHECKS = """SELECT item, count(*) AS texts, CAST(sum(length(text)) AS BIGINT) AS characters, 0::BIGINT AS over, 0::BIGINT AS shared, 0::BIGINT AS gaps FROM (SELECT 'passage' AS item, text FROM passages UNION ALL
SELECT 'chunk', CASE WHEN json_valid(chunk_json) THEN CASE WHEN json_type(chunk_json, '$.text') = 'VARCHAR' THEN json_extract_string(chunk_json, '$.text') END END FROM occurrences) WHERE text <> '' GROUP BY 1"""

_P8 = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL), e AS (SELECT item_id, {_WORDS} AS w FROM eval_items WHERE text IS NOT NULL),
a AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 14], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 13)) AS i FROM d)),
b AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 14], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 13)) AS i FROM e))
SELECT DISTINCT doc_id, item_id FROM a JOIN b USING (s)"""


_P8_SPANS = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL), e AS (SELECT item_id, {_WORDS} AS w FROM eval_items WHERE text IS NOT NULL),
a AS (SELECT doc_id, i, array_to_string(w[i:i + 14], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 13)) AS i FROM d)),
b AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 14], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 13)) AS i FROM e)),
h AS (SELECT doc_id, item_id, i - 1 AS p FROM a JOIN b USING (s)),
g AS (SELECT *, sum(CASE WHEN p <= before + 15 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, item_id ORDER BY p) AS span FROM (SELECT *, lag(p) OVER (PARTITION BY doc_id, item_id ORDER BY p) AS before FROM h))
SELECT doc_id, item_id, CAST(min(p) AS INTEGER) AS word_begin, CAST(max(p) + 15 AS INTEGER) AS word_end FROM g GROUP BY doc_id, item_id, span"""

_P7_TEXTS = "SELECT doc_id, CAST(length(coalesce(text, '')) AS BIGINT) AS characters, sha256(coalesce(text, '')) AS digest FROM documents"

# marks of ordinary prose are no symbols; lines are parted by line ends and those that show nothing do not count
_P9_MEASURES = r"""WITH c AS (SELECT list(DISTINCT strip_accents(lower(word))) AS common FROM common_words WHERE word IS NOT NULL),
d AS (SELECT doc_id, coalesce(nfc_normalize(text), '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(strip_accents(lower(t)), '[\p{L}\p{N}]+') AS words, length(regexp_replace(t, '[^\p{L}\p{N}]', '', 'g')) AS inside,
  length(regexp_replace(t, '[\s\p{Z}\p{M}\p{Cc}\p{Cf}]', '', 'g')) AS visible,
  length(regexp_replace(t, '[\s\p{Z}\p{M}\p{Cc}\p{Cf}\p{L}\p{N}.,;:!?\x27’"«»“”()–—…%€°/&-]', '', 'g')) AS symbols,
  list_filter(list_transform(regexp_split_to_array(t, '[\n\r\x{85}\x{2028}\x{2029}]'), lambda l: regexp_replace(l, '[\s\p{Z}\p{M}\p{Cc}\p{Cf}]', '', 'g')), lambda l: l <> '') AS lines FROM d)
SELECT doc_id, CAST(len(words) AS BIGINT) AS words, CASE WHEN len(words) > 0 THEN round(inside / len(words), 6) ELSE 0 END AS mean_word_length,
  CASE WHEN visible > 0 THEN round(symbols / visible, 6) ELSE 0 END AS symbol_ratio,
  CASE WHEN len(lines) > 0 THEN round(len(list_filter(lines, lambda l: contains('.!?;:…»”")', right(l, 1)))) / len(lines), 6) ELSE 0 END AS line_end_share,
  CASE WHEN len(words) > 0 THEN round(len(list_filter(words, lambda x: list_contains(common, x))) / len(words), 6) ELSE 0 END AS common_share FROM w, c"""


def _p5(pairs: bool) -> str:
    """Cells of one look by folding every code point of the first plane to its plain form."""
    from centime.functions.lookalike import fold_shape

    plain = {chr(c): fold_shape(chr(c)) for c in range(0xA0, 0x10000) if not 0xD800 <= c < 0xF900}
    plain = {c: f for c, f in plain.items() if f != unicodedata.normalize("NFC", c)}
    single, gone = {c: f for c, f in plain.items() if len(f) == 1}, [c for c, f in plain.items() if not f]
    source, target = ("".join(x).replace("'", "''") for x in (single, single.values()))
    text = f"translate(nfc_normalize(text), '{source}{''.join(gone)}', '{target}')"
    for c, f in plain.items():
        if len(f) > 1:
            text = f"replace({text}, '{c}', '{f}')" if unicodedata.category(c) in ("Ll", "Lu") and "LATIN" in unicodedata.name(c, "") else text
    cells = f"""WITH f AS (SELECT 'raw' AS field, id, source_id, table_index, raw AS text FROM pdf_facts UNION ALL SELECT 'row_label', id, source_id, table_index, row_label FROM pdf_facts),
c AS (SELECT DISTINCT *, nfc_normalize(replace({text}, chr(9), ' ')) AS form FROM f WHERE text IS NOT NULL AND source_id IS NOT NULL AND table_index IS NOT NULL AND id IS NOT NULL)"""
    if pairs:
        return f"{cells} SELECT DISTINCT a.field AS field, a.id AS id_a, b.id AS id_b FROM c a JOIN c b ON a.field = b.field AND a.source_id = b.source_id AND a.table_index = b.table_index AND a.form = b.form AND a.text <> b.text AND a.id < b.id"
    return f"""{cells}, g AS (SELECT field, source_id, table_index, form, min(id) AS class FROM c GROUP BY ALL HAVING count(DISTINCT text) > 1) SELECT DISTINCT field, id, class FROM c JOIN g USING (field, source_id, table_index, form)"""


def oracle_sql() -> dict[str, str]:
    """SQL where SQL can say it; the others are tested against brute force and public libraries in tests/llm."""
    return {
        "p5_found": _p5(pairs=True),
        "p5_classes": _p5(pairs=False),
        "p2_found": f"{_P2} SELECT DISTINCT node AS seq_a, other AS seq_b FROM r WHERE node < other",
        "p2_groups": f'{_P2} SELECT node AS seq, min(other) AS "group" FROM r GROUP BY 1',
        "p6_found": _P6,
        "p6_checks": _P6_CHECKS,
        "p8_found": _P8,
        "p8_spans": _P8_SPANS,
        "p7_texts": _P7_TEXTS,
        "p9_measures": _P9_MEASURES,
    }
