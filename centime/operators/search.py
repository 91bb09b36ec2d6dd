"""Search over passages: lexical BM25, dense and sparse similarity, fusion of ranked lists, citations."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from centime.functions.scalars import fold
from centime.session import durable, on_all_cores

K1, B = 1.2, 0.75
#: Places of a ranked list that count, and the constant of reciprocal-rank fusion.
DEPTH, FUSION = 240, 60
# Words a query does not search for.
STOP_WORDS = ("le", "la", "les", "de", "des", "du", "un", "une", "et", "en", "au", "aux", "pour", "par", "sur", "dans", "the", "of", "and")


def query_terms(query: str, most: int = 24) -> list[str]:
    """Folded words of a query, stop words left out, each once, in order."""
    import unicodedata

    plain = "".join(c for c in unicodedata.normalize("NFD", query.lower()) if unicodedata.category(c) != "Mn")
    return list(dict.fromkeys(w for w in re.findall(r"[^\W_]+", plain) if w not in STOP_WORDS))[:most]


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(fold(text), F.lit("([a-z0-9]+)"), 1)


def bm25(docs: DataFrame, key: str, text: str, terms: list[str], every: bool = True) -> DataFrame:
    """(key, score) of documents with the terms (all of them, or any).

    Texts are read once: length and counts of each document, a few bytes, are
    written and serve the statistics and the scores. Terms are folded words.
    """
    folded = fold(F.col(text))
    counts = [F.regexp_count(folded, F.lit(f"(?<![a-z0-9]){t}(?![a-z0-9])")).alias(f"_t{i}") for i, t in enumerate(terms)]
    held = on_all_cores(docs.select(key, text).where(F.col(text).isNotNull()))
    counted = durable(held.select(key, F.regexp_count(folded, F.lit("[a-z0-9]+")).alias("_length"), *counts), "counts")
    totals = counted.where("_length > 0").agg(
        F.count(F.lit(1)).alias("_n"), F.avg("_length").alias("_avg"), *(F.count(F.when(F.col(f"_t{i}") > 0, 1)).alias(f"_d{i}") for i in range(len(terms)))
    )
    hit = [F.col(f"_t{i}") > 0 for i in range(len(terms))]
    wanted = hit[0]
    for h in hit[1:]:
        wanted = wanted & h if every else wanted | h
    score = F.lit(0.0)
    for i in range(len(terms)):
        rarity = F.log(F.lit(1.0) + (F.col("_n") - F.col(f"_d{i}") + 0.5) / (F.col(f"_d{i}") + 0.5))
        saturated = F.col(f"_t{i}") * (K1 + 1) / (F.col(f"_t{i}") + K1 * (1 - B + B * F.col("_length") / F.col("_avg")))
        score = score + rarity * saturated
    return counted.where(wanted).join(F.broadcast(totals)).select(key, F.round(score, 6).alias("score"))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dense_topk(vectors: DataFrame, key: str, vector: str, query: list[float], k: int) -> DataFrame:
    """(key, score): the k vectors of largest cosine to one query vector, exactly; ties go to the smaller key."""
    q = F.array(*(F.lit(float(x)) for x in query))
    norm = F.sqrt(dot(F.col(vector), F.col(vector))) * F.sqrt(dot(q, q))
    return vectors.select(key, F.round(dot(F.col(vector), q) / norm, 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


def sparse_scores(passages: DataFrame, key: str, ids: str, weights: str, query: dict[int, float]) -> DataFrame:
    """(key, score) of passages with a positive inner product with a sparse query (a few terms, a parameter)."""
    q = F.create_map(*(x for t, w in query.items() for x in (F.lit(int(t)), F.lit(float(w)))))
    product = F.zip_with(ids, weights, lambda i, w: F.coalesce(F.try_element_at(q, i), F.lit(0.0)) * w.cast("double"))
    score = F.aggregate(product, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    return passages.where(F.arrays_overlap(ids, F.array(*(F.lit(int(t)) for t in query)))).select(key, score.alias("score")).where("score > 0")


def ranked(scores: DataFrame, key: str, depth: int = DEPTH) -> DataFrame:
    """(key, place from 0) of the best `depth` rows by score, then key. The limit comes first, so the window is small."""
    best = scores.orderBy(F.desc("score"), key).limit(depth)
    return best.select(key, (F.row_number().over(Window.orderBy(F.desc("score"), key)) - 1).alias("place"))


def fuse(key: str, **lists: tuple[DataFrame, float]) -> DataFrame:
    """(key, score, methods): reciprocal-rank fusion of ranked lists with their weights."""
    parts = [df.select(key, F.lit(name).alias("method"), (F.lit(weight) / (F.col("place") + FUSION)).alias("gain")) for name, (df, weight) in lists.items()]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.groupBy(key).agg(F.round(F.sum("gain"), 9).alias("score"), F.array_join(F.array_sort(F.collect_set("method")), "+").alias("methods"))


def limit_per_group(df: DataFrame, by: list[str], order: list[Column], n: int, place: str = "place") -> DataFrame:
    """The first n rows of each group; the limit is pushed below the shuffle by the window group limit."""
    return df.withColumn(place, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(place) <= n)


def excerpt(text: Column, length: int = 1900) -> Column:
    return F.substring(text, 1, length)


def page_of(locator: Column) -> Column:
    """The page a locator names; null without one."""
    return F.regexp_extract(locator, r"page:([0-9]+)", 1).try_cast("int")


def first_rows(rows: DataFrame, order: list[Column], n: int, place: str = "place") -> DataFrame:
    """The first n rows in an order, with their places from 1 and whether rows are left out. The limit comes before the numbering."""
    best = rows.orderBy(*order).limit(n + 1)
    placed = best.withColumn(place, F.row_number().over(Window.orderBy(*order)))
    more = F.max(place).over(Window.partitionBy()) > n
    return placed.withColumn("truncated", more).where(F.col(place) <= n)


def optional(df: DataFrame, **wanted: object) -> DataFrame:
    """df filtered by equality on the columns whose wanted value is set; null and the empty text set none."""
    for column, value in wanted.items():
        if value is not None and value != "":
            df = df.where(F.col(column) == F.lit(value))
    return df


def one_of_each(text: Column, groups: tuple[tuple[str, ...], ...]) -> Column:
    """Whether a text has at least one word of each group; words folded as in tokens()."""
    words = tokens(text)
    wanted = F.lit(True)
    for group in groups:
        wanted = wanted & F.arrays_overlap(words, F.array(*(F.lit(w) for w in group)))
    return wanted


def snippet(text: Column, term: str, words: int = 34, before: int = 8) -> Column:
    """`words` words of a text, from `before` ahead of the first one that has the folded term; null without a hit."""
    split = F.regexp_extract_all(text, F.lit(r"(\S+)"), 1)
    at = F.array_position(F.transform(F.regexp_extract_all(fold(text), F.lit(r"(\S+)"), 1), lambda w: w.contains(term)), True)
    return F.when(at > 0, F.array_join(F.slice(split, F.greatest(at - before, F.lit(1)).cast("int"), words), " "))


def sparse_fault(ids: Column, weights: Column) -> Column:
    """The first fault of a sparse vector: null, size, empty, entry, repeated, weight, order; null when it has none."""
    bad = F.exists(weights, lambda w: w.isNull() | F.isnan(w) | (F.abs(w) == float("inf")))
    return (
        F.when(ids.isNull() | weights.isNull(), "null").when(F.size(ids) != F.size(weights), "size").when(F.size(ids) == 0, "empty").when(bad, "entry")
        .when(F.size(F.array_distinct(ids)) < F.size(ids), "repeated").when(F.exists(weights, lambda w: w <= 0), "weight").when(F.sort_array(ids) != ids, "order")
    )


def folded_vectors(passages: DataFrame, key: str, ids: str, weights: str, width: int) -> DataFrame:
    """(key, vector): sparse vectors folded into `width` dimensions, a dense stand-in where no encoder is at hand; without entries no row."""
    entries = passages.select(key, F.explode(F.arrays_zip(F.col(ids).alias("i"), F.col(weights).alias("w"))).alias("e")).where("e.i IS NOT NULL AND e.w IS NOT NULL")
    at = F.pmod(F.col("e.i"), F.lit(width))
    sums = [F.coalesce(F.sum(F.when(at == i, F.col("e.w").cast("double"))), F.lit(0.0)).alias(f"_{i}") for i in range(width)]
    vectors = entries.groupBy(key).agg(*sums).select(key, F.array(*(f"_{i}" for i in range(width))).alias("vector"))
    return vectors.where(F.exists("vector", lambda x: x != 0))


def first_per_page(hits: DataFrame, citations: DataFrame, key: str) -> DataFrame:
    """hits with the page of their first citation (by title, locator, source), and of each page only the best hit; hits without a citation go."""
    order = [F.asc_nulls_last("title"), F.asc_nulls_last("locator"), F.asc("source_id"), F.asc("asset_sha")]
    first = citations.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1")
    first = first.select(key, "asset_sha", F.coalesce(F.col("page").cast("string"), "locator").alias("page_key"))
    met = hits.join(first, key)
    return met.withColumn("_n", F.row_number().over(Window.partitionBy("asset_sha", "page_key").orderBy(F.desc("score"), key))).where("_n = 1").drop("_n")


def hybrid(texts: DataFrame, dense: DataFrame, sparse: DataFrame, citations: DataFrame, terms: list[str], vector: list[float], weights: dict[int, float], limit: int, key: str = "seq") -> DataFrame:
    """(key, score, methods, asset_sha, page_key, place): lexical, dense and sparse legs over one key, fused.

    citations are those that pass the filters: a hit counts only if it has one, and
    places are given after that, so that filtered-out hits take none. The dense leg
    looks at its best 4,000 before the filter. The sparse leg ranks the candidates
    of the other two with a positive product, at half weight. Of a page only the
    best hit is kept. Order: score, then key.
    """
    allowed = citations.select(key).distinct()
    allowed = durable(allowed, "allowed")
    lexical = durable(ranked(bm25(texts, key, "text", terms).join(allowed, key, "left_semi"), key), "lexical")
    near = durable(ranked(dense_topk(dense, key, "vector", vector, 4000).join(allowed, key, "left_semi"), key), "near")
    candidates = lexical.select(key).unionByName(near.select(key)).distinct()
    products = sparse_scores(sparse.join(candidates, key, "left_semi"), key, "sparse_ids", "sparse_weights", weights).withColumn("score", F.round("score", 6))
    reranked = products.select(key, (F.row_number().over(Window.orderBy(F.desc("score"), F.desc(key))) - 1).alias("place"))
    hits = first_per_page(fuse(key, text=(lexical, 1.0), dense=(near, 1.0), sparse_rerank=(reranked, 0.5)), citations, key)
    best = hits.orderBy(F.desc("score"), key).limit(limit)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), key)))


def federate(collections: dict[str, DataFrame], key: str, place: str) -> DataFrame:
    """Rows of several collections with the collection's name: of each key the one of the first collection that has it, there the least place."""
    whole = None
    for rank, (name, df) in enumerate(collections.items()):
        part = df.withColumn("_rank", F.lit(rank)).withColumn("collection", F.lit(name))
        whole = part if whole is None else whole.unionByName(part)
    best = whole.groupBy(key).agg(F.min(F.struct("_rank", place, "collection")).alias("_best"))
    return best.select(key, f"_best.{place}", "_best.collection")
