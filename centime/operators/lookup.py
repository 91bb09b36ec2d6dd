"""Small rules of assembling tables: aliases, strict sums, labels, gaps, partitions, vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_filled(df: DataFrame, *names: str) -> Column:
    """The first of the columns that exist whose text is not blank; null without any."""
    held = [F.when(F.trim(F.col(n).cast("string")) != "", F.col(n).cast("string")) for n in names if n in df.columns]
    return F.coalesce(*held) if held else F.lit(None).cast("string")


def strict_sum(*columns: str) -> Column:
    """Sum of columns; null as soon as one is null."""
    return reduce(lambda a, b: a + b, (F.col(c) for c in columns))


def nomenclature(sources: list[DataFrame], key: list[str], label: str) -> DataFrame:
    """The label of each key in the last source that has one; equal ranks go to the greatest label."""
    whole = reduce(DataFrame.unionByName, (df.select(*key, label, F.lit(i).alias("_rank")) for i, df in enumerate(sources)))
    return whole.where(F.col(label).isNotNull()).groupBy(*key).agg(F.max(F.struct("_rank", label))[label].alias(label))


def rescue_labels(cut: DataFrame, whole: DataFrame, label: str, least: int = 12) -> DataFrame:
    """(label, rescued): cut-off labels completed where exactly one full label begins with them.

    Both sides meet on their first `least` characters, so no pair of all labels is
    built; shorter labels are not rescued.
    """
    head = F.substring(F.col(label), 1, least)
    full = whole.select(F.col(label).alias("_full")).distinct().withColumn("_head", F.substring("_full", 1, least))
    met = cut.select(label).where(F.length(label) >= least).distinct().withColumn("_head", head).join(full, "_head").where(F.col("_full").startswith(F.col(label)))
    return met.groupBy(label).agg(F.count(F.lit(1)).alias("_n"), F.min("_full").alias("rescued")).where("_n = 1").drop("_n")


def last_heading(context: Column, headings: dict[str, str]) -> Column:
    """The value of the heading that comes last in a text; null when none does."""
    place = {h: F.length(context) - F.locate(h[::-1], F.reverse(context)) - len(h) + 2 for h in headings}
    options = [F.struct(F.when(F.contains(context, F.lit(h)), place[h]).otherwise(F.lit(-1)).alias("at"), F.lit(v).alias("value")) for h, v in headings.items()]
    best = F.array_max(F.array(*options))
    return F.when(best["at"] > 0, best["value"])


def missing_years(rows: DataFrame, by: list[str], year: str) -> DataFrame:
    """Years between the first and the last of each group that have no row."""
    seen = rows.where(F.col(year).isNotNull()).select(*by, year).distinct()
    spans = seen.groupBy(*by).agg(F.min(year).alias("_a"), F.max(year).alias("_b"))
    whole = spans.select(*by, F.explode(F.sequence("_a", "_b")).alias(year))
    return whole.join(seen, [*by, year], "left_anti")


def partition_faults(whole: DataFrame, parts: list[DataFrame], key: str) -> DataFrame:
    """Keys that are not in exactly one part, or not in the whole: key, in_whole, parts."""
    tagged = whole.select(key, F.lit(1).alias("_w"), F.lit(0).alias("_p"))
    for part in parts:
        tagged = tagged.unionByName(part.select(key, F.lit(0).alias("_w"), F.lit(1).alias("_p")))
    counted = tagged.groupBy(key).agg((F.sum("_w") > 0).alias("in_whole"), F.sum("_p").alias("parts"))
    return counted.where("NOT in_whole OR parts <> 1")


def vector_faults(vectors: DataFrame, key: str, vector: str, size: int, tolerance: float = 0.006) -> DataFrame:
    """(key, fault) of vectors of another size, with null or infinite entries, or not of unit length."""
    v = F.col(vector)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fault = F.when(v.isNull() | (F.size(v) != size), "size").when(bad, "entry").when(F.abs(norm - 1) > tolerance, "norm")
    return vectors.select(key, fault.alias("fault")).where("fault IS NOT NULL")


def contiguous(parts: DataFrame, by: list[str], begin: str, end: str) -> DataFrame:
    """Groups whose ranges, in order, leave a gap or overlap: by, breaks."""
    before = F.lag(end).over(Window.partitionBy(*by).orderBy(begin, end))
    return parts.withColumn("_b", F.when(before.isNotNull() & (before != F.col(begin)), 1).otherwise(0)).groupBy(*by).agg(F.sum("_b").alias("breaks")).where("breaks > 0")


def forward_fill(rows: DataFrame, section: list[str], order: list[Column], filled: dict[str, str], changes: str | None = None) -> DataFrame:
    """rows with columns (new names) that hold the last value so far in their section; a change of column `changes` begins anew."""
    parts = list(section)
    if changes:
        window = Window.partitionBy(*section).orderBy(*order)
        new = F.when(F.col(changes).eqNullSafe(F.lag(changes).over(window)) & (F.row_number().over(window) > 1), 0).otherwise(1)
        rows = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(window)).drop("_new")
        parts.append("_run")
    window = Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    for column, name in filled.items():
        rows = rows.withColumn(name, F.last(column, ignorenulls=True).over(window))
    return rows.drop("_run")


def public(df: DataFrame) -> DataFrame:
    """df without its private columns, those whose name begins with '_'."""
    return df.select(*(c for c in df.columns if not c.startswith("_")))
