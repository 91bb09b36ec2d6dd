"""Parents and their parts: attaching verified parts, taking exclusions off, proofs of what was done."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from centime.operators.paths import ancestors, excluded


def attach(parents: DataFrame, groups: DataFrame, key: list[str], value: str, parts: str) -> DataFrame:
    """Parts of each parent whose figure and source are still those the parts were reviewed against; else an empty list.

    groups: key, reviewed_<value>, source, parts (array); a changed parent, an
    unknown source or a key with several groups gets no parts.
    """
    once = groups.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.first(f"reviewed_{value}").alias("_reviewed"), F.first("source").alias("_source"), F.first(parts).alias("_parts")).where("_n = 1")
    met = parents.join(once, key, "left")
    same = (F.col("_reviewed") == F.col(value)) & (F.col("_source") == F.col("source"))
    return met.withColumn(parts, F.when(same, F.col("_parts"))).drop("_n", "_reviewed", "_source", "_parts")


def resolve(parents: DataFrame, children: DataFrame, exclusions: list[str] | DataFrame, value: str = "cents") -> DataFrame:
    """Parents less their excluded children. exclusions: a few paths, or a table (path) of any number.

    parents: path, value; children: parent, path, value. An excluded parent, or
    one with all children excluded, goes whole, its residual too (fully_excluded).
    Some children excluded: parent minus these, provided each is known. Otherwise
    unchanged. removed has what was taken off, as the proof of the figure.
    """
    parents, children = (mark_excluded(df, exclusions) for df in (parents, children))
    gone = F.col("_gone")
    taken = children.groupBy(F.col("parent").alias("path")).agg(
        F.count(F.lit(1)).alias("_all"),
        F.count(F.when(F.col("_gone"), 1)).alias("_excluded"),
        F.sum(F.when(F.col("_gone"), F.col(value))).alias("_sum"),
        F.count(F.when(F.col("_gone") & F.col(value).isNull(), 1)).alias("_unknown"),
    )
    met = parents.join(taken, "path", "left")
    whole = gone | (F.col("_excluded") == F.col("_all"))
    some = F.coalesce(F.col("_excluded") > 0, F.lit(False))
    unknown = some & (F.col("_unknown") > 0)
    return met.select(
        "path",
        F.when(whole, F.lit(0).cast("bigint")).when(unknown, F.lit(None)).when(some, F.col(value) - F.col("_sum")).otherwise(F.col(value)).alias(value),
        F.when(whole, F.col(value)).when(some & ~unknown, F.col("_sum")).otherwise(F.lit(0).cast("bigint")).alias("removed"),
        F.when(whole, "fully_excluded").when(unknown, "detail_unavailable").when(some, "computed").otherwise("unchanged").alias("status"),
    )


def mark_excluded(rows: DataFrame, exclusions: list[str] | DataFrame, path: str = "path") -> DataFrame:
    """rows with _gone: whether an exclusion holds the path. A table of exclusions meets the rows' ancestors by an equi-join."""
    if isinstance(exclusions, list):
        return rows.withColumn("_gone", excluded(F.col(path), exclusions))
    hit = rows.select(path).distinct().withColumn("_up", F.explode(ancestors(F.col(path)))).join(exclusions.select(F.col("path").alias("_up")).distinct(), "_up", "left_semi").select(path).distinct()
    return rows.join(hit.withColumn("_hit", F.lit(True)), path, "left").withColumn("_gone", F.coalesce("_hit", F.lit(False))).drop("_hit")


def walk(groups: DataFrame, keys: list[str], parts: str = "actions", inner: str = "subactions") -> DataFrame:
    """Nested parts as rows before their own parts: depth, place at each level, code, label, cents."""
    first = groups.select(*keys, F.posexplode(parts).alias("no", "part"))
    top = first.select(*keys, F.lit(1).alias("depth"), "no", F.lit(-1).alias("inner_no"), "part.code", "part.label", _cents("part").alias("cents"))
    second = first.select(*keys, "no", F.posexplode(f"part.{inner}").alias("inner_no", "sub"))
    below = second.select(*keys, F.lit(2).alias("depth"), "no", "inner_no", "sub.code", "sub.label", _cents("sub").alias("cents"))
    return top.unionByName(below)


def _cents(part: str) -> Column:
    return F.coalesce(F.col(f"{part}.cents"), F.col(f"{part}.euros") * 100)
