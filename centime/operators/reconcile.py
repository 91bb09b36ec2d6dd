"""Checks of published figures against each other. Conflicts are reported, never resolved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tolerance_class(published: Column, reference: Column, members: Column) -> Column:
    """exact, published_rounding_difference, source_difference or material_difference; all in cents."""
    gap = F.abs(published - reference)
    rounding = F.least(F.lit(1000), F.greatest(F.lit(100), (members + 1) * 50))
    source = F.least(F.lit(1000), F.floor(F.abs(reference) / 1000))
    return F.when(gap == 0, "exact").when(gap <= rounding, "published_rounding_difference").when(gap <= source, "source_difference").otherwise("material_difference")


def balance(triplets: DataFrame, by: list[str], metric: str, value: str, bound: Column) -> DataFrame:
    """Receipts minus expenditure minus balance of each key that has all three, against the sum of half quanta."""
    wide = triplets.groupBy(*by).pivot(metric, ["RECETTES", "DEPENSES", "SOLDE"]).agg(F.sum(value)).dropna()
    gap = F.col("RECETTES") - F.col("DEPENSES") - F.col("SOLDE")
    return wide.withColumn("gap", gap).withColumn("balanced", F.abs(gap) <= bound)


def leaf_or_parent(parents: DataFrame, children: DataFrame, key: str, parent_value: str, child_value: str) -> DataFrame:
    """The children's figures where all are known and add up to the parent, else the parent's own with a note."""
    sums = children.groupBy(key).agg(F.sum(child_value).alias("_sum"), F.count(child_value).alias("_known"), F.count(F.lit(1)).alias("_all"))
    met = parents.where(F.col(parent_value).isNotNull()).join(sums, key, "left")
    full = (F.col("_known") == F.col("_all")) & (F.col("_sum") == F.col(parent_value))
    return met.select(
        key,
        parent_value,
        F.coalesce("_all", F.lit(0)).alias("children"),
        F.when(F.col("_all").isNull(), "no_children").when(full, "children").otherwise("parent_kept").alias("source"),
    )


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other, with the side: multiset difference both ways in one pass."""
    names = a.columns
    both = a.select(*names, F.lit(1).alias("_n")).unionByName(b.select(*names, F.lit(-1).alias("_n")))
    counted = both.groupBy(*names).agg(F.sum("_n").alias("surplus")).where("surplus <> 0")
    return counted.withColumn("side", F.when(F.col("surplus") > 0, "only_first").otherwise("only_second")).withColumn("surplus", F.abs("surplus"))


def precedence_merge(sources: list[DataFrame], key: list[str], values: list[str]) -> DataFrame:
    """Rows of the first source that has a key; later sources only fill in. Ties within a source go to the least values."""
    whole = None
    for rank, df in enumerate(sources):
        part = df.select(*key, *values, F.lit(rank).alias("source_rank"))
        whole = part if whole is None else whole.unionByName(part)
    best = F.min(F.struct("source_rank", *values)).alias("_best")
    return whole.groupBy(*key).agg(best).select(*key, "_best.source_rank", *(f"_best.{v}" for v in values))


def plan_against(actual: DataFrame, plan: DataFrame, key: list[str], value: str) -> DataFrame:
    """Each key of either side: present, to_insert, unplanned or conflict."""
    met = actual.select(*key, F.col(value).alias("actual")).join(plan.select(*key, F.col(value).alias("planned")), key, "full_outer")
    kind = F.when(F.col("actual").isNull(), "to_insert").when(F.col("planned").isNull(), "unplanned").when(F.col("actual") == F.col("planned"), "present").otherwise("conflict")
    return met.withColumn("kind", kind)


def content_digest(df: DataFrame) -> DataFrame:
    """One row: number of rows and an order-free digest of them; equal tables have equal digests."""
    row = F.xxhash64(*df.columns)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(row).alias("digest"), F.sum(row.cast("decimal(38,0)")).cast("string").alias("total"))


def ordered_digest(df: DataFrame, key: str, columns: list[str], lead: int = 2) -> DataFrame:
    """(digest, n): one SHA-256 over all rows in the order of a text key, equal keys in the order of their own digests.

    Keys that begin with the same `lead` characters are one part; the digest is
    that of the parts' digests in order, so no list holds more than a part's rows
    (64 characters each). Null columns count as '~'; rows without a key are left out.
    """
    text = F.concat_ws("|", F.col(key), *(F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns))
    rows = df.where(F.col(key).isNotNull()).select(F.substring(key, 1, lead).alias("_part"), F.col(key).alias("_key"), F.sha2(text, 256).alias("_print"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("_key", "_print"))), lambda x: x["_print"])
    parts = rows.groupBy("_part").agg(F.sha2(F.array_join(listed, ""), 256).alias("_digest"), F.count(F.lit(1)).alias("_n"))
    whole = F.transform(F.sort_array(F.collect_list(F.struct("_part", "_digest"))), lambda x: F.concat(x["_part"], x["_digest"]))
    return parts.agg(F.sha2(F.array_join(whole, ""), 256).alias("digest"), F.sum("_n").alias("n"))


def notices_of(facts: DataFrame, notices: DataFrame, key: dict[str, str], metric: str | None = None, amount: str | None = None) -> DataFrame:
    """facts with record_id of every notice on the same key and source.

    notices: record_id, notice_key (array of texts, as many as the key has parts or
    more), source_sha, values_cents (map). key: column of facts -> type of its part.
    With metric and amount, the notice's value of the metric must be the fact's
    amount: a fact that has changed since loses its notice. Null keys meet nothing.
    """
    told = notices.where(F.size("notice_key") == 6).select(
        "record_id", "values_cents", F.col("source_sha"), *(F.element_at("notice_key", i + 1).try_cast(kind).alias(c) for i, (c, kind) in enumerate(key.items()))
    )
    met = facts.join(told, [*key, "source_sha"])
    if metric and amount:
        met = met.where(F.try_element_at("values_cents", F.col(metric)) == F.col(amount))
    return met.drop("values_cents")
