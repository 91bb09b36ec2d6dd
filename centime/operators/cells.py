"""Result cells: selection among published values, grids with missing cells, sums of a selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ranked(facts: DataFrame, amount: str, ranking: list[Column]) -> DataFrame:
    return facts.where(F.col(amount).isNotNull()).withColumn("_rank", F.struct(*(c.alias(f"_{i}") for i, c in enumerate(ranking))))


def select_cells(facts: DataFrame, position: list[str], ranking: list[Column], amount: str, precision: Column, quantum: Column, scan: list[Column]) -> DataFrame:
    """One row for each position: value, status, distinct values, number of references, of earlier references, of alternatives.

    All facts that share the greatest ranking are chosen (ties are kept; a null in
    it counts least). One distinct amount: 'published'. Several whose rounding
    intervals (amount +- half the precision) meet: 'rounded_consistency', the value
    of the finest quantum, first in scan order; an unknown quantum is coarsest.
    Otherwise 'divergence' and no value. Facts without an amount do not count, an
    unknown precision is exact. Amounts up to the bounds of a long are compared
    without overflow. Equal amounts of one rank are combined before the shuffle, so
    that a position with very many facts is no hot spot.
    """
    value = F.col(amount)
    wide = value.cast("decimal(20,0)") * 2
    place = F.struct(quantum.isNull().alias("_n"), quantum.alias("_q"), *(c.alias(f"_o{i}") for i, c in enumerate(scan)), value.alias("_v"))
    exact = F.coalesce(precision, F.lit(0)).cast("decimal(20,0)")
    marked = _ranked(facts, amount, ranking).select(*position, "_rank", wide.alias("_twice"), exact.alias("_half"), place.alias("_place"))
    amounts = marked.groupBy(*position, "_rank", "_twice").agg(F.count(F.lit(1)).alias("_n"), F.min("_half").alias("_half"), F.min("_place").alias("_place"))
    ranks = amounts.groupBy(*position, "_rank").agg(
        F.count(F.lit(1)).alias("_values"),
        F.sum("_n").alias("_n"),
        F.max(F.col("_twice") - F.col("_half")).alias("_low"),
        F.min(F.col("_twice") + F.col("_half")).alias("_high"),
        F.min("_place").alias("_place"),
    )
    best = F.max(F.struct("_rank", "_values", "_n", "_low", "_high", "_place"))
    found = ranks.groupBy(*position).agg(best.alias("_best"), F.sum("_n").alias("_all"))
    chosen = F.col("_best")
    compatible = chosen["_low"] <= chosen["_high"]
    return found.select(
        *position,
        F.when(compatible, chosen["_place"]["_v"]).alias("value"),
        F.when(chosen["_values"] == 1, "published").when(compatible, "rounded_consistency").otherwise("divergence").alias("status"),
        chosen["_values"].alias("distinct_values"),
        chosen["_n"].alias("references_n"),
        (F.col("_all") - chosen["_n"]).alias("earlier_n"),
        F.when(chosen["_values"] > 1, chosen["_values"]).otherwise(F.lit(0).cast("bigint")).alias("alternatives"),
    )


def cell_references(facts: DataFrame, position: list[str], ranking: list[Column], amount: str, ident: str) -> DataFrame:
    """(position, ident, amount, role): every fact with an amount, as a reference of its cell or as an earlier one.

    Rows instead of lists, as a position may have any number of them.
    """
    ranked = _ranked(facts, amount, ranking).select(*position, ident, amount, "_rank")
    best = ranked.groupBy(*position).agg(F.max("_rank").alias("_best")).withColumnsRenamed({c: f"_b_{c}" for c in position})
    same = F.lit(True)
    for c in position:
        same = same & F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    role = F.when(F.col("_rank") == F.col("_best"), "reference").otherwise("earlier")
    return ranked.join(best, same).select(*position, ident, amount, role.alias("role"))


def grid(cells: DataFrame, axes: list[DataFrame], position: list[str], reason: Column) -> DataFrame:
    """Every combination of the axes (small dimension tables), missing cells with status 'missing' and a reason."""
    whole = axes[0]
    for axis in axes[1:]:
        whole = whole.crossJoin(axis)
    met = whole.join(cells, position, "left")
    return met.withColumn("reason", F.when(F.col("status").isNull(), reason)).withColumn("status", F.coalesce("status", F.lit("missing")))


def selection_sum(rows: DataFrame, by: list[str], value: str, kept: Column) -> DataFrame:
    """Sum of the kept rows of each group beside the group's own total: null when none is known; status empty_selection, partial or computed."""
    inside = F.when(kept, F.col(value))
    known, count = F.count(inside), F.count(F.when(kept, 1))
    return rows.groupBy(*by).agg(
        F.sum(inside).alias("value"),
        count.alias("members"),
        F.when(count == 0, "empty_selection").when(known < count, "partial").otherwise("computed").alias("status"),
    )


def unpivot(df: DataFrame, ids: list[str], fields: list[str], name: str, value: str) -> DataFrame:
    """Wide to long; nulls keep their row."""
    return df.unpivot(ids, fields, name, value)
