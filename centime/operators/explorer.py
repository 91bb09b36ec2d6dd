"""Cells of a position in the hierarchy over years and stages, with coverage and exclusions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from centime.operators.paths import excluded, finer_exclusion, within


def position_cells(rows: DataFrame, scope: str, exclusions: list[str], by: list[str], path: str = "path", program: str = "program", value: str = "cents") -> DataFrame:
    """One row for each of `by`: value, status, members, programs, expected programs.

    In scope count rows at or below it. A row that is coarser than the scope, or
    that an exclusion lies strictly inside of, cannot be resolved: the cell is
    detail_unavailable and has no value. All members excluded: 0, excluded. No
    rows: missing, no value. A program seen anywhere in scope that the cell lacks
    makes it partial; the value stays.
    """
    p = F.col(path)
    gone, inside = excluded(p, exclusions), within(p, scope)
    coarse = within(F.lit(scope), p) & ~inside if scope else F.lit(False)
    marked = rows.withColumn("_gone", inside & gone).withColumn("_stuck", (coarse & ~gone) | (inside & ~gone & finer_exclusion(p, exclusions)))
    marked = marked.withColumn("_kept", inside & ~F.col("_gone") & ~F.col("_stuck")).where("_gone OR _stuck OR _kept")
    expected = marked.where("_kept").agg(F.countDistinct(program).alias("expected_programs"))
    cells = marked.groupBy(*by).agg(
        F.count(F.when(F.col("_stuck"), 1)).alias("_stuck"),
        F.count(F.when(F.col("_gone"), 1)).alias("_gone"),
        F.count(F.when(F.col("_kept"), 1)).alias("members"),
        F.sum(F.when(F.col("_kept"), F.col(value))).alias("_sum"),
        F.countDistinct(F.when(F.col("_kept"), F.col(program))).alias("programs"),
    )
    met = cells.join(F.broadcast(expected))  # one row
    none_kept = F.col("members") == 0
    status = (
        F.when(F.col("_stuck") > 0, "detail_unavailable").when(none_kept & (F.col("_gone") > 0), "excluded").when(none_kept | F.col("_sum").isNull(), "missing")
        .when(F.col("programs") < F.col("expected_programs"), "partial").otherwise("ok")
    )
    met = met.withColumn("status", status)
    number = F.when(F.col("status") == "excluded", F.lit(0).cast("bigint")).when(F.col("status").isin("ok", "partial"), F.col("_sum"))
    return met.select(*by, number.alias("value"), "status", "members", "programs", "expected_programs")


def confirmed_totals(cells: DataFrame, totals: DataFrame, by: list[str]) -> DataFrame:
    """A partial cell that equals the separately published total exactly is ok; nothing else changes. totals: by, total, one row a key."""
    met = cells.join(totals.select(*by, "total"), by, "left")
    same = (F.col("status") == "partial") & (F.col("value") == F.col("total"))
    return met.withColumn("status", F.when(same, "ok").otherwise(F.col("status"))).drop("total")


def without_part(cells: DataFrame, part: DataFrame, by: list[str]) -> DataFrame:
    """Cells less a reviewed part of them (by, part): no value when either is unknown, or the part exceeds the whole."""
    met = cells.join(part.select(*by, "part"), by, "left")
    rest = F.col("value") - F.col("part")
    return met.withColumn("rest", F.when(rest >= 0, rest)).withColumn("rest_status", F.when(rest.isNull(), "unavailable").when(rest < 0, "part_exceeds_whole").otherwise("ok"))
