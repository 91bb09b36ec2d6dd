"""Comparisons over years and stages: differences, rates, constant money. Gaps in years are gaps, never the previous row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from centime.functions.scalars import constant_cents


def with_reference(series: DataFrame, by: list[str], year: str, value: str) -> DataFrame:
    """series with prior (value of exactly the year before) and first (value of the first year)."""
    order = Window.partitionBy(*by).orderBy(year)
    before = order.rangeBetween(-1, -1)
    return series.withColumn("prior", F.max(value).over(before)).withColumn("first", F.first(value).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def growth(current: Column, reference: Column, index_current: Column | None = None, index_reference: Column | None = None) -> Column:
    """Percent change, 4 decimals, half up; in constant money when indices are given. Null unless the reference is positive and both indices known."""
    ratio = current.cast("double") / reference.cast("double")
    if index_current is not None:
        ratio = ratio * index_reference.cast("double") / index_current.cast("double")
    return F.when(reference > 0, F.round((ratio - 1) * 100, 4))


def growth_status(current: Column, reference: Column, index: Column | None = None) -> Column:
    status = F.when(reference.isNull() | current.isNull(), "unavailable").when(reference <= 0, "nonpositive_reference")
    if index is not None:
        status = status.when(index.isNull(), "inflation_missing")
    return status.otherwise("ok")


def in_constant_money(rows: DataFrame, indices: DataFrame, year: str, cents: str, base: int) -> DataFrame:
    """rows with constant_cents and index of their year; indices (year, index_value bigint) is a small dimension: one row a year."""
    at_base = indices.where(F.col("year") == base).select(F.col("index_value").alias("_base"))
    dated = indices.withColumnsRenamed({"year": year, "index_value": "index_value"})
    met = rows.join(F.broadcast(dated), year, "left").join(F.broadcast(at_base))
    return met.withColumn("constant_cents", constant_cents(F.col(cents), F.col("index_value"), F.col("_base"))).drop("_base")


def compare_stages(series: DataFrame, by: list[str], stage: str, value: str, first: str, second: str) -> DataFrame:
    """Second minus first stage, and second over first in percent: unavailable without both, zero_denominator on 0."""
    wide = series.groupBy(*by).pivot(stage, [first, second]).agg(F.sum(value))
    a, b = F.col(first), F.col(second)
    return wide.select(
        *by,
        (b - a).alias("difference"),
        F.when(a != 0, F.round(b.cast("double") / a.cast("double") * 100, 4)).alias("rate"),
        F.when(a.isNull() | b.isNull(), "unavailable").when(a == 0, "zero_denominator").otherwise("ok").alias("status"),
    )
