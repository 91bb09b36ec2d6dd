"""Ordered status rules: the first reason that applies is the status, and only 'published' carries a value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_reason(*rules: tuple[Column, str], otherwise: str = "published") -> Column:
    """The status of the first rule that holds; a null condition does not hold."""
    chain = None
    for condition, status in rules:
        chain = F.when(condition, status) if chain is None else chain.when(condition, status)
    return F.lit(otherwise) if chain is None else chain.otherwise(otherwise)


def last_reason(*rules: tuple[Column, str], otherwise: str = "published") -> Column:
    """The status of the last rule that holds: later rules override earlier ones."""
    return first_reason(*reversed(rules), otherwise=otherwise)


def with_status(df: DataFrame, value: str, *rules: tuple[Column, str]) -> DataFrame:
    """df with status and the value only where it is published."""
    return df.withColumn("status", first_reason(*rules)).withColumn(value, F.when(F.col("status") == "published", F.col(value)))


def coverage(df: DataFrame, by: list[str], status: str = "status") -> DataFrame:
    """Rows of each status."""
    return df.groupBy(*by, status).agg(F.count(F.lit(1)).alias("n"))
