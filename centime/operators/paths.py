"""Positions in a hierarchy as '/'-separated paths: containment, exclusions, drill-down."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def node_path(*levels: Column | str) -> Column:
    """Non-empty levels joined; empty and null ones are skipped."""
    cols = [F.col(c) if isinstance(c, str) else c for c in levels]
    return F.concat_ws("/", *(F.nullif(c.cast("string"), F.lit("")) for c in cols))


def within(path: Column, parent: Column | str) -> Column:
    """Whether path lies at or below parent, whole segments only; the empty parent holds everything."""
    parent = F.lit(parent) if isinstance(parent, str) else parent
    return (parent == "") | (path == parent) | path.startswith(F.concat(parent, F.lit("/")))


def overlaps(path: Column, scope: Column | str) -> Column:
    """Whether one of the two holds the other."""
    scope = F.lit(scope) if isinstance(scope, str) else scope
    return within(path, scope) | within(scope, path)


def ancestor(path: Column, depth: int | Column) -> Column:
    """The first segments of a path."""
    return F.array_join(F.slice(F.split(path, "/"), 1, depth), "/")


def ancestors(path: Column) -> Column:
    """A path and all its ancestors, outermost first: what an equi-join on prefixes needs."""
    return F.transform(F.sequence(F.lit(1), F.size(F.split(path, "/"))), lambda d: ancestor(path, d))


def outermost(exclusions: list[str]) -> list[str]:
    """Exclusions that lie in no other one."""
    return sorted(e for e in set(exclusions) if not any(e != o and (o == "" or e.startswith(o + "/")) for o in exclusions))


def excluded(path: Column, exclusions: list[str]) -> Column:
    """Whether a path lies in one of a few exclusions (a parameter of the query, at most 100)."""
    return reduce(lambda a, e: a | within(path, e), outermost(exclusions), F.lit(False))


def finer_exclusion(path: Column, exclusions: list[str]) -> Column:
    """Whether an exclusion lies strictly inside a path: the row is too coarse to take it off."""
    return reduce(lambda a, e: a | (F.lit(e).startswith(F.concat(path, F.lit("/")))), outermost(exclusions), F.lit(False))


def under_scopes(rows: DataFrame, scopes: DataFrame, path: str = "path", scope: str = "scope") -> DataFrame:
    """rows joined with every scope that holds them, by an equi-join on the rows' ancestors (the empty scope included)."""
    key = F.concat(F.array(F.lit("")), ancestors(F.col(path)))
    return rows.withColumn(scope, F.explode(key)).join(scopes, scope)
