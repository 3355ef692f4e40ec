"""Filter, project, distinct, sort, limit and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def select_where(df: DataFrame, condition: Column | str) -> DataFrame:
    """Rows for which the condition is true; unknown counts as false."""
    return df.where(condition)


def project(df: DataFrame, **columns: Column | str) -> DataFrame:
    """Computed columns under their names; a string is an SQL expression."""
    return df.select(*[(F.expr(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()])


def distinct(df: DataFrame, *columns: str) -> DataFrame:
    return (df.select(*columns) if columns else df).distinct()


def sort(df: DataFrame, *keys: str) -> DataFrame:
    """By column names, with a minus for descending order. Nulls count as largest: last when ascending,
    first when descending."""
    return df.orderBy(*[F.desc_nulls_first(k[1:]) if k.startswith("-") else F.asc_nulls_last(k) for k in keys])


def page(df: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Skip ``offset`` rows, then take ``limit``. After a sort this is a top-k without a full sort."""
    df = df.offset(offset) if offset else df
    return df if limit is None else df.limit(limit)


_SETS = {
    ("union", True): DataFrame.union, ("union", False): lambda a, b: a.union(b).distinct(),
    ("intersect", True): DataFrame.intersectAll, ("intersect", False): DataFrame.intersect,
    ("except", True): DataFrame.exceptAll, ("except", False): DataFrame.subtract,
}


def combine(kind: str, frames: Sequence[DataFrame], every: bool = False) -> DataFrame:
    """UNION, INTERSECT or EXCEPT from left to right, by position; ``every``: ALL."""
    out = frames[0]
    for df in frames[1:]:
        out = _SETS[kind, every](out, df)
    return out
