"""Grouped and global aggregation; partial sums are made before each shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def aggregate(df: DataFrame, by: Sequence[Column | str], having: Column | str | None = None, **columns: Column | str) -> DataFrame:
    """GROUP BY ``by`` (columns or expressions; none: one row in all) with named aggregates."""
    made = [(F.expr(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()]
    out = df.groupBy(*by).agg(*made) if by else df.agg(*made)
    return out.where(having) if having is not None else out


def exact_sum(column: Column | str, precision: int = 18, scale: int = 2) -> Column:
    """The sum of doubles that hold decimals, independent of the order of rows."""
    c = F.col(column) if isinstance(column, str) else column
    return F.sum(c.cast(f"decimal({precision},{scale})")).cast("double")
