"""Scalar functions beyond operators: the four of the SQL surface, under one name each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: SQL name to function; any other name goes to Spark, which knows or rejects it.
SCALAR: dict[str, Callable[[Column], Column]] = {"UPPER": F.upper, "LOWER": F.lower, "TRIM": F.trim, "LENGTH": F.length}


def safe_divide(a: Column, b: Column) -> Column:
    """Null instead of an error where the divisor is zero."""
    return F.try_divide(a, b)
