"""Distributed prefix sums over range-sorted groups, native operators only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written


def running_totals(df: DataFrame, group: str, order: list[str], value: str, before: str) -> DataFrame:
    """Add ``before``: the sum of ``value`` over the rows of the same group that sort earlier.

    Rows are range-partitioned by (group, order), so a group that holds a third of all rows spreads
    over many partitions. Sums are made within each partition first; a table of one row for each
    (partition, group) then gives each partition its base. ``order`` has to be total up to equal rows.
    """
    ranged = written(df.repartitionByRange(group, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    within = Window.partitionBy("_part", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        ranged.groupBy("_part", group)
        .agg(F.sum(value).alias("_sum"))
        .withColumn("_base", F.coalesce(F.sum("_sum").over(across), F.lit(0)))
        .drop("_sum")
    )
    local = ranged.withColumn("_local", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return local.join(bases, ["_part", group]).withColumn(before, F.col("_local") + F.col("_base")).drop("_part", "_local", "_base")
