"""Tables in files. Filters and column lists go down to the scan, as Catalyst pushes them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import StructType

FORMATS = ("parquet", "orc", "json", "csv")
#: The driver's tables.
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read(spark: SparkSession, path: str, fmt: str = "parquet", schema: StructType | str | None = None, **options) -> DataFrame:
    """A table in one of FORMATS; csv and json should be given their schema."""
    if fmt not in FORMATS:
        raise ValueError(f"no such format: {fmt}")
    reader = spark.read.options(**options)
    return (reader.schema(schema) if schema is not None else reader).format(fmt).load(path)


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", partition_by: Sequence[str] = (), **options) -> None:
    if fmt not in FORMATS:
        raise ValueError(f"no such format: {fmt}")
    writer = df.write.options(**options).format(fmt).mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read(spark, f"{sf_dir}/{name}.parquet")


class Tables:
    """Scans by name over a folder of Parquet tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def scan(self, name: str, columns: Sequence[str] | None = None, where: Column | str | None = None) -> DataFrame:
        df = table(self.spark, self.folder, name)
        df = df.where(where) if where is not None else df
        return df.select(*columns) if columns else df

    def equal(self, name: str, **values) -> DataFrame:
        """Rows whose columns equal the values."""
        df = self.scan(name)
        for column, value in values.items():
            df = df.where(df[column] == value)
        return df

    def between(self, name: str, column: str, low=None, high=None) -> DataFrame:
        """A range, open where a bound is None."""
        df = self.scan(name)
        df = df.where(df[column] >= low) if low is not None else df
        return df.where(df[column] <= high) if high is not None else df


def literals(spark: SparkSession, rows: Sequence[Sequence], schema: StructType | str) -> DataFrame:
    """A VALUES list."""
    return spark.createDataFrame([tuple(r) for r in rows], schema)
