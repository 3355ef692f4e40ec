"""SQL column types and their Spark types."""

from __future__ import annotations

import re

from pyspark.sql.types import (
    BinaryType, BooleanType, ByteType, DataType, DateType, DecimalType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, TimestampNTZType,
)

from .errors import PROTOCOL, UNSUPPORTED_SQL, EngineError

#: TIME is text: Spark tables have no such column type.
SIMPLE: dict[str, DataType] = {
    "INTEGER": IntegerType(), "INT": IntegerType(), "BIGINT": LongType(), "INT8": LongType(), "SMALLINT": ShortType(), "TINYINT": ByteType(),
    "REAL": FloatType(), "FLOAT": FloatType(), "DOUBLE": DoubleType(), "DOUBLE PRECISION": DoubleType(), "TEXT": StringType(), "VARCHAR": StringType(),
    "CHAR": StringType(), "STRING": StringType(), "BOOLEAN": BooleanType(), "BOOL": BooleanType(), "DATE": DateType(), "TIME": StringType(),
    "TIMESTAMP": TimestampNTZType(), "BLOB": BinaryType(),
}
_NUMBERS = (ByteType, ShortType, IntegerType, LongType, FloatType, DoubleType, DecimalType)


def parse_type(text: str) -> DataType:
    """The Spark type of a SQL type such as ``VARCHAR(32)`` or ``DECIMAL(10, 2)``."""
    m = re.fullmatch(r"\s*([A-Za-z][A-Za-z0-9 ]*?)\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?\s*", text)
    name = m[1].upper() if m else ""
    if name in ("DECIMAL", "NUMERIC"):
        return DecimalType(int(m[2] or 10), int(m[3] or 0))
    if name not in SIMPLE:
        raise EngineError(PROTOCOL, f"unknown type {text.strip()}")
    if name in ("VARCHAR", "CHAR") and m[2] == "0":
        raise EngineError(PROTOCOL, f"{name}(0) holds no value")
    return SIMPLE[name]


def check_change(old: DataType, new: DataType) -> None:
    """Only numbers to numbers and text to text can be converted in place."""
    if old != new and not (isinstance(old, _NUMBERS) and isinstance(new, _NUMBERS)) and not (isinstance(old, StringType) and isinstance(new, StringType)):
        raise EngineError(UNSUPPORTED_SQL, f"no conversion from {old.simpleString()} to {new.simpleString()}")
