"""Type names of the front end and their Spark types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Type names as plans print them. Unsigned types take the next wider signed one.
TYPES = {
    "Boolean": T.BooleanType(), "Int8": T.ByteType(), "Int16": T.ShortType(), "Int32": T.IntegerType(), "Int64": T.LongType(),
    "UInt8": T.ShortType(), "UInt16": T.IntegerType(), "UInt32": T.LongType(), "UInt64": T.DecimalType(20, 0),
    "Float32": T.FloatType(), "Float64": T.DoubleType(), "Utf8": T.StringType(), "Binary": T.BinaryType(), "Date32": T.DateType(), "Null": T.NullType(),
}
#: SQL names that CAST accepts.
SQL_NAMES = {"BOOLEAN": "Boolean", "BOOL": "Boolean", "INT": "Int32", "INTEGER": "Int32", "BIGINT": "Int64", "DOUBLE": "Float64", "FLOAT": "Float64", "VARCHAR": "Utf8", "TEXT": "Utf8", "STRING": "Utf8", "DATE": "Date32"}

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def spark_type(name: str | T.DataType) -> T.DataType:
    """The Spark type of a plan's or SQL's type name."""
    if isinstance(name, T.DataType):
        return name
    found = TYPES.get(name) or TYPES.get(SQL_NAMES.get(name.upper(), ""))
    if found is None:
        raise ValueError(f"unknown type {name}")
    return found


def type_name(kind: str | T.DataType) -> str:
    """The name that plans print for a type."""
    if isinstance(kind, str):
        return kind if kind in TYPES else SQL_NAMES.get(kind.upper(), kind)
    return next((k for k, v in TYPES.items() if v == kind and not k.startswith("UInt")), kind.simpleString())


def widen_ints(df: DataFrame) -> DataFrame:
    """Inferred int columns as bigint, the only integer that inference gives here."""
    return df.select(*[F.col(f"`{f.name}`").cast("long").alias(f.name) if isinstance(f.dataType, T.IntegerType) else F.col(f"`{f.name}`") for f in df.schema])
