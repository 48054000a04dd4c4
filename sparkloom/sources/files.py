"""CSV, TSV, Parquet and in-memory tables, and rows as CSV text."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..errors import IoError
from ..functions.types import widen_ints


#: Records that types are inferred from.
INFERRED = 1024


def csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, header: bool = True, separator: str = ",") -> DataFrame:
    """Delimited text with quoted fields. An empty field is null. Without a schema, types are inferred from
    the first INFERRED records, and integers are bigint; a later value of another type raises when it is read."""
    reader = spark.read.option("header", header).option("sep", separator).option("quote", '"').option("escape", '"').option("multiLine", False)
    try:
        if schema is not None:
            return reader.schema(schema).csv(path)
        head = [r[0] for r in spark.read.text(path).limit(INFERRED + header).collect()]
        if not head:
            return reader.csv(path)
        known = widen_ints(reader.option("inferSchema", True).csv(spark.sparkContext.parallelize(head, 1))).schema
        return reader.schema(known).option("mode", "FAILFAST").csv(path)
    except AnalysisException as e:
        raise IoError(str(e).splitlines()[0], f"reading {path}") from e


def tsv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, header: bool = True) -> DataFrame:
    return csv(spark, path, schema, header, "\t")


def parquet(spark: SparkSession, path: str) -> DataFrame:
    """Columns and filters of the query reach the scan."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        raise IoError(str(e).splitlines()[0], f"reading {path}") from e


def memory(spark: SparkSession, data: pa.Table | Iterable[pa.RecordBatch] | list[tuple], schema: T.StructType | str | pa.Schema | None = None, columns: list[str] | None = None) -> DataFrame:
    """A table of the driver's memory: Arrow tables or batches, or rows with a schema. ``columns`` projects."""
    if not isinstance(data, (pa.Table, list)) or (data and isinstance(data, list) and isinstance(data[0], pa.RecordBatch)):
        data = pa.Table.from_batches(list(data), schema if isinstance(schema, pa.Schema) else None)
    df = spark.createDataFrame(data) if isinstance(data, pa.Table) else spark.createDataFrame(data, schema)
    return df.select(*columns) if columns else df


def csv_line(row) -> str:
    """Values joined by commas, without quotes; null as ``null``, dates in ISO form, booleans lower-case."""
    show = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v)
    return ",".join(map(show, row))


def to_csv(df: DataFrame) -> str:
    """All rows as lines, fetched a partition at a time; for results small enough to show."""
    return "".join(csv_line(r) + "\n" for r in df.toLocalIterator())
