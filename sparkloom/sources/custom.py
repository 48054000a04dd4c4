"""Tables of the user's own making."""

from __future__ import annotations

import inspect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class TableProvider:
    """Subclass with a schema, a number of partitions, and a scan of each as Arrow batches.

    Instances are sent to executors, so keep them small and picklable. ``scan`` yields the columns that it is
    asked for in ``columns``; one that takes the partition only yields all, and the rest is dropped.
    """

    partitions = 1

    def schema(self) -> str:
        raise NotImplementedError

    def scan(self, partition: int, columns: list[str] | None = None) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError


def provided(spark: SparkSession, provider: TableProvider, name: str, columns: list[str] | None = None) -> DataFrame:
    """The provider's table, or the named columns of it, read through Spark's data source interface under
    ``name``. The projection reaches the scan, so that columns that aren't asked for needn't be made."""
    whole = spark.createDataFrame([], provider.schema()).schema
    takes_columns = len(inspect.signature(provider.scan).parameters) > 1

    class Reader(DataSourceReader):
        def partitions(self):
            return [InputPartition(i) for i in range(provider.partitions)]

        def read(self, partition):
            for batch in provider.scan(partition.value, columns) if takes_columns else provider.scan(partition.value):
                yield batch.select(columns) if columns else batch

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return T.StructType([whole[c] for c in columns]) if columns else whole

        def reader(self, schema):
            return Reader()

    spark.dataSource.register(Source)
    return spark.read.format(name).load()
