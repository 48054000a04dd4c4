"""Functions of the session's user, next to Spark's own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


class FunctionRegistry:
    """Registers scalar, vectorised, aggregate and table functions under a name for SQL and ``function``."""

    def __init__(self, spark: SparkSession):
        self.spark, self.names = spark, {"scalar": set(), "aggregate": set(), "table": set()}

    def scalar(self, name: str, fn: Callable, returns: str) -> None:
        """A vectorised function of pandas series, sent in Arrow batches."""
        self.spark.udf.register(name, F.pandas_udf(fn, returns, F.PandasUDFType.SCALAR))
        self.names["scalar"].add(name)

    def aggregate(self, name: str, fn: Callable, returns: str) -> None:
        """A grouped aggregate: a function of pandas series to one value. A group comes to one task whole."""
        self.spark.udf.register(name, F.pandas_udf(fn, returns, F.PandasUDFType.GROUPED_AGG))
        self.names["aggregate"].add(name)

    def table(self, name: str, handler: type, returns: str) -> None:
        self.spark.udtf.register(name, F.udtf(handler, returnType=returns))
        self.names["table"].add(name)
