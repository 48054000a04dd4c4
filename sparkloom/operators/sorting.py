"""Sorting with explicit null order, top-k, limits and offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import Expr, to_expr


class SortKey:
    """A key with its direction and the place of nulls; ascending with nulls first by default."""

    def __init__(self, expr: Expr, ascending: bool = True, nulls_first: bool = True):
        self.expr, self.ascending, self.nulls_first = to_expr(expr), ascending, nulls_first

    def column(self, df: DataFrame) -> Column:
        kind = f"{'asc' if self.ascending else 'desc'}_nulls_{'first' if self.nulls_first else 'last'}"
        return getattr(self.expr.column(df), kind)()

    def parts(self) -> tuple[Expr, str, str]:
        return self.expr, "ASC" if self.ascending else "DESC", "FIRST" if self.nulls_first else "LAST"


def asc(e, nulls_first: bool = True) -> SortKey:
    return SortKey(e, True, nulls_first)


def desc(e, nulls_first: bool = True) -> SortKey:
    return SortKey(e, False, nulls_first)


def as_key(key) -> SortKey:
    return key if isinstance(key, SortKey) else SortKey(key)


def sort(df: DataFrame, keys: list) -> DataFrame:
    return df.orderBy(*[as_key(k).column(df) for k in keys])


def top_k(df: DataFrame, keys: list, k: int) -> DataFrame:
    """The first k rows in order: a bounded heap in each task, then one merge."""
    return sort(df, keys).limit(k)


def sort_within_partitions(df: DataFrame, keys: list) -> DataFrame:
    return df.sortWithinPartitions(*[as_key(k).column(df) for k in keys])


def limit(df: DataFrame, n: int, skip: int = 0) -> DataFrame:
    return (df.offset(skip) if skip else df).limit(n)


def local_limit(df: DataFrame, n: int) -> DataFrame:
    """The first n rows of each partition: those whose number within the partition is below n."""
    number = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return df.withColumn("local.number", number).where(F.col("`local.number`") < n).drop("local.number")
