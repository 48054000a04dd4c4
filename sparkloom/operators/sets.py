"""Set operations, by position."""

from __future__ import annotations

from pyspark.sql import DataFrame


def union(a: DataFrame, b: DataFrame, distinct: bool = False) -> DataFrame:
    both = a.union(b)
    return both.distinct() if distinct else both


def intersect(a: DataFrame, b: DataFrame, keep_repeats: bool = False) -> DataFrame:
    return a.intersectAll(b) if keep_repeats else a.intersect(b)


def except_(a: DataFrame, b: DataFrame, keep_repeats: bool = False) -> DataFrame:
    return a.exceptAll(b) if keep_repeats else a.subtract(b)
