"""How rows are dealt over partitions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import Expr


@dataclass(frozen=True)
class Partitioning:
    """Round robin or by the hash of keys, into n partitions; or n partitions of unknown content."""

    kind: str
    n: int
    keys: tuple[Expr, ...] = ()

    def __str__(self) -> str:
        keys = f"[{', '.join(map(str, self.keys))}], " if self.kind == "Hash" else ""
        return f"{self.kind}({keys}{self.n})"


def round_robin(n: int) -> Partitioning:
    return Partitioning("RoundRobinBatch", n)


def hashed(keys: list[Expr], n: int) -> Partitioning:
    return Partitioning("Hash", n, tuple(keys))


def unknown(n: int) -> Partitioning:
    return Partitioning("UnknownPartitioning", n)


def repartition(df: DataFrame, how: Partitioning) -> DataFrame:
    if how.kind == "Hash":
        return df.repartition(how.n, *[k.column(df) for k in how.keys])
    return df.repartition(how.n) if how.kind == "RoundRobinBatch" else df.coalesce(how.n)


def partition_counts(df: DataFrame) -> DataFrame:
    """Rows by partition."""
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count("*").alias("rows"))
