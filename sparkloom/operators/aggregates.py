"""Grouping: plain, by sets, and in explicit partial and final phases."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import PlanError
from ..functions.expr import Expr


class AggregateMode(str, Enum):
    PARTIAL = "Partial"
    FINAL = "Final"
    FINAL_PARTITIONED = "FinalPartitioned"
    SINGLE = "Single"
    SINGLE_PARTITIONED = "SinglePartitioned"
    PARTIAL_REDUCE = "PartialReduce"


def _named(df: DataFrame, exprs: list[Expr]) -> list[Column]:
    return [e.named(df) for e in exprs]


def aggregate(df: DataFrame, group: list[Expr], aggregates: list[Expr]) -> DataFrame:
    """Group columns, then aggregates. Without groups one row, also of no rows; null is a group."""
    columns = _named(df, aggregates)
    if not columns:
        return df.select(*_named(df, group)).distinct()
    return df.groupBy(*_named(df, group)).agg(*columns)


def grouping_sets(df: DataFrame, sets: list[list[Expr]], group: list[Expr], aggregates: list[Expr], kind: str = "sets") -> DataFrame:
    """``rollup`` or ``cube`` over the group, or the listed ``sets`` of it; absent keys are null."""
    names = [e.name(df.columns) for e in group]
    columns = _named(df, aggregates)
    # keys as columns of their own, so that the sets refer to them and aggregates still see the input
    own = {f"key.{i}": e for i, e in enumerate(group)}
    keyed = df.select("*", *[e.column(df).alias(k) for k, e in own.items()])
    key = lambda i: F.col(f"`key.{i}`")
    keys = [key(i) for i in range(len(group))]
    if kind == "rollup":
        out = keyed.rollup(*keys).agg(*columns)
    elif kind == "cube":
        out = keyed.cube(*keys).agg(*columns)
    else:
        listed = [[key(names.index(e.name(df.columns))) for e in s] for s in sets]
        out = keyed.groupingSets(listed, *keys).agg(*columns)
    return out.select(*[k.alias(n) for k, n in zip(keys, names, strict=True)], *[F.col(f"`{e.name(df.columns)}`") for e in aggregates])


#: Partial state of each aggregate: its parts, how parts merge, and how the result comes from them.
_STATES = {
    "MIN": (lambda c: [F.min(c)], ["min"]),
    "MAX": (lambda c: [F.max(c)], ["max"]),
    "SUM": (lambda c: [F.sum(c)], ["sum"]),
    "COUNT": (lambda c: [F.count(c)], ["sum"]),
    "AVG": (lambda c: [F.sum(c.cast("double")), F.count(c)], ["sum", "sum"]),
}


def _plain(e: Expr) -> tuple[Expr, str | None]:
    return (e.args[0], e.value) if e.kind == "alias" else (e, None)


def partial_aggregate(df: DataFrame, group: list[Expr], aggregates: list[Expr]) -> DataFrame:
    """Group columns and the aggregates' states, ``<i>.<part>``; AVG's state is a sum and a count."""
    states = []
    for i, e in enumerate(aggregates):
        agg, _ = _plain(e)
        if agg.kind != "aggregate" or agg.value not in _STATES:
            raise PlanError(f"{e} has no partial state")
        inner = agg.args[0].column(df)
        if agg.args[1:]:
            inner = F.when(agg.args[1].column(df), inner)
        states += [c.alias(f"{i}.{j}") for j, c in enumerate(_STATES[agg.value][0](inner))]
    return df.groupBy(*_named(df, group)).agg(*states)


def _merged(states: DataFrame, keys: list[str], aggregates: list[Expr]) -> DataFrame:
    merge = {"min": F.min, "max": F.max, "sum": F.sum}
    columns = [merge[how](f"`{i}.{j}`").alias(f"{i}.{j}") for i, e in enumerate(aggregates) for j, how in enumerate(_STATES[_plain(e)[0].value][1])]
    return states.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(*columns)


def reduce_partials(states: DataFrame, keys: list[str], aggregates: list[Expr]) -> DataFrame:
    """States of states: a level of a reduction tree."""
    return _merged(states, keys, aggregates)


def final_aggregate(states: DataFrame, keys: list[str], aggregates: list[Expr]) -> DataFrame:
    """Results from states, named as the aggregates are."""
    merged = _merged(states, keys, aggregates)
    out = []
    for i, e in enumerate(aggregates):
        agg, alias = _plain(e)
        value = F.col(f"`{i}.0`")
        if agg.value == "AVG":
            value = F.when(F.col(f"`{i}.1`") > 0, value / F.col(f"`{i}.1`"))
        elif agg.value == "COUNT":
            value = F.coalesce(value, F.lit(0).cast("long"))
        out.append(value.alias(alias or agg.value))
    return merged.select(*[F.col(f"`{k}`") for k in keys], *out)


def in_mode(df: DataFrame, mode: AggregateMode, group: list[Expr], aggregates: list[Expr]) -> DataFrame:
    """One phase: rows to states, states to states, states to results, or rows to results.

    Whether a phase's input is dealt by key already (the Partitioned modes) is for Spark to see: it then
    adds no exchange."""
    keys = [e.name(df.columns) for e in group]
    match AggregateMode(mode):
        case AggregateMode.PARTIAL:
            return partial_aggregate(df, group, aggregates)
        case AggregateMode.PARTIAL_REDUCE:
            return reduce_partials(df, keys, aggregates)
        case AggregateMode.FINAL | AggregateMode.FINAL_PARTITIONED:
            return final_aggregate(df, keys, aggregates)
    return aggregate(df, group, aggregates)


def two_phase(df: DataFrame, group: list[Expr], aggregates: list[Expr]) -> DataFrame:
    """States by key, then results from states. Spark sums up each task's rows before the one exchange, and the
    second phase finds its input dealt by key."""
    keys = [e.name(df.columns) for e in group]
    states = partial_aggregate(df, group, aggregates)
    return final_aggregate(states, keys, aggregates)
