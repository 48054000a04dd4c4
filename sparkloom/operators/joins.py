"""Equi-joins by pairs of names, with the layout, null and residual rules of the engine."""

from __future__ import annotations

from dataclasses import replace
from enum import Enum
from functools import reduce

from pyspark.errors import PySparkAttributeError
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import PlanError, SchemaError
from ..functions.expr import Expr


class JoinType(str, Enum):
    INNER = "Inner"
    LEFT = "Left"
    RIGHT = "Right"
    FULL = "Full"
    LEFT_SEMI = "LeftSemi"
    RIGHT_SEMI = "RightSemi"
    LEFT_ANTI = "LeftAnti"
    RIGHT_ANTI = "RightAnti"
    LEFT_MARK = "LeftMark"
    RIGHT_MARK = "RightMark"
    CROSS = "Cross"


class NullEquality(str, Enum):
    NULL_EQUALS_NOTHING = "NullEqualsNothing"
    NULL_EQUALS_NULL = "NullEqualsNull"


class PartitionMode(str, Enum):
    """How the sides are dealt out; AUTO leaves it to Catalyst and adaptive execution."""

    PARTITIONED = "Partitioned"
    COLLECT_LEFT = "CollectLeft"
    AUTO = "Auto"


#: Side that CollectLeft may send to all executors, in bytes by Spark's estimate; larger ones are shuffled.
COLLECT_BYTES = 64 << 20


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(prefix + c) for c in df.columns])


def join(
    left: DataFrame,
    right: DataFrame,
    on: list[tuple[str, str]],
    how: JoinType = JoinType.INNER,
    nulls: NullEquality = NullEquality.NULL_EQUALS_NOTHING,
    residual=None,
    mode: PartitionMode = PartitionMode.AUTO,
) -> DataFrame:
    """Join on pairs of column names.

    A pair of one name on both sides gives one column: the left's copy, for Right joins the right's
    (the layout is then the left without it, then the right), for Full joins whichever is there.
    ``residual`` is a further condition: an expression over columns named ``left.<name>`` and
    ``right.<name>``, or a function from the two sides' column lookups. Mark joins add a boolean ``mark``
    that is never null.
    """
    how, nulls, mode = JoinType(how), NullEquality(nulls), PartitionMode(mode)
    for names, df, side in (([a for a, _ in on], left, "left"), ([b for _, b in on], right, "right")):
        if missing := [n for n in names if n not in df.columns]:
            raise SchemaError(f"the {side} side has no column {missing[0]!r}")
    if (how == JoinType.CROSS) != (not on):
        raise PlanError("a cross join has no keys, and every other join has")
    if how in (JoinType.RIGHT_SEMI, JoinType.RIGHT_ANTI, JoinType.RIGHT_MARK):
        turned = {JoinType.RIGHT_SEMI: JoinType.LEFT_SEMI, JoinType.RIGHT_ANTI: JoinType.LEFT_ANTI, JoinType.RIGHT_MARK: JoinType.LEFT_MARK}[how]
        swapped = _turned(residual) if residual is None or isinstance(residual, Expr) else lambda a, b: residual(b, a)
        return join(right, left, [(b, a) for a, b in on], turned, nulls, swapped, mode)
    a, b = _prefixed(left, "left."), _prefixed(right, "right.")
    at = lambda side: lambda name: F.col(f"`{side}.{name}`")
    lc, rc = at("left"), at("right")
    if isinstance(residual, Expr):
        further = residual.column(a.crossJoin(b))
        residual = lambda *_: further
    equal = [lc(x).eqNullSafe(rc(y)) if nulls == NullEquality.NULL_EQUALS_NULL else lc(x) == rc(y) for x, y in on]
    condition = [*equal, *([residual(lc, rc)] if residual is not None else [])]
    a, b = _dealt(a, b, mode)
    shared = {x for x, y in on if x == y}
    lefts = [lc(c).alias(c) for c in left.columns]
    if how in (JoinType.LEFT_SEMI, JoinType.LEFT_ANTI):
        return a.join(b, reduce(lambda x, y: x & y, condition), "left_semi" if how == JoinType.LEFT_SEMI else "left_anti").select(*lefts)
    if how == JoinType.LEFT_MARK:
        if residual is not None:
            every = reduce(lambda x, y: x & y, condition)
            met = [a.join(b, every, how).withColumn("mark", F.lit(mark)) for how, mark in (("left_semi", True), ("left_anti", False))]
            return met[0].union(met[1]).select(*lefts, "mark")
        keys = b.select(*[rc(y) for _, y in on]).distinct().withColumn("right.mark", F.lit(True))
        return a.join(keys, reduce(lambda x, y: x & y, equal), "left").select(*lefts, F.coalesce(F.col("`right.mark`"), F.lit(False)).alias("mark"))
    if how == JoinType.CROSS:
        joined = a.crossJoin(b)
        return (joined.where(residual(lc, rc)) if residual is not None else joined).select(*lefts, *[rc(c).alias(c) for c in right.columns])
    joined = a.join(b, reduce(lambda x, y: x & y, condition), {"Inner": "inner", "Left": "left", "Right": "right", "Full": "full"}[how.value])
    if how == JoinType.RIGHT:
        return joined.select(*[lc(c).alias(c) for c in left.columns if c not in shared], *[rc(c).alias(c) for c in right.columns])
    if how == JoinType.FULL:
        lefts = [F.coalesce(lc(c), rc(c)).alias(c) if c in shared else lc(c).alias(c) for c in left.columns]
    return joined.select(*lefts, *[rc(c).alias(c) for c in right.columns if c not in shared])


def _turned(residual: Expr | None) -> Expr | None:
    """The condition with the sides exchanged."""
    if residual is None:
        return None
    if residual.kind == "column":
        side, _, name = residual.value.partition(".")
        return replace(residual, value=f"{'right' if side == 'left' else 'left'}.{name}")
    return replace(residual, args=tuple(map(_turned, residual.args)))


def _dealt(a: DataFrame, b: DataFrame, mode: PartitionMode) -> tuple[DataFrame, DataFrame]:
    if mode == PartitionMode.PARTITIONED:
        return a.hint("merge"), b  # both sides are dealt by key; sorted runs spill, whichever side is large
    if mode == PartitionMode.COLLECT_LEFT:
        try:
            size = int(str(a._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        except (AttributeError, PySparkAttributeError):  # a remote session gives no estimate: nothing is broadcast on request
            return a, b
        return (F.broadcast(a) if size <= COLLECT_BYTES else a), b
    return a, b
