"""Frames: lazy DataFrames that remember how they were built."""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .functions.expr import Expr, to_expr
from .operators import aggregates as A
from .operators import joins as J
from .operators import partitioning as P
from .operators import sets as S
from .operators import sorting as O
from .plans.explain import displayable
from .plans.spec import Node
from .sources.files import to_csv

if TYPE_CHECKING:
    from .session import EngineSession


class Frame:
    """A query over the session's tables. Each method returns a new frame; nothing runs before an action.

    Names are resolved while the frame is built. ``spec`` is what ``pretty`` prints and what can be
    sent elsewhere; ``df`` is what runs.
    """

    def __init__(self, session: EngineSession, df: DataFrame, spec: Node):
        self.session, self.df, self.spec = session, df, spec

    def _next(self, df: DataFrame, op: str, *others: Frame, **params) -> Frame:
        return Frame(self.session, df, Node(op, params, (self.spec, *(o.spec for o in others))))

    # relational operators
    def project(self, exprs: list) -> Frame:
        exprs = [to_expr(e) for e in exprs]
        return self._next(self.df.select(*[e.named(self.df) for e in exprs]), "project", exprs=exprs)

    def filter(self, predicate: Expr) -> Frame:
        """The rows for which the predicate is true; all columns stay."""
        return self._next(self.df.where(predicate.column(self.df)), "filter", predicate=predicate)

    def aggregate(self, group: list, aggregates: list) -> Frame:
        return self._next(A.aggregate(self.df, group, aggregates), "aggregate", group=group, aggregates=aggregates)

    def aggregate_phase(self, mode: A.AggregateMode, group: list, aggregates: list) -> Frame:
        """One phase of an aggregation; phases after the first read the states of the one before."""
        mode = A.AggregateMode(mode).value
        return self._next(A.in_mode(self.df, mode, group, aggregates), "aggregate_phase", mode=mode, group=group, aggregates=aggregates)

    def grouping_sets(self, sets: list[list[Expr]], group: list[Expr], aggregates: list[Expr]) -> Frame:
        return self._next(A.grouping_sets(self.df, sets, group, aggregates), "grouping_sets", sets=sets, group=group, aggregates=aggregates)

    def rollup(self, group: list[Expr], aggregates: list[Expr]) -> Frame:
        return self._next(A.grouping_sets(self.df, [], group, aggregates, "rollup"), "rollup", group=group, aggregates=aggregates)

    def cube(self, group: list[Expr], aggregates: list[Expr]) -> Frame:
        return self._next(A.grouping_sets(self.df, [], group, aggregates, "cube"), "cube", group=group, aggregates=aggregates)

    def two_phase(self, group: list[Expr], aggregates: list[Expr]) -> Frame:
        return self._next(A.two_phase(self.df, group, aggregates), "two_phase", group=group, aggregates=aggregates)

    def join(self, right: Frame, how="Inner", on: list[tuple[str, str]] = (), nulls="NullEqualsNothing", residual=None, mode="Auto") -> Frame:
        """``residual`` is an expression over columns named left.<name> and right.<name>, or a function from
        the column lookups of both sides to a Spark condition; a frame with a function can't be serialised."""
        how, nulls, mode = J.JoinType(how).value, J.NullEquality(nulls).value, J.PartitionMode(mode).value
        df = J.join(self.df, right.df, list(on), how, nulls, residual, mode)
        more = {"residual": residual if isinstance(residual, Expr) else True} if residual is not None else {}
        return self._next(df, "join", right, how=how, on=[list(p) for p in on], nulls=nulls, mode=mode, **more)

    def sort(self, keys: list) -> Frame:
        return self._next(O.sort(self.df, keys), "sort", keys=[list(O.as_key(k).parts()) for k in keys])

    def top_k(self, keys: list, k: int) -> Frame:
        return self.sort(keys).limit(k)

    def sort_within_partitions(self, keys: list) -> Frame:
        return self._next(O.sort_within_partitions(self.df, keys), "sort_within_partitions", keys=[list(O.as_key(k).parts()) for k in keys])

    def limit(self, n: int) -> Frame:
        return self._next(O.limit(self.df, n), "limit", n=n)

    def offset(self, skip: int) -> Frame:
        return self._next(self.df.offset(skip), "offset", skip=skip)

    def local_limit(self, n: int) -> Frame:
        return self._next(O.local_limit(self.df, n), "local_limit", n=n)

    def distinct(self) -> Frame:
        return self._next(self.df.distinct(), "distinct")

    def union(self, other: Frame, distinct: bool = False) -> Frame:
        return self._next(S.union(self.df, other.df, distinct), "union", other, distinct=distinct)

    def intersect(self, other: Frame, keep_repeats: bool = False) -> Frame:
        return self._next(S.intersect(self.df, other.df, keep_repeats), "intersect", other, keep_repeats=keep_repeats)

    def except_(self, other: Frame, keep_repeats: bool = False) -> Frame:
        return self._next(S.except_(self.df, other.df, keep_repeats), "except_", other, keep_repeats=keep_repeats)

    def repartition(self, n: int, keys: list[Expr] = ()) -> Frame:
        how = P.hashed(list(keys), n) if keys else P.round_robin(n)
        return self._next(P.repartition(self.df, how), "repartition", n=n, keys=list(keys))

    # introspection
    @property
    def schema(self) -> T.StructType:
        return self.df.schema

    def logical_plan(self) -> Node:
        return self.spec

    def pretty(self) -> str:
        return self.spec.pretty()

    def to_json(self) -> str:
        if any(n.params.get("residual") is True for n in self.spec.walk()):
            raise ValueError("a join with a function as its residual condition can't be serialised")
        return self.spec.to_json()

    def explain(self, format: str = "indent") -> str:  # noqa: A002
        shown = displayable(self.df)
        return {"indent": shown.indent, "verbose": lambda: shown.indent(True), "one_line": shown.one_line, "tree": shown.tree_render, "graphviz": shown.graphviz, "metrics": lambda: shown.indent(metrics=True)}[format]()

    # actions
    def collect(self) -> list[tuple]:
        return [tuple(r) for r in self.df.collect()]

    def batches(self, rows: int = 1024) -> Iterator[pa.RecordBatch]:
        """The result as Arrow batches of ``rows`` rows at most, fetched a partition at a time.

        Batches are packed on the executors and come as they are, never as rows."""
        kind = self.session.arrow_schema(self.df)

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(0, batch.num_rows, rows):
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, batch.schema) as out:
                        out.write_batch(batch.slice(i, rows))
                    yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["batch"])

        for row in self.df.mapInArrow(packed, "batch binary").toLocalIterator():
            yield from pa.ipc.open_stream(bytes(row[0])).read_all().cast(kind).to_batches()

    def to_csv(self) -> str:
        return to_csv(self.df)

    def count(self) -> int:
        return self.df.count()


def build(session: EngineSession, node: Node) -> Frame:
    """The frame that a specification describes, over the session's tables."""
    if node.op == "scan":
        return session.table(node.params["name"])
    if node.op == "sql":
        return session.sql(node.params["text"])
    frames = [build(session, n) for n in node.inputs]
    p = dict(node.params)
    if node.op in ("sort", "sort_within_partitions"):
        p["keys"] = [O.SortKey(e, d == "ASC", n == "FIRST") for e, d, n in p["keys"]]
    if node.op == "join":
        p["on"] = [tuple(x) for x in p["on"]]
    return getattr(frames[0], node.op)(*frames[1:], **p)
