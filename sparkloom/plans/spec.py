"""What a frame was built from: nodes that print as a tree, serialise to JSON, and build the frame again."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

from ..functions.expr import Expr


@dataclass(frozen=True)
class Node:
    """One step: its name, its parameters (expressions, or plain JSON values), and its inputs."""

    op: str
    params: dict[str, Any] = field(default_factory=dict)
    inputs: tuple[Node, ...] = ()

    def line(self) -> str:
        p = self.params
        show = lambda key: ", ".join(map(str, p[key]))
        match self.op:
            case "scan":
                return f"TableScan: {p['name']}; projection=None"
            case "project":
                return f"Projection: {show('exprs')}"
            case "filter":
                return f"Filter: {p['predicate']}"
            case "aggregate":
                return f"Aggregate: groupExpr=[{show('group')}], aggregateExpr=[{show('aggregates')}]"
            case "join":
                return f"Join: type={p['how']}, on=[{', '.join(f'{a} = {b}' for a, b in p['on'])}]"
            case "limit":
                return f"Limit: {p['n']}"
            case "sort":
                return f"Sort: {', '.join(f'{e} {d} NULLS {n}' for e, d, n in p['keys'])}"
        rest = ", ".join(f"{k}={v}" for k, v in p.items())
        return f"{self.op.title().replace('_', '')}: {rest}" if rest else self.op.title().replace("_", "")

    def pretty(self, depth: int = 0) -> str:
        """One line for each node, indented by tabs."""
        return "\t" * depth + self.line() + "\n" + "".join(x.pretty(depth + 1) for x in self.inputs)

    def walk(self) -> Iterator[Node]:
        yield self
        for x in self.inputs:
            yield from x.walk()

    def accept(self, before: Callable[[Node], bool | None], after: Callable[[Node], None] | None = None) -> bool:
        """Visit the tree; a visit that returns False ends it."""
        if before(self) is False or not all(x.accept(before, after) for x in self.inputs):
            return False
        if after:
            after(self)
        return True

    def to_json(self) -> str:
        return json.dumps(_out(self), ensure_ascii=False, sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Node:
        return _in(json.loads(text))


def _out(x):
    if isinstance(x, Expr):
        return {"$expr": x.to_json()}
    if isinstance(x, Node):
        return {"$node": {"op": x.op, "params": _out(x.params), "inputs": [_out(i) for i in x.inputs]}}
    if isinstance(x, dict):
        return {k: _out(v) for k, v in x.items()}
    return [_out(v) for v in x] if isinstance(x, (list, tuple)) else x


def _in(x):
    if isinstance(x, dict):
        if "$expr" in x:
            return Expr.from_json(x["$expr"])
        if "$node" in x:
            n = x["$node"]
            return Node(n["op"], _in(n["params"]), tuple(_in(i) for i in n["inputs"]))
        return {k: _in(v) for k, v in x.items()}
    return [_in(v) for v in x] if isinstance(x, list) else x
