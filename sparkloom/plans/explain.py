"""Texts of Spark's physical plans: indented, one line, boxes, Graphviz, and rows."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

#: Inner width of a box, most lines of details, and total width.
BOX, DETAILS, TOTAL = 29, 30, 240


@dataclass
class PlanNode:
    name: str
    details: str = ""
    schema: str = ""
    metrics: dict[str, int] = field(default_factory=dict)
    children: list[PlanNode] = field(default_factory=list)

    def accept(self, visit: Callable[[PlanNode], bool | None]) -> bool:
        return visit(self) is not False and all(c.accept(visit) for c in self.children)


def physical(df: DataFrame) -> PlanNode:
    """The plan that would run, or after an action the one that ran, with its counters."""
    plan = df._jdf.queryExecution().executedPlan()

    def items(seq):
        return [seq.apply(i) for i in range(seq.length())]

    def node(p) -> PlanNode:
        kind = p.nodeName()
        if kind == "AdaptiveSparkPlan":
            return node(p.executedPlan())
        children = [p.plan()] if hasattr(p, "plan") and "QueryStage" in p.getClass().getSimpleName() else items(p.children())
        text = re.sub(r"#\d+L?", "", p.simpleString(100))
        metrics, it = {}, p.metrics().iterator()
        while it.hasNext():
            entry = it.next()
            metrics[entry._1()] = entry._2().value()
        details = text[len(kind) :].strip() if text.startswith(kind) else text
        return PlanNode(kind, details, p.schema().catalogString(), metrics, [node(c) for c in children])

    return node(plan)


class Displayable:
    """Ways to show a plan."""

    def __init__(self, root: PlanNode):
        self.root = root

    def _line(self, n: PlanNode, verbose: bool, metrics: bool) -> str:
        out = f"{n.name}: {n.details}" if n.details else n.name
        if metrics:
            out += f", metrics=[{', '.join(f'{k}={v}' for k, v in sorted(n.metrics.items()) if v)}]"
        return out + (f", schema={n.schema}" if verbose else "")

    def indent(self, verbose: bool = False, metrics: bool = False) -> str:
        """Two spaces for each level, one line for each node."""

        def lines(n, depth):
            yield "  " * depth + self._line(n, verbose, metrics) + "\n"
            for c in n.children:
                yield from lines(c, depth + 1)

        return "".join(lines(self.root, 0))

    def one_line(self) -> str:
        return self._line(self.root, False, False) + "\n"

    def graphviz(self) -> str:
        """Numbered nodes and edges from parent to child."""
        nodes, edges = [], []

        def visit(n, parent):
            i = len(nodes) + 1
            label = self._line(n, False, False).replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")
            nodes.append(f'    {i}[shape=box label="{label}"]\n')
            if parent:
                edges.append(f"    {parent} -> {i} [arrowhead=none, arrowtail=normal, dir=back]\n")
            for c in n.children:
                visit(c, i)

        visit(self.root, 0)
        return "digraph {\n" + "".join(nodes) + "".join(edges) + "}\n"

    def rows(self) -> list[tuple[str, str]]:
        """(plan type, text), as EXPLAIN lists them."""
        return [("physical_plan", self.indent()), ("physical_plan_with_schema", self.indent(verbose=True))]

    def tree_render(self) -> str:
        """A box for each node, children below their parents."""
        grid: list[dict[int, tuple[PlanNode, list[int]]]] = []

        def place(n: PlanNode, x: int, y: int) -> int:
            while len(grid) <= y:
                grid.append({})
            at, width = [], 0
            for c in n.children:
                at.append(x + width)
                width += place(c, x + width, y + 1)
            grid[y][x] = (n, at)
            return max(width, 1)

        columns = min(place(self.root, 0, 0), max(1, TOTAL // BOX))
        parents = [set(), *({x for _, at in level.values() for x in at} for level in grid)]
        out = []
        for y, level in enumerate(grid):
            bodies = {x: _body(n) for x, (n, _) in level.items()}
            height = max(len(b) for b in bodies.values())
            rows = [""] * (height + 2)
            for x in range(columns):
                if x not in level:
                    rows = [r + " " * BOX for r in rows]
                    continue
                half = (BOX - 3) // 2
                top = "┴" if x in parents[y] else "─"
                low = "┬" if level[x][1] else "─"
                lines = bodies[x] + [""] * (height - len(bodies[x]))
                rows[0] += "┌" + "─" * half + top + "─" * (BOX - 3 - half) + "┐"
                for i, text in enumerate(lines, 1):
                    rows[i] += "│" + text.center(BOX - 2) + "│"
                rows[-1] += "└" + "─" * half + low + "─" * (BOX - 3 - half) + "┘"
            out += [r.rstrip() for r in rows]
        return "\n".join(out) + "\n"


def _body(n: PlanNode) -> list[str]:
    lines = [n.name[: BOX - 2]]
    if n.details:
        lines.append("-" * (BOX - 9))
        lines += [n.details[i : i + BOX - 4] for i in range(0, len(n.details), BOX - 4)][:DETAILS]
    return lines


def displayable(df: DataFrame) -> Displayable:
    return Displayable(physical(df))
