"""Metrics: kinds, merging across partitions, text, and collection from Spark."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

#: The order in which kinds are shown.
ORDER = ("output_rows", "elapsed_compute", "output_bytes", "output_batches", "pruning", "spills", "memory", "count", "gauge", "time", "ratio", "timestamp", "custom")


def size_text(n: int) -> str:
    """A number of bytes; a unit is used from two of it on."""
    for unit, name in ((1 << 40, "TB"), (1 << 30, "GB"), (1 << 20, "MB"), (1 << 10, "KB")):
        if n >= 2 * unit:
            return f"{n / unit:.1f} {name}"
    return f"{n:.1f} B"


def count_text(n: int) -> str:
    for unit, name in ((10**12, "T"), (10**9, "B"), (10**6, "M"), (10**3, "K")):
        if n >= unit:
            x = n / unit
            return f"{x:.1f} {name}" if x >= 100 else f"{x:.2f} {name}"
    return str(n)


def time_text(ns: int) -> str:
    if ns == 0:
        return "NOT RECORDED"
    for unit, name in ((10**9, "s"), (10**6, "ms"), (10**3, "µs")):
        if ns >= unit:
            return f"{ns / unit:.2f}{name}"
    return f"{ns}ns"


def ratio_text(part: int, total: int) -> str:
    return f"{round(10_000 * part / total) / 100:g}% ({part}/{total})" if total else f"N/A ({part}/{total})"


def pruning_text(total: int, matched: int, fully: int = 0) -> str:
    return f"{total} total → {matched} matched" + (f" -> {fully} fully matched" if fully else "")


@dataclass(frozen=True)
class Metric:
    """A named value of one partition, or of all if partition is None."""

    name: str
    kind: str
    value: object
    partition: int | None = None
    labels: tuple[tuple[str, str], ...] = ()
    category: str = "Uncategorized"

    def text(self) -> str:
        v = self.value
        match self.kind:
            case "time" | "elapsed_compute":
                return time_text(v)
            case "memory" | "output_bytes":
                return size_text(v)
            case "ratio":
                return ratio_text(*v)
            case "pruning":
                return pruning_text(*v)
            case "timestamp" | "custom":
                return str(v)
        return count_text(v)

    def __str__(self) -> str:
        inside = [f"partition={self.partition}"] * (self.partition is not None) + [f"{k}={v}" for k, v in self.labels]
        return f"{self.name}{{{', '.join(inside)}}}={self.text()}" if inside else f"{self.name}={self.text()}"


def _merge(a: Metric, b: Metric) -> Metric:
    if a.kind != b.kind:
        raise TypeError(f"{a.name} is {a.kind} and {b.kind}")
    if a.kind == "timestamp":
        value = (min if a.name.startswith("start") else max)(a.value, b.value)
    elif isinstance(a.value, tuple):
        value = tuple(x + y for x, y in zip(a.value, b.value, strict=True))
    else:
        value = a.value + b.value
    return Metric(a.name, a.kind, value, None, (), a.category)


@dataclass
class MetricsSet:
    metrics: list[Metric] = field(default_factory=list)

    def add(self, *metrics: Metric) -> MetricsSet:
        self.metrics.extend(metrics)
        return self

    def aggregate(self) -> MetricsSet:
        """One metric for each name over all partitions and labels: counts and times add up, start
        timestamps take the least, end timestamps the greatest."""
        by: dict[str, Metric] = {}
        for m in self.metrics:
            plain = Metric(m.name, m.kind, m.value, None, (), m.category)
            by[m.name] = _merge(by[m.name], plain) if m.name in by else plain
        return MetricsSet(list(by.values()))

    def ordered(self) -> MetricsSet:
        place = lambda m: (ORDER.index(m.name) if m.name in ORDER else ORDER.index(m.kind), m.name)
        return MetricsSet(sorted(self.metrics, key=place))

    def without_timestamps(self) -> MetricsSet:
        return MetricsSet([m for m in self.metrics if m.kind != "timestamp"])

    def only(self, categories: list[str]) -> MetricsSet:
        """Those of the categories; none of an empty list."""
        return MetricsSet([m for m in self.metrics if m.category in categories])

    def sum(self, name: str):
        found = [m for m in self.metrics if m.name == name]
        total = MetricsSet(found).aggregate().metrics
        return total[0].value if total else None

    def __str__(self) -> str:
        return ", ".join(map(str, self.metrics))


def skew(rows: list[int]) -> float | None:
    """0 for rows spread evenly over the partitions, 1 for all in one; None without rows."""
    total, squares, n = sum(rows), sum(x * x for x in rows), len(rows)
    if not total:
        return None
    if n == 1:
        return 0.0
    return (1 - total * total / squares / n) / (1 - 1 / n)


def observed(df: DataFrame, name: str = "observed") -> tuple[DataFrame, Callable[[], MetricsSet]]:
    """The frame with its rows counted as they pass, and what they were once an action ran."""
    seen = Observation(name)

    def read() -> MetricsSet:
        return MetricsSet([Metric("output_rows", "output_rows", seen.get["rows"], None, (), "Rows")])

    return df.observe(seen, F.count(F.lit(1)).alias("rows")), read


def plan_metrics(df: DataFrame) -> MetricsSet:
    """Counters of the physical operators, after an action on this very frame."""
    from .explain import physical

    out = MetricsSet()

    def visit(n):
        kinds = {"numOutputRows": ("output_rows", "output_rows"), "spillSize": ("spilled_bytes", "memory"), "dataSize": ("output_bytes", "output_bytes")}
        for key, value in n.metrics.items():
            name, kind = kinds.get(key, (key, "time" if key.endswith("Time") else "count"))
            out.add(Metric(name, kind, value * 10**6 if kind == "time" else value, None, (("operator", n.name),)))

    physical(df).accept(visit)
    return out


def estimated_bytes(df: DataFrame) -> int:
    """Spark's estimate of the result's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
