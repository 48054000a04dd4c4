"""A PySpark-native analytics engine: tables, frames and SQL over Spark's DataFrames."""

from __future__ import annotations

import importlib

_WHERE = {
    "sparkloom.session": ("EngineSession", "SessionBuilder"),
    "sparkloom.frame": ("Frame",),
    "sparkloom.functions.expr": ("Expr", "col", "col_index", "lit", "cast", "min", "max", "sum", "avg", "count", "count_distinct", "date_add", "date_subtract", "sqrt", "log", "function", "case", "coalesce", "stddev", "variance", "median", "approx_distinct"),
    "sparkloom.operators.sorting": ("asc", "desc"),
    "sparkloom.operators.joins": ("JoinType", "NullEquality", "PartitionMode"),
    "sparkloom.operators.aggregates": ("AggregateMode",),
    "sparkloom.operators.partitioning": ("Partitioning",),
    "sparkloom.sources.custom": ("TableProvider",),
    "sparkloom.remote": ("DistributedConfig", "ExecutorConfig", "Endpoint", "connect", "start_server"),
    "sparkloom.errors": ("EngineError", "PlanError", "NotImplementedInEngine", "SchemaError", "IoError"),
}
_HOME = {name: module for module, names in _WHERE.items() for name in names}
__all__ = sorted(_HOME)  # noqa: PLE0605


def __getattr__(name: str):
    """Names are imported when they are first used, so that executors import only what they run."""
    if name not in _HOME:
        raise AttributeError(name)
    return getattr(importlib.import_module(_HOME[name]), name)
