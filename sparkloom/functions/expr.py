"""Expressions: immutable trees that print, serialise, and compile to Spark columns.

What Spark does differently from the engine's rules is decided while compiling, so it holds in any
session: division of integers truncates, mixed numbers become double, float literals are double.
"""

from __future__ import annotations

import datetime
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SchemaError
from .types import INTEGRAL, spark_type, type_name

#: The operators by name, with their sign and precedence.
OPERATORS = {
    "eq": ("=", 20), "neq": ("!=", 20), "lt": ("<", 20), "lteq": ("<=", 20), "gt": (">", 20), "gteq": (">=", 20),
    "and": ("AND", 10), "or": ("OR", 5), "add": ("+", 30), "subtract": ("-", 30), "mult": ("*", 40), "div": ("/", 40), "mod": ("%", 40),
    "distinct": ("IS DISTINCT FROM", 20), "not_distinct": ("IS NOT DISTINCT FROM", 20),
    "like": ("LIKE", 20), "not_like": ("NOT LIKE", 20), "ilike": ("ILIKE", 20), "not_ilike": ("NOT ILIKE", 20),
    "match": ("~", 20), "imatch": ("~*", 20), "not_match": ("!~", 20), "not_imatch": ("!~*", 20),
    "bit_and": ("&", 20), "bit_or": ("|", 20), "bit_xor": ("BIT_XOR", 20), "shift_left": ("<<", 20), "shift_right": (">>", 20),
    "concat": ("||", 20), "contains": ("@>", 20), "contained": ("<@", 20),
}
COMPARISONS = ("eq", "neq", "lt", "lteq", "gt", "gteq")
NUMERICAL = ("add", "subtract", "mult", "div", "mod")
#: An operator with its sides exchanged.
SWAPPED = {"eq": "eq", "neq": "neq", "lt": "gt", "lteq": "gteq", "gt": "lt", "gteq": "lteq", "contains": "contained", "contained": "contains"}
AGGREGATES = ("MIN", "MAX", "SUM", "AVG", "COUNT", "COUNT_DISTINCT")
#: Further aggregates, by Spark's functions of these names.
MORE_AGGREGATES = {"STDDEV": "stddev_samp", "VARIANCE": "var_samp", "MEDIAN": "median", "APPROX_DISTINCT": "approx_count_distinct"}


@dataclass(frozen=True, eq=False)
class Expr:
    """One node: kind, its arguments, and what else it carries."""

    kind: str
    args: tuple[Expr, ...] = ()
    value: Any = None
    type: str | None = None

    # comparison, logic and arithmetic, as methods and as Python operators
    def _with(self, op: str, other) -> Expr:
        return Expr("binary", (self, to_expr(other)), op)

    def eq(self, other):
        return self._with("eq", other)

    def neq(self, other):
        return self._with("neq", other)

    def gt(self, other):
        return self._with("gt", other)

    def gteq(self, other):
        return self._with("gteq", other)

    def lt(self, other):
        return self._with("lt", other)

    def lteq(self, other):
        return self._with("lteq", other)

    def and_(self, other):
        return self._with("and", other)

    def or_(self, other):
        return self._with("or", other)

    def add(self, other):
        return self._with("add", other)

    def subtract(self, other):
        return self._with("subtract", other)

    def mult(self, other):
        return self._with("mult", other)

    def div(self, other):
        return self._with("div", other)

    def modulus(self, other):
        return self._with("mod", other)

    def op(self, name: str, other) -> Expr:
        """Any operator of OPERATORS by name."""
        if name not in OPERATORS:
            raise SchemaError(f"unknown operator {name}")
        return self._with(name, other)

    __eq__ = eq
    __ne__ = neq
    __gt__, __ge__, __lt__, __le__ = gt, gteq, lt, lteq
    __and__, __or__ = and_, or_
    __add__, __sub__, __mul__, __truediv__, __mod__ = add, subtract, mult, div, modulus
    __hash__ = object.__hash__

    def __radd__(self, other):
        return to_expr(other) + self

    def __rsub__(self, other):
        return to_expr(other) - self

    def __rmul__(self, other):
        return to_expr(other) * self

    def __invert__(self):
        return Expr("not", (self,))

    def __neg__(self):
        return Expr("negative", (self,))

    def __bool__(self):
        raise SchemaError("an expression has no truth value; combine with & and |")

    def like(self, pattern):
        return self._with("like", pattern)

    def ilike(self, pattern):
        return self._with("ilike", pattern)

    def is_null(self):
        return Expr("is_null", (self,))

    def is_not_null(self):
        return Expr("is_not_null", (self,))

    def is_distinct_from(self, other):
        return self._with("distinct", other)

    def is_not_distinct_from(self, other):
        return self._with("not_distinct", other)

    def between(self, low, high):
        """Whether the value is from low to high, both included."""
        return self.gteq(low).and_(self.lteq(high))

    def in_list(self, *values):
        """Whether the value equals one of the others, by three-valued logic."""
        return Expr("in", (self, *map(to_expr, values)))

    def alias(self, name: str):
        return Expr("alias", (self,), name)

    def cast(self, kind):
        return cast(self, kind)

    def try_cast(self, kind):
        return Expr("try_cast", (self,), None, type_name(kind))

    def where(self, predicate: Expr) -> Expr:
        """An aggregate over the rows that satisfy the predicate."""
        return replace(self, args=(*self.args[:1], predicate))

    def on_rows(self, mask: Expr) -> Expr:
        """The value where the mask is true, NULL elsewhere."""
        return Expr("selected", (self, mask))

    # text
    def __str__(self) -> str:
        a = [str(x) for x in self.args]
        match self.kind:
            case "column" | "index":
                return f"#{self.value}"
            case "literal":
                return literal_text(self.value)
            case "binary":
                return f"{a[0]} {OPERATORS[self.value][0]} {a[1]}"
            case "not":
                return f"NOT {a[0]}"
            case "negative":
                return f"-{a[0]}"
            case "is_null" | "is_not_null":
                return f"{a[0]} {'IS NULL' if self.kind == 'is_null' else 'IS NOT NULL'}"
            case "cast" | "try_cast":
                return f"{self.kind.upper()}({a[0]} AS {self.type})"
            case "alias":
                return f"{a[0]} as {self.value}"
            case "date_add" | "date_subtract":
                return f"{a[0]} {'+' if self.kind == 'date_add' else '-'} {a[1]}"
            case "aggregate":
                name, inner = self.value.removesuffix("_DISTINCT"), a[0]
                shown = f"{name}(DISTINCT {inner})" if self.value.endswith("_DISTINCT") else f"{name}({inner})"
                return f"{shown} FILTER (WHERE {a[1]})" if a[1:] else shown
            case "selected":
                return f"CASE WHEN {a[1]} THEN {a[0]} END"
            case "in":
                return f"{a[0]} IN ({', '.join(a[1:])})"
            case "case":
                rest = f" ELSE {a[-1]}" if len(a) % 2 else ""
                return f"CASE {' '.join(f'WHEN {w} THEN {t}' for w, t in zip(a[::2], a[1::2], strict=False))}{rest} END"
            case _:
                return f"{self.value}({', '.join(a)})"

    __repr__ = __str__

    def grouped(self) -> str:
        """Like str(), with a child in parentheses only where its operator binds looser."""
        if self.kind != "binary":
            return str(self)

        def side(x: Expr) -> str:
            loose = x.kind == "binary" and OPERATORS[x.value][1] < OPERATORS[self.value][1]
            return f"({x.grouped()})" if loose else x.grouped()

        return f"{side(self.args[0])} {OPERATORS[self.value][0]} {side(self.args[1])}"

    def name(self, columns: list[str]) -> str:
        """The output column's name where no alias is given."""
        match self.kind:
            case "column":
                return self.value
            case "index":
                return columns[self.value]
            case "binary" | "alias":
                return self.value
            case "cast" | "try_cast" | "selected":
                return self.args[0].name(columns)
            case "aggregate":
                return self.value
            case "function":
                return self.value
            case "literal":
                return literal_text(self.value)
            case _:
                return self.kind

    # serialisation
    def to_json(self) -> dict:
        value = {"date": self.value.isoformat()} if isinstance(self.value, datetime.date) else self.value
        out = {"kind": self.kind, "args": [a.to_json() for a in self.args], "value": value, "type": self.type}
        return {k: v for k, v in out.items() if v not in (None, [])} | {"kind": self.kind}

    @staticmethod
    def from_json(data: dict) -> Expr:
        value = data.get("value")
        if isinstance(value, dict):
            value = datetime.date.fromisoformat(value["date"])
        return Expr(data["kind"], tuple(Expr.from_json(a) for a in data.get("args", [])), value, data.get("type"))

    # Spark
    def column(self, df: DataFrame) -> Column:
        """The Spark column over ``df``'s rows, without alias for anything but an alias."""
        return _compile(self, df)

    def named(self, df: DataFrame) -> Column:
        return self.column(df).alias(self.name(df.columns))

    def references(self) -> set[str]:
        found = {self.value} if self.kind == "column" else set()
        return found.union(*(a.references() for a in self.args))


def literal_text(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, str):
        return f"'{value}'"
    return str(value)


def to_expr(value) -> Expr:
    return value if isinstance(value, Expr) else lit(value)


def col(name: str) -> Expr:
    return Expr("column", (), name)


def col_index(i: int) -> Expr:
    """A column by its place in the input, resolved when the frame is built."""
    return Expr("index", (), i)


def lit(value, kind: str | None = None) -> Expr:
    """A literal; ``kind`` names a type where Python's isn't enough, as for Float32."""
    return Expr("literal", (), value, kind)


def cast(e: Expr, kind) -> Expr:
    return Expr("cast", (e,), None, type_name(kind))


def date_add(date: Expr, days) -> Expr:
    return Expr("date_add", (date, to_expr(days)))


def date_subtract(date: Expr, days) -> Expr:
    return Expr("date_subtract", (date, to_expr(days)))


def function(name: str, *args) -> Expr:
    """A scalar function of Spark, or one registered with the session, by name."""
    return Expr("function", tuple(map(to_expr, args)), name)


def case(*branches: tuple, otherwise=None) -> Expr:
    """The value of the first (condition, value) whose condition is true, else ``otherwise`` or NULL."""
    args = [to_expr(x) for pair in branches for x in pair]
    return Expr("case", tuple(args if otherwise is None else [*args, to_expr(otherwise)]))


def coalesce(*values) -> Expr:
    """The first value that is not NULL."""
    return function("coalesce", *values)


def sqrt(e) -> Expr:
    return function("sqrt", e)


def log(e) -> Expr:
    """Natural logarithm: -Infinity at 0 and NaN below, as IEEE has it."""
    return function("ln", e)


def _aggregate(name: str):
    def make(e) -> Expr:
        return Expr("aggregate", (to_expr(e),), name)

    make.__name__ = name.lower()
    return make


min, max, sum, avg, count, count_distinct = map(_aggregate, AGGREGATES)  # noqa: A001
stddev, variance, median, approx_distinct = map(_aggregate, MORE_AGGREGATES)


def _known(e: Expr, df: DataFrame) -> T.DataType | None:
    """The type of an expression as far as it follows from the schema alone; None leaves it to Spark."""
    match e.kind:
        case "column" | "index":
            return df.schema[e.value].dataType
        case "literal":
            if e.type:
                return spark_type(e.type)
            kinds = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType()}
            return T.DoubleType() if isinstance(e.value, int) and not -(1 << 63) <= e.value < 1 << 63 else kinds.get(type(e.value))
        case "cast" | "try_cast":
            return spark_type(e.type)
        case "alias" | "negative" | "selected":
            return _known(e.args[0], df)
        case "not" | "is_null" | "is_not_null" | "in":
            return T.BooleanType()
        case "binary" if e.value in NUMERICAL:
            a, b = (_known(x, df) for x in e.args)
            if isinstance(a, INTEGRAL) and isinstance(b, INTEGRAL):
                return T.LongType() if e.value == "div" else max_by_width(a, b)
            if any(isinstance(x, (T.FloatType, T.DoubleType)) for x in (a, b)) and a is not None and b is not None:
                return a if a == b else T.DoubleType()
        case "binary" if e.value in COMPARISONS or e.value in ("and", "or", "distinct", "not_distinct"):
            return T.BooleanType()
    return None


def max_by_width(a: T.DataType, b: T.DataType) -> T.DataType:
    return a if INTEGRAL.index(type(a)) >= INTEGRAL.index(type(b)) else b


def dtype(df: DataFrame, column: Column, e: Expr | None = None) -> T.DataType:
    known = _known(e, df) if e is not None else None
    return known if known is not None else df.select(column).schema[0].dataType


def _compile(e: Expr, df: DataFrame) -> Column:
    match e.kind:
        case "column":
            if e.value not in df.columns:
                raise SchemaError(f"no column named {e.value!r} among {df.columns}")
            return F.col(f"`{e.value}`")
        case "index":
            if not 0 <= e.value < len(df.columns):
                raise SchemaError(f"no column {e.value} among {len(df.columns)}")
            return F.col(f"`{df.columns[e.value]}`")
        case "literal":
            return _literal(e)
        case "alias":
            return _compile(e.args[0], df).alias(e.value)
        case "aggregate":
            return _aggregated(e, df)
    a = [_compile(x, df) for x in e.args]
    match e.kind:
        case "binary":
            return _binary(e.value, *a, df, *e.args)
        case "not":
            return ~a[0]
        case "negative":
            return -a[0]
        case "is_null":
            return a[0].isNull()
        case "is_not_null":
            return a[0].isNotNull()
        case "cast":
            return a[0].cast(spark_type(e.type))
        case "try_cast":
            return a[0].try_cast(spark_type(e.type))
        case "date_add":
            return F.date_add(a[0], a[1].cast("int"))
        case "date_subtract":
            return F.date_sub(a[0], a[1].cast("int"))
        case "selected":
            return F.when(a[1], a[0])
        case "in":
            return a[0].isin(*a[1:])
        case "case":
            out = F.when(a[0], a[1])
            for when, then in zip(a[2::2], a[3::2], strict=False):
                out = out.when(when, then)
            return out.otherwise(a[-1]) if len(a) % 2 else out
        case "function":
            if e.value in ("ln", "log"):
                x = a[0].cast("double")
                return F.when(x > 0, F.ln(x)).when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan"))).otherwise(F.when(x.isNull(), None).otherwise(x))
            return F.call_function(e.value, *a)
    raise SchemaError(f"unknown expression {e.kind}")


def _literal(e: Expr) -> Column:
    v = e.value
    if e.type:
        return F.lit(v).cast(spark_type(e.type))
    if isinstance(v, bool) or v is None or isinstance(v, (str, datetime.date)):
        return F.lit(v)
    if isinstance(v, int):
        return F.lit(v).cast("long") if -(1 << 63) <= v < 1 << 63 else F.lit(float(v))
    return F.lit(float(v))


def _truth(c: Column, df: DataFrame, e: Expr) -> Column:
    """An integer operand of AND and OR is true where it is 1."""
    return (c == 1) if isinstance(dtype(df, c, e), INTEGRAL) else c


def _binary(op: str, a: Column, b: Column, df: DataFrame, left: Expr, right: Expr) -> Column:
    match op:
        case "and":
            return _truth(a, df, left) & _truth(b, df, right)
        case "or":
            return _truth(a, df, left) | _truth(b, df, right)
        case "eq":
            return a == b
        case "neq":
            return a != b
        case "lt":
            return a < b
        case "lteq":
            return a <= b
        case "gt":
            return a > b
        case "gteq":
            return a >= b
        case "add" | "subtract" | "mult" | "div" | "mod":
            return _arithmetic(op, a, b, dtype(df, a, left), dtype(df, b, right))
        case "distinct":
            return ~a.eqNullSafe(b)
        case "not_distinct":
            return a.eqNullSafe(b)
        case "like" | "ilike" | "not_like" | "not_ilike":
            found = F.ilike(a, b) if op.endswith("ilike") else F.like(a, b)
            return ~found if op.startswith("not") else found
        case "match" | "imatch" | "not_match" | "not_imatch":
            found = F.rlike(a, F.concat(F.lit("(?i)"), b) if op.endswith("imatch") else b)
            return ~found if op.startswith("not") else found
        case "bit_and":
            return a.bitwiseAND(b)
        case "bit_or":
            return a.bitwiseOR(b)
        case "bit_xor":
            return a.bitwiseXOR(b)
        case "shift_left":
            return F.call_function("shiftleft", a, b.cast("int"))
        case "shift_right":
            return F.call_function("shiftright", a, b.cast("int"))
        case "concat":
            return F.concat(a, b)
        case "contains" | "contained":
            whole, part = (a, b) if op == "contains" else (b, a)
            return F.size(F.array_except(part, whole)) == 0
    raise SchemaError(f"unknown operator {op}")


def _arithmetic(op: str, a: Column, b: Column, left: T.DataType, right: T.DataType) -> Column:
    dates = (T.DateType, T.TimestampType, T.TimestampNTZType, T.DayTimeIntervalType, T.YearMonthIntervalType)
    if not isinstance(left, dates) and not isinstance(right, dates):
        whole = isinstance(left, INTEGRAL) and isinstance(right, INTEGRAL)
        if not whole and left != right:
            a, b = a.cast("double"), b.cast("double")
        if op == "div" and whole:
            return F.call_function("div", a, b)
    return {"add": a.__add__, "subtract": a.__sub__, "mult": a.__mul__, "div": a.__truediv__, "mod": a.__mod__}[op](b)


def _aggregated(e: Expr, df: DataFrame) -> Column:
    inner = _compile(e.args[0], df)
    if e.args[1:]:
        inner = F.when(_compile(e.args[1], df), inner)
    match e.value:
        case "MIN":
            return F.min(inner)
        case "MAX":
            return F.max(inner)
        case "SUM":
            return F.sum(inner)
        case "AVG":
            return F.avg(inner.cast("double"))
        case "COUNT":
            return F.count(inner)
        case "COUNT_DISTINCT":
            return F.count_distinct(inner)
        case name if name in MORE_AGGREGATES:
            return F.call_function(MORE_AGGREGATES[name], inner)
    raise SchemaError(f"unknown aggregate {e.value}")
