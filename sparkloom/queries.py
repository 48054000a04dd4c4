"""One query for each relational operator and function, with the SQL that gives the same rows."""

from __future__ import annotations

import datetime
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .frame import Frame
from .functions.expr import Expr, avg, case, cast, coalesce, col, col_index, count, count_distinct, date_add, date_subtract, function, lit, log, median, sqrt, stddev, variance
from .functions.expr import max as max_
from .functions.expr import min as min_
from .functions.expr import sum as sum_
from .operators.sorting import asc, desc
from .session import EngineSession
from .sources.custom import TableProvider

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder, each opened when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.session, self.dir = EngineSession(spark=spark), sf_dir

    def __getattr__(self, name: str) -> Frame:
        return self.session.parquet(f"{self.dir}/{name}.parquet")

    def sql(self, text: str, *names: str) -> Frame:
        for name in names:
            self.session.register(name, getattr(self, name))
        return self.session.sql(text)


def query(sql: str):
    """Registers a function of the tables with the SQL of the same result."""

    def add(fn: Callable[[Tables], Frame]):
        _QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Tables(spark, sf_dir)).df
        _SQL[fn.__name__] = " ".join(sql.split())
        return fn

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _round(e: Expr, digits: int = 2) -> Expr:
    return function("round", e, function("int", lit(digits)))


def rounded(frame: Frame, **columns: int) -> Frame:
    """Sums of doubles rounded, as the order of addition isn't fixed."""
    return frame.project([_round(col(c), columns[c]).alias(c) if c in columns else col(c) for c in frame.df.columns])


# scans, projections, predicates
@query("SELECT o_orderkey, o_totalprice FROM orders")
def scan_projection(t):
    return t.orders.project([col("o_orderkey"), col("o_totalprice")])


@query("SELECT * FROM nation")
def select_star(t):
    return t.sql("SELECT * FROM nation", "nation")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal >= 5000 AND c_nationkey <> 3 AND c_mktsegment < 'C'")
def filter_compare(t):
    return t.customer.filter(col("c_acctbal").gteq(5000.0) & col("c_nationkey").neq(3) & col("c_mktsegment").lt("C")).project([col("c_custkey"), col("c_acctbal")])


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity < 5 OR l_quantity > 45) AND l_discount = 0.05")
def filter_and_or(t):
    return t.lineitem.filter((col("l_quantity").lt(5.0) | col("l_quantity").gt(45.0)) & col("l_discount").eq(0.05)).project([col("l_orderkey"), col("l_linenumber")])


_KLEENE = "CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 3 = 1 END"


@query(f"SELECT event_id, ({_KLEENE}) AND value > 50 AS both_true, ({_KLEENE}) OR value > 50 AS either FROM events")
def kleene_null_logic(t):
    a = col("event_id").modulus(3).eq(1).on_rows(col("event_id").modulus(3).neq(0))
    return t.events.project([col("event_id"), (a & col("value").gt(50.0)).alias("both_true"), (a | col("value").gt(50.0)).alias("either")])


@query("SELECT o_orderkey, o_totalprice * 2 AS doubled FROM orders WHERE o_totalprice * 2 > 400000")
def where_alias(t):
    return t.sql("SELECT o_orderkey, o_totalprice * 2 AS doubled FROM orders WHERE doubled > 400000", "orders")


@query("SELECT p_partkey FROM part WHERE p_size > 40")
def where_superset_columns(t):
    return t.sql("SELECT p_partkey FROM part WHERE p_size > 40", "part")


@query("SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey > 10")
def ordinal_column(t):
    return t.supplier.filter(col_index(2).gt(10)).project([col_index(0), col_index(2)])


@query("SELECT o_orderkey, o_orderkey // 7 AS quotient, o_orderkey % 7 AS rest, -(o_orderkey // 7) AS minus FROM orders")
def arithmetic_int_div_mod(t):
    k = col("o_orderkey")
    return t.orders.project([k, k.div(7).alias("quotient"), k.modulus(7).alias("rest"), (-(k / 7)).alias("minus")])


@query("SELECT l_orderkey, l_linenumber, l_linenumber + l_quantity AS a, l_quantity - l_linenumber AS s, l_linenumber * l_tax AS m, l_quantity / l_linenumber AS d FROM lineitem")
def arithmetic_mixed(t):
    n, q = col("l_linenumber"), col("l_quantity")
    return t.lineitem.project([col("l_orderkey"), n, (n + q).alias("a"), (q - n).alias("s"), (n * col("l_tax")).alias("m"), (q / n).alias("d")])


@query("SELECT r_regionkey, 'x' AS text, CAST(7 AS BIGINT) AS whole, CAST(0.25 AS DOUBLE) AS part, true AS yes, CAST(NULL AS VARCHAR) AS nothing, DATE '2024-02-29' AS day, CAST(1e20 AS DOUBLE) AS big FROM region")
def literals(t):
    return t.region.project([
        col("r_regionkey"), lit("x").alias("text"), lit(7).alias("whole"), lit(0.25).alias("part"), lit(True).alias("yes"),
        lit(None, "Utf8").alias("nothing"), lit(datetime.date(2024, 2, 29)).alias("day"), lit(10**20).alias("big"),
    ])


@query("SELECT c_custkey, -c_acctbal AS negative, CAST(-5 AS BIGINT) AS five FROM customer")
def unary_minus(t):
    return t.customer.project([col("c_custkey"), (-col("c_acctbal")).alias("negative"), (-lit(5)).alias("five")])


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) AS d, CAST(p_size AS BIGINT) AS b, CAST(p_size AS SMALLINT) AS s FROM part")
def cast_numeric(t):
    s = col("p_size")
    return t.part.project([col("p_partkey"), cast(s, "Float64").alias("d"), cast(s, "BIGINT").alias("b"), cast(s, "Int16").alias("s")])


@query("SELECT p_partkey, CAST(p_size AS VARCHAR) AS shown, CAST(CAST(p_size AS VARCHAR) AS INTEGER) AS again, TRY_CAST(p_name AS INTEGER) AS none FROM part")
def cast_string(t):
    s = cast(col("p_size"), "Utf8")
    return t.part.project([col("p_partkey"), s.alias("shown"), cast(s, "Int32").alias("again"), col("p_name").try_cast("Int32").alias("none")])


@query("SELECT r_regionkey, DATE '1998-12-01' - 90 AS before, DATE '1998-12-01' + 31 AS after FROM region")
def date_literal_interval(t):
    day = lit(datetime.date(1998, 12, 1))
    return t.region.project([col("r_regionkey"), date_subtract(day, 90).alias("before"), date_add(day, 31).alias("after")])


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) + 30 AS due, CAST(o_orderdate AS DATE) - 1 AS eve FROM orders WHERE CAST(o_orderdate AS DATE) > DATE '1997-01-01'")
def date_column_interval(t):
    day = cast(col("o_orderdate"), "Date32")
    return t.orders.filter(day.gt(lit(datetime.date(1997, 1, 1)))).project([col("o_orderkey"), date_add(day, 30).alias("due"), date_subtract(day, 1).alias("eve")])


@query("SELECT p_partkey, round(sqrt(p_retailprice), 6) AS root, round(ln(p_retailprice), 6) AS logarithm FROM part")
def sqrt_ln(t):
    p = col("p_retailprice")
    return t.part.project([col("p_partkey"), _round(sqrt(p), 6).alias("root"), _round(log(p), 6).alias("logarithm")])


_NULLED = "CASE WHEN c_custkey % 4 <> 0 THEN c_nationkey END"


@query(f"SELECT c_custkey, ({_NULLED}) IS NULL AS none, ({_NULLED}) IS NOT NULL AS some, NOT (c_acctbal > 0) AS poor FROM customer")
def not_isnull(t):
    n = col("c_nationkey").on_rows(col("c_custkey").modulus(4).neq(0))
    return t.customer.project([col("c_custkey"), n.is_null().alias("none"), n.is_not_null().alias("some"), (~col("c_acctbal").gt(0.0)).alias("poor")])


@query(f"SELECT c_custkey, ({_NULLED}) IS DISTINCT FROM 5 AS d, ({_NULLED}) IS NOT DISTINCT FROM NULL AS n FROM customer")
def distinct_from(t):
    n = col("c_nationkey").on_rows(col("c_custkey").modulus(4).neq(0))
    return t.customer.project([col("c_custkey"), n.is_distinct_from(5).alias("d"), n.is_not_distinct_from(lit(None, "Int32")).alias("n")])


@query("""SELECT p_partkey, p_type LIKE '%a%' AS l, p_type NOT LIKE 'A%' AS nl, p_type ILIKE '%A%' AS il, regexp_matches(p_brand, '[0-9]1$') AS r,
    NOT regexp_matches(p_brand, '[0-9]1$') AS nr, regexp_matches(lower(p_brand), 'brand') AS ir FROM part""")
def like_ilike_regex(t):
    kind, brand = col("p_type"), col("p_brand")
    return t.part.project([
        col("p_partkey"), kind.like("%a%").alias("l"), kind.op("not_like", "A%").alias("nl"), kind.ilike("%A%").alias("il"),
        brand.op("match", "[0-9]1$").alias("r"), brand.op("not_match", "[0-9]1$").alias("nr"), brand.op("imatch", "BRAND").alias("ir"),
    ])


@query("SELECT o_orderkey, o_orderkey & 12 AS a, o_orderkey | 3 AS o, xor(o_orderkey, 5) AS x, o_orderkey << 2 AS l, o_orderkey >> 1 AS r, o_orderstatus || '-' || o_orderpriority AS c FROM orders")
def bitwise_concat(t):
    k = col("o_orderkey")
    return t.orders.project([
        k, k.op("bit_and", 12).alias("a"), k.op("bit_or", 3).alias("o"), k.op("bit_xor", 5).alias("x"), k.op("shift_left", 2).alias("l"),
        k.op("shift_right", 1).alias("r"), col("o_orderstatus").op("concat", "-").op("concat", col("o_orderpriority")).alias("c"),
    ])


@query("SELECT event_id, CASE WHEN value > 50 THEN value * 2 END AS chosen FROM events")
def selective_evaluation(t):
    return t.events.project([col("event_id"), (col("value") * 2.0).on_rows(col("value").gt(50.0)).alias("chosen")])


@query("SELECT n_nationkey, upper(n_name) AS loud, length(n_name) AS n FROM nation")
def scalar_by_name(t):
    return t.nation.project([col("n_nationkey"), function("upper", col("n_name")).alias("loud"), function("length", col("n_name")).alias("n")])


# joins
_CO = [("c_custkey", "o_custkey")]


def _orders(t):
    """All orders; every third customer's have a null key."""
    key = col("o_custkey").on_rows(col("o_custkey").modulus(3).neq(0)).alias("o_custkey")
    return t.orders.project([col("o_orderkey"), key])


def _customers(t):
    """All customers, with keys moved by ten, so that both sides have keys that the other hasn't."""
    return t.customer.project([(col("c_custkey") + 10).alias("c_custkey"), col("c_name")])


_O = "(SELECT o_orderkey, CASE WHEN o_custkey % 3 <> 0 THEN o_custkey END AS o_custkey FROM orders) o"
_C = "(SELECT c_custkey + 10 AS c_custkey, c_name FROM customer) c"


@query(f"SELECT c.*, o.* FROM {_C} JOIN {_O} ON c_custkey = o_custkey")
def join_inner(t):
    return _customers(t).join(_orders(t), "Inner", _CO)


@query(f"SELECT c.*, o.* FROM {_C} LEFT JOIN {_O} ON c_custkey = o_custkey")
def join_left(t):
    return _customers(t).join(_orders(t), "Left", _CO)


@query(f"SELECT c.*, o.* FROM {_C} RIGHT JOIN {_O} ON c_custkey = o_custkey")
def join_right(t):
    return _customers(t).join(_orders(t), "Right", _CO)


@query(f"SELECT c.*, o.* FROM {_C} FULL JOIN {_O} ON c_custkey = o_custkey")
def join_full(t):
    return _customers(t).join(_orders(t), "Full", _CO)


@query(f"SELECT c.* FROM {_C} WHERE EXISTS (SELECT 1 FROM {_O} WHERE c_custkey = o_custkey)")
def join_semi(t):
    return _customers(t).join(_orders(t), "LeftSemi", _CO)


@query(f"SELECT c.* FROM {_C} WHERE NOT EXISTS (SELECT 1 FROM {_O} WHERE c_custkey = o_custkey)")
def join_anti(t):
    return _customers(t).join(_orders(t), "LeftAnti", _CO)


@query(f"SELECT o.* FROM {_O} WHERE EXISTS (SELECT 1 FROM {_C} WHERE c_custkey = o_custkey)")
def join_right_semi(t):
    return _customers(t).join(_orders(t), "RightSemi", _CO)


@query(f"SELECT o.* FROM {_O} WHERE NOT EXISTS (SELECT 1 FROM {_C} WHERE c_custkey = o_custkey)")
def join_right_anti(t):
    return _customers(t).join(_orders(t), "RightAnti", _CO)


@query(f"SELECT c.*, EXISTS (SELECT 1 FROM {_O} WHERE c_custkey = o_custkey) AS mark FROM {_C}")
def join_mark(t):
    return _customers(t).join(_orders(t), "LeftMark", _CO)


@query(f"SELECT o.*, EXISTS (SELECT 1 FROM {_C} WHERE c_custkey = o_custkey) AS mark FROM {_O}")
def join_right_mark(t):
    return _customers(t).join(_orders(t), "RightMark", _CO)


@query("SELECT a.l_orderkey, a.l_linenumber, a.l_quantity, b.l_tax FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber WHERE b.l_tax > 0.06")
def join_multi_key(t):
    keys = [col("l_orderkey"), col("l_linenumber")]
    right = t.lineitem.filter(col("l_tax").gt(0.06)).project([*keys, col("l_tax")])
    return t.lineitem.project([*keys, col("l_quantity")]).join(right, "Inner", [("l_orderkey", "l_orderkey"), ("l_linenumber", "l_linenumber")])


_SAFE = "(SELECT CASE WHEN s_nationkey % 2 = 0 THEN s_nationkey END AS k, s_suppkey FROM supplier) a"
_SAFE2 = "(SELECT CASE WHEN n_nationkey % 4 = 0 THEN n_nationkey END AS n, n_name FROM nation) b"


@query(f"SELECT a.k, s_suppkey, n, n_name FROM {_SAFE} JOIN {_SAFE2} ON a.k IS NOT DISTINCT FROM b.n")
def join_null_safe(t):
    k = col("s_nationkey").on_rows(col("s_nationkey").modulus(2).eq(0)).alias("k")
    n = col("n_nationkey").on_rows(col("n_nationkey").modulus(4).eq(0)).alias("n")
    return t.supplier.project([k, col("s_suppkey")]).join(t.nation.project([n, col("n_name")]), "Inner", [("k", "n")], nulls="NullEqualsNull")


@query("SELECT c_custkey, c_acctbal, o_orderkey, o_custkey, o_totalprice FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > c_acctbal * 20")
def join_residual(t):
    left = t.customer.project([col("c_custkey"), col("c_acctbal")])
    right = t.orders.project([col("o_orderkey"), col("o_custkey"), col("o_totalprice")])
    return left.join(right, "Left", _CO, residual=col("right.o_totalprice").gt(col("left.c_acctbal") * 20))


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(t):
    return t.region.project([col("r_name")]).join(t.nation.project([col("n_name")]), "Cross")


@query("SELECT s_suppkey, s_nationkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def join_collect_side(t):
    left = t.nation.project([col("n_nationkey"), col("n_name")])
    return left.join(t.supplier.project([col("s_suppkey"), col("s_nationkey")]), "Inner", [("n_nationkey", "s_nationkey")], mode="CollectLeft").project([col("s_suppkey"), col("s_nationkey"), col("n_name")])


# aggregates
@query("SELECT MIN(l_quantity) AS low, MAX(l_quantity) AS high, round(SUM(l_extendedprice), 2) AS total, round(AVG(l_discount), 6) AS mean, COUNT(l_tax) AS n FROM lineitem")
def agg_global(t):
    out = t.lineitem.aggregate([], [min_(col("l_quantity")).alias("low"), max_(col("l_quantity")).alias("high"), sum_(col("l_extendedprice")).alias("total"), avg(col("l_discount")).alias("mean"), count(col("l_tax")).alias("n")])
    return rounded(out, total=2, mean=6)


@query("SELECT COUNT(*) AS n, SUM(l_quantity) AS total FROM lineitem WHERE l_quantity < 0")
def agg_global_empty(t):
    return t.lineitem.filter(col("l_quantity").lt(0.0)).aggregate([], [count(lit(1)).alias("n"), sum_(col("l_quantity")).alias("total")])


@query("SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n, round(SUM(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2")
def agg_group(t):
    return rounded(t.orders.aggregate([col("o_orderstatus"), col("o_orderpriority")], [count(lit(1)).alias("n"), sum_(col("o_totalprice")).alias("total")]), total=2)


@query("SELECT o_orderkey % 10 AS digit, MAX(o_orderkey) AS high FROM orders GROUP BY 1")
def agg_group_expr(t):
    return t.orders.aggregate([col("o_orderkey").modulus(10).alias("digit")], [max_(col("o_orderkey")).alias("high")])


@query(f"SELECT {_NULLED} AS k, COUNT(*) AS n, MIN(c_custkey) AS low FROM customer GROUP BY 1")
def agg_null_group(t):
    return t.customer.aggregate([col("c_nationkey").on_rows(col("c_custkey").modulus(4).neq(0)).alias("k")], [count(lit(1)).alias("n"), min_(col("c_custkey")).alias("low")])


@query("SELECT event_type, COUNT(*) AS n FROM events GROUP BY event_type")
def agg_count_star(t):
    return t.sql("SELECT event_type, COUNT(*) AS n FROM events GROUP BY event_type", "events")


@query("SELECT event_type, COUNT(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def agg_count_distinct(t):
    return t.events.aggregate([col("event_type")], [count_distinct(col("user_id")).alias("users")])


@query("SELECT DISTINCT o_orderpriority FROM orders")
def agg_without_aggregates(t):
    return t.orders.aggregate([col("o_orderpriority")], [])


@query("SELECT l_suppkey, COUNT(*) AS n FROM lineitem GROUP BY l_suppkey HAVING COUNT(*) > 60")
def agg_having_alias(t):
    return t.sql("SELECT l_suppkey, COUNT(*) AS n FROM lineitem GROUP BY l_suppkey HAVING n > 60", "lineitem")


@query("SELECT l_suppkey, MAX(l_quantity) AS high FROM lineitem GROUP BY l_suppkey HAVING MIN(l_extendedprice) > 1000 AND COUNT(*) > 3")
def agg_having_call(t):
    return t.sql("SELECT l_suppkey, MAX(l_quantity) AS high FROM lineitem GROUP BY l_suppkey HAVING MIN(l_extendedprice) > 1000 AND COUNT(*) > 3", "lineitem")


@query("SELECT l_returnflag, COUNT(l_orderkey) FILTER (WHERE l_quantity > 25) AS many, MAX(l_tax) FILTER (WHERE l_discount < 0.02) AS tax FROM lineitem GROUP BY l_returnflag")
def agg_filter(t):
    return t.lineitem.aggregate([col("l_returnflag")], [count(col("l_orderkey")).where(col("l_quantity").gt(25.0)).alias("many"), max_(col("l_tax")).where(col("l_discount").lt(0.02)).alias("tax")])


@query("SELECT state, MAX(price) AS high FROM (SELECT o_orderstatus AS state, CAST(o_totalprice AS BIGINT) * 2 AS price FROM orders) GROUP BY state")
def agg_over_arithmetic(t):
    return t.orders.aggregate([col("o_orderstatus").alias("state")], [max_(cast(function("rint", col("o_totalprice")), "Int64") * 2).alias("high")])


_KEYS = [col("l_returnflag"), col("l_linestatus")]


@query("SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def agg_rollup(t):
    return t.lineitem.rollup(_KEYS, [count(lit(1)).alias("n")])


@query("SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def agg_cube(t):
    return t.lineitem.cube(_KEYS, [count(lit(1)).alias("n")])


@query("SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def agg_grouping_sets(t):
    return t.lineitem.grouping_sets([[_KEYS[0]], [_KEYS[1]], []], _KEYS, [count(lit(1)).alias("n")])


_PHASES = "SELECT l_returnflag, MIN(l_quantity) AS low, COUNT(*) AS n, round(AVG(l_extendedprice), 4) AS mean FROM lineitem GROUP BY l_returnflag"


@query(_PHASES)
def agg_two_phase(t):
    return rounded(t.lineitem.two_phase([col("l_returnflag")], [min_(col("l_quantity")).alias("low"), count(lit(1)).alias("n"), avg(col("l_extendedprice")).alias("mean")]), mean=4)


@query("SELECT event_type, MIN(value) AS low, MAX(value) AS high, round(SUM(value), 4) AS total FROM events GROUP BY event_type")
def agg_map_reduce(t):
    """States of each part of the table, states of these, and the results, in one scan."""
    key, v = col("event_type"), col("value")
    wanted = [key], [min_(v).alias("low"), max_(v).alias("high"), sum_(v).alias("total")]
    out = t.events
    for mode in ("Partial", "PartialReduce", "Final"):
        out = out.aggregate_phase(mode, *wanted)
    return rounded(out, total=4)


# sorting, limits, sets, partitioning
@query(f"SELECT c_custkey, {_NULLED} AS k FROM customer ORDER BY k DESC NULLS LAST, c_custkey ASC LIMIT 100")
def sort_multi_key_nulls(t):
    k = col("c_nationkey").on_rows(col("c_custkey").modulus(4).neq(0)).alias("k")
    return t.customer.project([col("c_custkey"), k]).sort([desc(col("k"), nulls_first=False), asc(col("c_custkey"))]).limit(100)


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC NULLS FIRST, l_orderkey, l_linenumber LIMIT 20")
def top_k(t):
    rows = t.lineitem.project([col("l_orderkey"), col("l_linenumber"), col("l_extendedprice")])
    return rows.top_k([desc(col("l_extendedprice")), asc(col("l_orderkey")), asc(col("l_linenumber"))], 20)


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 15 OFFSET 30")
def limit_offset(t):
    return t.orders.project([col("o_orderkey")]).sort([asc(col("o_orderkey"))]).offset(30).limit(15)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey < 0")
def limit_zero(t):
    return t.orders.project([col("o_orderkey")]).limit(0)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 12")
def sort_within_partitions(t):
    """The first rows of each sorted partition, of which there is one."""
    rows = t.orders.project([col("o_orderkey"), col("o_totalprice")]).repartition(1)
    return rows.sort_within_partitions([desc(col("o_totalprice")), asc(col("o_orderkey"))]).local_limit(12)


@query("SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_extendedprice * (1 - l_discount) DESC, l_orderkey, l_linenumber LIMIT 25")
def sort_by_expression(t):
    worth = col("l_extendedprice") * (lit(1) - col("l_discount"))
    return t.lineitem.sort([desc(worth), asc(col("l_orderkey")), asc(col("l_linenumber"))]).limit(25).project([col("l_orderkey"), col("l_linenumber")])


def _sql_query(name: str, text: str, *tables: str, oracle: str | None = None):
    def run(t):
        return t.sql(text, *tables)

    run.__name__ = name
    query(oracle or text)(run)


_sql_query("where_alias_qualified", "SELECT o.o_orderkey, o.o_totalprice * 2 AS d FROM orders o WHERE d > 400000 AND o.o_orderkey > 3", "orders", oracle="SELECT o_orderkey, o_totalprice * 2 AS d FROM orders WHERE o_totalprice * 2 > 400000 AND o_orderkey > 3")
_sql_query("where_alias_implicit", "SELECT o_orderkey, o_totalprice * 2 d, o_custkey + 1 e FROM orders WHERE d > 300000 AND e < 100", "orders", oracle="SELECT o_orderkey, o_totalprice * 2 AS d, o_custkey + 1 AS e FROM orders WHERE o_totalprice * 2 > 300000 AND o_custkey + 1 < 100")
_sql_query("sql_order_by", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 10 OFFSET 5", "customer")
_sql_query("sql_between_in_case", """SELECT p_partkey, CASE WHEN p_size BETWEEN 10 AND 20 THEN 'mid' WHEN p_size IN (1, 2, 50) THEN 'edge' ELSE 'other' END AS class, p_size NOT IN (3, 4) AS kept FROM part WHERE p_size NOT BETWEEN 30 AND 35""", "part")
_sql_query("sql_exists", "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49) AND s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)", "supplier", "lineitem", "nation")
_sql_query("sql_scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT 1.8 * AVG(o_totalprice) FROM orders)", "orders")
_sql_query("sql_coalesce_nullif", "SELECT c_custkey, COALESCE(NULLIF(c_mktsegment, 'BUILDING'), 'none') AS segment FROM customer", "customer")
_sql_query("sql_interval_day", "SELECT o_orderkey, CAST(o_orderdate AS DATE) + INTERVAL '30' DAY AS due FROM orders WHERE CAST(o_orderdate AS DATE) < DATE '1998-01-01' - INTERVAL '90' DAY", "orders", oracle="SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + INTERVAL 30 DAY AS DATE) AS due FROM orders WHERE CAST(o_orderdate AS DATE) < CAST(DATE '1998-01-01' - INTERVAL 90 DAY AS DATE)")
_sql_query("sql_scalar_functions", "SELECT n_nationkey, UPPER(n_name) AS loud, CAST(LENGTH(n_name) AS BIGINT) AS n, SUBSTRING(n_name, 2, 3) AS part, ROUND(SQRT(n_nationkey), 6) AS root, ABS(n_regionkey - 3) AS away, TRIM('  x ') AS x FROM nation", "nation")
_sql_query("sql_group_by_all", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY ALL", "orders")
_sql_query("sql_window_functions", """SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth, LAG(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before,
    RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS place FROM orders""", "orders", oracle="""SELECT o_orderkey, CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS nth, LAG(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before,
    CAST(RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS INTEGER) AS place FROM orders""")
_sql_query("sql_set_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier", "customer", "supplier")
_sql_query("cast_boolean", "SELECT n_nationkey, CAST(n_regionkey AS BOOLEAN) AS some, CAST('true' AS BOOLEAN) AS yes FROM nation", "nation")


@query("SELECT c_mktsegment AS segment, COUNT(*) AS n FROM customer WHERE c_acctbal > 1000 GROUP BY c_mktsegment")
def derived_view(t):
    t.session.register("rich", t.customer.filter(col("c_acctbal").gt(1000.0)).project([col("c_mktsegment").alias("segment")]))
    return t.session.sql("SELECT segment, COUNT(*) AS n FROM rich GROUP BY segment")


@query("SELECT p_partkey, p_size >= 10 AND p_size <= 20 AS mid, p_size IN (1, 2, 50) AS edge, CASE WHEN p_size < 5 THEN 'small' WHEN p_size < 15 THEN 'some' ELSE 'many' END AS class, COALESCE(CASE WHEN p_size > 40 THEN p_size END, -1) AS large FROM part")
def expressions_between_in_case(t):
    s = col("p_size")
    large = coalesce(s.on_rows(s.gt(40)), cast(lit(-1), "Int32"))
    return t.part.project([col("p_partkey"), s.between(10, 20).alias("mid"), s.in_list(1, 2, 50).alias("edge"), case((s.lt(5), "small"), (s.lt(15), "some"), otherwise="many").alias("class"), large.alias("large")])


@query("SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS spread, round(var_samp(l_discount), 8) AS variance, median(l_quantity) AS middle FROM lineitem GROUP BY l_returnflag")
def agg_statistics(t):
    out = t.lineitem.aggregate([col("l_returnflag")], [stddev(col("l_quantity")).alias("spread"), variance(col("l_discount")).alias("variance"), median(col("l_quantity")).alias("middle")])
    return rounded(out, spread=6, variance=8)


@query(f"SELECT c.*, EXISTS (SELECT 1 FROM {_O} WHERE c_custkey = o_custkey AND o_orderkey > c_custkey) AS mark FROM {_C}")
def join_mark_residual(t):
    return _customers(t).join(_orders(t), "LeftMark", _CO, residual=col("right.o_orderkey").gt(col("left.c_custkey")))


@query("SELECT a.o_orderkey, a.o_custkey, b.c_name FROM orders a JOIN customer b ON a.o_custkey = b.c_custkey")
def join_partitioned(t):
    left = t.orders.project([col("o_orderkey"), col("o_custkey")])
    return left.join(t.customer.project([col("c_custkey"), col("c_name")]), "Inner", [("o_custkey", "c_custkey")], mode="Partitioned").project([col("o_orderkey"), col("o_custkey"), col("c_name")])


# sources, functions of the user's own
def _written(t, name: str, frame: Frame, **options) -> str:
    """The frame as delimited text in the folder that driver and executors share."""
    spark = t.session.spark
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="sparkloom-")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    frame.df.write.options(**options).csv(path)
    return path


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def csv_source(t):
    path = _written(t, "supplier", t.supplier.project([cast(col("s_suppkey"), "Int64"), col("s_name"), col("s_acctbal")]), header=True)
    return t.session.register_csv("supplier_csv", path).project([cast(col("s_suppkey"), "Int32"), col("s_name"), col("s_acctbal")])


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey <> 1")
def tsv_source(t):
    path = _written(t, "nation", t.nation, header=True, sep="\t")
    rows = t.session.tsv(path, schema="n_nationkey int, n_name string, n_regionkey int").filter(col("n_regionkey").neq(1))
    return rows.project([col("n_nationkey"), col("n_name")])


@query("SELECT p_partkey, p_brand FROM part")
def csv_source_without_header(t):
    path = _written(t, "part", t.part.project([col("p_partkey"), col("p_brand")]))
    return t.session.csv(path, schema="p_partkey int, p_brand string", header=False)


@query("SELECT id, name, CAST(x AS DOUBLE) AS x FROM (VALUES (1, 'a', 0.5), (2, NULL, 1.5), (3, 'c', NULL)) AS v(id, name, x)")
def memory_source(t):
    return t.session.register_data_source("small", [(1, "a", 0.5), (2, None, 1.5), (3, "c", None)], "id int, name string, x double")


@query("SELECT name, CAST(x AS DOUBLE) AS x FROM (VALUES (1, 'a', 0.5), (2, NULL, 1.5)) AS v(id, name, x)")
def memory_source_projected(t):
    return t.session.memory(pa.table({"id": [1, 2], "name": ["a", None], "x": [0.5, 1.5]}), columns=["name", "x"])


class _Squares(TableProvider):
    partitions = 4

    def schema(self):
        return "n long, square long, unused string"

    def scan(self, partition, columns=None):
        n = [*range(partition * 25, partition * 25 + 25)]
        every = {"n": n, "square": [x * x for x in n]} | ({} if columns else {"unused": [None] * 25})
        yield pa.RecordBatch.from_pydict({c: every[c] for c in columns or every})


@query("SELECT i AS n, i * i AS square FROM range(100) AS r(i) WHERE i * i > 50")
def provider_source(t):
    return t.session.provider("squares", _Squares(), columns=["n", "square"]).filter(col("square").gt(50))


@query("SELECT event_type, round(exp(avg(ln(value + 1))), 6) AS mean FROM events WHERE value >= 0 GROUP BY event_type")
def udaf_geometric_mean(t):
    def geometric(values):
        import numpy as np

        return float(np.exp(np.log(values).mean()))

    t.session.functions.aggregate("geometric_mean", geometric, "double")
    return rounded(t.sql("SELECT event_type, geometric_mean(value + 1) AS mean FROM events WHERE value >= 0 GROUP BY event_type", "events"), mean=6)


@query("SELECT p_partkey, p_size * 3 + 1 AS hop FROM part")
def udf_scalar(t):
    t.session.functions.scalar("hop", lambda size: size * 3 + 1, "int")
    return t.part.project([col("p_partkey"), function("hop", col("p_size")).alias("hop")])


@query("SELECT i AS n FROM range(7) AS r(i)")
def udtf_rows(t):
    class Count:
        def eval(self, n: int):
            for i in range(n):
                yield (i,)

    t.session.functions.table("count_up", Count, "n long")
    return t.session.sql("SELECT n FROM count_up(7)")


@query("SELECT DISTINCT p_brand, p_size FROM part")
def distinct(t):
    return t.part.project([col("p_brand"), col("p_size")]).distinct()


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(t):
    return t.customer.project([col("c_nationkey").alias("k")]).union(t.supplier.project([col("s_nationkey").alias("k")]), distinct=True)


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(t):
    return t.customer.project([col("c_nationkey").alias("k")]).intersect(t.supplier.project([col("s_nationkey").alias("k")]))


@query("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey + 3 FROM supplier")
def set_except(t):
    return t.nation.project([col("n_nationkey").alias("k")]).except_(t.supplier.project([(col("s_nationkey") + 3).alias("k")]))


@query("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey")
def repartition_hash_invariance(t):
    return t.orders.repartition(5, [col("o_custkey")]).aggregate([col("o_custkey")], [count(lit(1)).alias("n")])


@query("SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus")
def repartition_round_robin(t):
    return t.orders.repartition(6).sort_within_partitions([asc(col("o_orderkey"))]).aggregate([col("o_orderstatus")], [count(lit(1)).alias("n")])


@query("""SELECT c_mktsegment, MAX(CAST(o_totalprice AS BIGINT)) AS high, COUNT(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey AND o_totalprice > c_acctbal * 2
    WHERE CAST(o_orderdate AS DATE) >= DATE '1993-02-28' GROUP BY c_mktsegment""")
def serialized_plan(t):
    """A plan sent as JSON and built again on the other side: join, residual condition, casts, aliases, dates."""
    for name in ("customer", "orders"):
        t.session.register(name, getattr(t, name))
    orders = t.session.table("orders").filter(cast(col("o_orderdate"), "Date32").gteq(lit(datetime.date(1993, 2, 28))))
    orders = orders.project([col("o_custkey"), col("o_totalprice"), cast(function("rint", col("o_totalprice")), "Int64").alias("whole")])
    frame = t.session.table("customer").project([col("c_custkey"), col("c_acctbal"), col("c_mktsegment")]).join(orders, "Inner", _CO, residual=col("right.o_totalprice").gt(col("left.c_acctbal") * 2))
    frame = frame.aggregate([col("c_mktsegment")], [max_(col("whole")).alias("high"), count(lit(1)).alias("n")])
    return t.session.from_json(frame.to_json())


@query("""SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2""")
def tumbling_windows(t):
    from pyspark.sql import functions as F

    from .streaming.windows import windowed

    out = windowed(t.events.df, "ts", "1 hour", [F.count("*").alias("n")], ["event_type"])
    return Frame(t.session, out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n"), t.events.spec)


_Q1 = """SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS sum_qty, {r}SUM(l_extendedprice * (1 - l_discount)){s} AS sum_disc, {r}AVG(l_discount){t} AS avg_disc, COUNT(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP_NTZ '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus"""


@query(_Q1.format(r="round(", s=", 2)", t=", 6)").replace("TIMESTAMP_NTZ", "TIMESTAMP"))
def tpch_q1_like(t):
    return rounded(t.sql(_Q1.format(r="", s="", t=""), "lineitem"), sum_disc=2, avg_disc=6)


@query("SELECT round(SUM(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1996-01-01 00:00:00' AND l_discount >= 0.05 AND l_discount <= 0.07 AND l_quantity < 24")
def tpch_q6_like(t):
    text = "SELECT SUM(l_extendedprice * l_discount) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP_NTZ '1995-01-01 00:00:00' AND l_shipdate < TIMESTAMP_NTZ '1996-01-01 00:00:00' AND l_discount >= 0.05 AND l_discount <= 0.07 AND l_quantity < 24"
    return rounded(t.sql(text, "lineitem"), revenue=2)


@query("""SELECT n_name, round(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name""")
def tpch_q5_like(t):
    lines = t.lineitem.project([col("l_orderkey"), col("l_suppkey"), (col("l_extendedprice") * (lit(1) - col("l_discount"))).alias("price")])
    sold = t.customer.project([col("c_custkey"), col("c_nationkey")]).join(t.orders.project([col("o_orderkey"), col("o_custkey")]), "Inner", _CO)
    sold = sold.join(lines, "Inner", [("o_orderkey", "l_orderkey")])
    local = sold.join(t.supplier.project([col("s_suppkey"), col("s_nationkey")]), "Inner", [("l_suppkey", "s_suppkey"), ("c_nationkey", "s_nationkey")])
    named = local.join(t.nation.project([col("n_nationkey"), col("n_name")]), "Inner", [("s_nationkey", "n_nationkey")])
    return rounded(named.aggregate([col("n_name")], [sum_(col("price")).alias("revenue")]), revenue=2)
