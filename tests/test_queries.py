"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import decimal
import math
import os

import duckdb
import pytest

from sparkloom import queries

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    return "nan" if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v


def shown(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", queries.queries())
def test_same_rows(spark, duck, name):
    df = queries.queries()[name](spark, DIR)
    want = duck.sql(queries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert shown(df.collect(), df.columns) == shown(want.fetchall(), want.columns)


def test_scans_read_only_what_is_used(spark):
    text = queries.queries()["tpch_q6_like"](spark, DIR)._jdf.queryExecution().toString()
    scan = next(x for x in text.splitlines() if "FileScan" in x)
    assert "ReadSchema: struct<l_quantity:double,l_extendedprice:double,l_discount:double,l_shipdate:timestamp_ntz>" in text and "PushedFilters" in scan
