"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and then RUNS times; the value is the sum of the medians. Results are
fetched by a no-op sink, so that every row and column is computed. ``duckdb`` has the warm medians of
DuckDB for the same SQL on the same files with as many threads, as a yardstick.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

from pyspark.sql import SparkSession

from sparkloom.queries import oracle_sql, queries

HEADLINE = (
    "tpch_q1_like", "tpch_q6_like", "tpch_q5_like", "scan_projection", "filter_and_or", "agg_group", "agg_count_distinct", "agg_rollup", "agg_two_phase",
    "agg_map_reduce", "join_inner", "join_left", "join_right", "join_anti", "join_multi_key", "join_residual", "top_k", "sort_multi_key_nulls", "distinct", "repartition_hash_invariance",
)
RUNS = 3


def yardstick(folder: str, cpus: str) -> dict[str, float]:
    """DuckDB's warm medians, or nothing where it isn't installed."""
    try:
        import duckdb
    except ModuleNotFoundError:
        return {}
    con = duckdb.connect(config={"threads": int(cpus)})
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    out = {}
    for name in HEADLINE:
        times = []
        for _ in range(RUNS + 1):
            began = time.perf_counter()
            con.sql(oracle_sql()[name]).to_arrow_table()
            times.append(time.perf_counter() - began)
        out[name] = round(statistics.median(times[1:]), 3)
    return out


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.files.maxPartitionBytes", "16m").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    every, cold, warm = queries(), {}, {}
    for name in HEADLINE:
        times = []
        for _ in range(RUNS + 1):
            began = time.perf_counter()
            every[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        cold[name], warm[name] = round(times[0], 3), round(statistics.median(times[1:]), 3)
    sf = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(warm.values()), 3), "unit": "sec", "queries": warm, "cold": cold, "duckdb": yardstick(folder, cpus), "sf": float(sf[1]) if sf else None}))
    spark.stop()


if __name__ == "__main__":
    sys.exit(main())
