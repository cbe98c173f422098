"""Every registered query against its SQL twin, and the shape of the plans."""

import math
import re

import duckdb
import pandas as pd
import pytest

from __spark_entry__ import TEXT_QUERIES, entry, oracle_sql, queries
from tallyward.suite.common import TABLES

# the text queries have tests of their own
QUERIES = {n: q for n, q in queries().items() if n not in TEXT_QUERIES}
ORACLES = {n: s for n, s in oracle_sql().items() if n in QUERIES}


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from read_parquet('{small}/{table}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if hasattr(value, "isoformat"):
        return pd.Timestamp(value).isoformat()
    if hasattr(value, "as_tuple"):
        return round(float(value), 6)
    return value


def table(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in data), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(name, spark, duck, small):
    result = QUERIES[name](spark, small)
    cursor = duck.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(result.columns)
    assert table(result.columns, result.collect()) == table(columns, cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_run(name, spark, small):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    assert entry(spark).columns == ["priority", "open_orders", "total_orders"]


STREAMED_OR_COPIED = ("x0", "io1")


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith(STREAMED_OR_COPIED)))
def test_no_pairwise_join_and_no_python_rows(name, spark, small):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "EvalPython" not in plan
    # only tables bounded by the number of partitions are broadcast by request
    assert len(re.findall("BroadcastExchange", plan)) == 0 or name in (
        "e03_case_timelines_split",
        "e06_step_durations_split",
        "e10_variants_by_hour",
        "e10_variant_steps_by_hour",
        "d06_findings_of_agent",
    )


def test_filters_and_columns_reach_the_scan(spark, small):
    plan = QUERIES["metric_open_orders"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(o_orderdate", plan)
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert "o_totalprice" not in schema and "o_custkey" not in schema
