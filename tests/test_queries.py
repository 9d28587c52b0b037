"""Registered queries against their SQL forms in the oracle engine, at the smallest size."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from termlake.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def cell(x):
    if x is None or x != x or str(x) in ("NaT", "<NA>"):
        return "null"
    if isinstance(x, (bool, str)) or type(x).__name__ == "bool_":
        return str(x)
    if hasattr(x, "isoformat"):
        return str(x).removesuffix(" 00:00:00")
    return f"{round(float(x), 6):.6f}"


def table(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted(tuple(map(cell, r)) for r in pdf[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_oracle(spark, oracle, name):
    assert table(QUERIES[name](spark, SF).toPandas()) == table(oracle.execute(ORACLES[name]).df())


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rows_only_queries(spark):
    for name in sorted(set(QUERIES) - set(ORACLES)):
        assert QUERIES[name](spark, SF).count() > 0
    found = QUERIES["span_locate"](spark, SF)
    assert found.where("span_start IS NULL").count() < 0.1 * found.count()


def test_scans_are_pruned_and_filtered(spark):
    plan = QUERIES["sl_time_granularity"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "ReadSchema" in line]
    assert scans and all("l_quantity" not in s for s in scans)
    drill = QUERIES["drill_through"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(" in drill or "PushedFilters: [IsNotNull" in drill
