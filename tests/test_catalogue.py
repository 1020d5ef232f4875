"""Every registered query with an oracle against DuckDB at the small scale."""

import os

import duckdb
import pandas as pd
import pytest

from factloom.plans import catalogue

DIR = os.environ.get("FACTLOOM_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DIR):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{DIR}/{name}'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: None if v is None or v is pd.NaT else round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(clean(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, duck, name):
    got = catalogue.queries()[name](spark, DIR)
    found = duck.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(got.columns)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(found.fetchall(), columns)


#: Queries that join one row of totals to all others; every other join must be on keys.
ONE_ROW = {"a04_stats", "a09_unresolved_report", "search_page", "t05_match", "t06_bm25_common", "t06_bm25_rare", "t08_page", "t09_body_search"}


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - ONE_ROW))
def test_joins_are_on_keys(spark, name):
    plan = catalogue.queries()[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
