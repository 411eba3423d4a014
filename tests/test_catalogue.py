"""Each query of the catalogue against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__
from terraloom.plans import catalogue

from .conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return f"{float(v) + 0.0:.8g}"
    return str(v)


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, str(DATA))
    got = table(df.columns, df.collect())
    if name in catalogue.SQL:
        cursor = duck.execute(catalogue.SQL[name])
        assert got == table([c[0] for c in cursor.description], cursor.fetchall())
    assert got[1] or name == "donor_tiles"  # ten suppliers are too few for one


def test_entry(spark):
    assert 0 < __spark_entry__.entry(spark).count() <= 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_scans_read_what_they_need(spark):
    plan = catalogue.QUERIES["distribution"](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_extendedprice:double,l_returnflag:string>" in plan
    plan = catalogue.QUERIES["temporal_median_mean_max"](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in plan or "l_shipdate" in plan.split("PushedFilters")[1][:300]
