"""Every registered query of the reference's operators against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from millrace import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return list(df.columns), sorted(map(repr, df.where(df.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, oracle, name):
    assert rows(registry.queries()[name](spark, DIR).toPandas()) == rows(oracle.sql(registry.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, DIR).count() > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    q4 = plan(registry.queries()["tpch_q4"](spark, DIR))
    assert "LeftSemi" in q4 and "Python" not in q4 and "PushedFilters: [IsNotNull(o_orderdate)" in q4
    assert "LeftSemi" in plan(registry.queries()["tpch_q4_exists"](spark, DIR))
    assert "Cartesian" not in plan(registry.queries()["tpch_q19_or_join"](spark, DIR))
    q1 = plan(registry.queries()["tpch_q1"](spark, DIR))
    assert "l_orderkey" not in q1 and "partial_sum" in q1
