"""The library's queries against DuckDB, and those without SQL for rows and a stable schema."""

import duckdb
import pytest

from tidewheel.plans.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events".split()


def rows(df):
    key = sorted(df.columns)
    return sorted(map(repr, ([None if x is None or x != x else x for x in r] for r in df[key].astype(object).itertuples(index=False, name=None))))


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_rows_equal_sql(spark, small, name):
    got = QUERIES[name](spark, small).toPandas()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    want = con.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_kernels_give_rows(spark, small, name):
    df = QUERIES[name](spark, small)
    got = df.collect()
    assert got and len(set(df.columns)) == len(df.columns)


def test_entry_module():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(QUERIES) <= set(e.queries())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5
