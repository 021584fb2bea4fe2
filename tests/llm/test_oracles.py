"""Queries whose rows SQL gives too, against DuckDB."""

import duckdb
import pytest

from tidewheel.llm.registry import ORACLE_SQL, QUERIES

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_rows_equal(spark, small, name):
    got = QUERIES[name](spark, small).toPandas()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    want = con.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    key = sorted(got.columns)
    rows = lambda df: sorted(map(repr, df[key].astype(object).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
