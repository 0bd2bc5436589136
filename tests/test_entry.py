"""Each registered query with SQL against DuckDB on the smallest tables."""

import importlib

import duckdb
import pytest

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
overlap = importlib.import_module("readweave.plans.queries")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(str(v) if v == v and v is not None else "" for v in r) for r in frame.astype(object).itertuples(index=False, name=None))


def test_all_have_sql():
    assert overlap.queries().keys() == overlap.oracle_sql().keys()


@pytest.mark.parametrize("name", sorted(overlap.queries()))
def test_query(spark, duck, name):
    ours, theirs = overlap.queries()[name](spark, D).toPandas(), duck.execute(overlap.oracle_sql()[name]).fetch_df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["a", "b"]
