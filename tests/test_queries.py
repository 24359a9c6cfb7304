"""Every query runs and, where it has SQL, equals it over the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(rows):
    def value(x):
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 6)
        return x

    return sorted((tuple(value(x) for x in r) for r in rows), key=str)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df, rel = entry.queries()[name](spark, SF), duck.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    names = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*[f"`{c}`" for c in names]).collect()]
    want = duck.sql(entry.oracle_sql()[name]).select(*[duckdb.ColumnExpression(c) for c in names]).fetchall()
    assert normal(rows) == normal(want)


def test_entry_and_bounds_of_the_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
