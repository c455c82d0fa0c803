"""Every engine query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from gleaner.plans import queries

SF = "/root/testdata/sf0.001"


def frames(got, want):
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    rows = lambda d: sorted(map(tuple, d[columns].astype(str).values.tolist()))
    assert rows(got) == rows(want)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, duck, name):
    frames(queries.queries()[name](spark, SF).toPandas(), duck.execute(queries.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted({*queries.queries()} - {*queries.oracle_sql()}))
def test_runs(spark, name):
    assert queries.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["page_id", "content"] and df.count() == 50
    assert {*e.oracle_sql()} <= {*e.queries()}
