import os

import pytest

import __spark_entry__
from vectorloom.plans import catalog

SMALL = "/root/testdata/sf0.001"


def test_every_oracle_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(catalog.queries()) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")
def test_entry(spark):
    rows = __spark_entry__.entry(spark).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, 11)) and rows[0]["id"] == 0


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_queries_against_duckdb(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{f}'")
    got, told = catalog.queries()[name](spark, SMALL).toPandas(), con.execute(catalog.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(told.columns)
    rows = lambda df: sorted(tuple(x) for x in df[sorted(df.columns)].itertuples(index=False))
    assert rows(got) == rows(told)
