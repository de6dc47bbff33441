"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as contract
from checks.compare import TABLES, rows_of

SF = "/root/testdata/sf0.001"
SQL = contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, con, name):
    df = contract.queries()[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name in SQL:
        res = con.execute(SQL[name])
        assert got == rows_of([d[0] for d in res.description], res.fetchall())


def test_entry(spark):
    assert contract.entry(spark).columns == ["dateaccessed", "url", "title", "firstLink", "trackId"]
