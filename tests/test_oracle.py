"""Every registered query with a SQL twin must equal DuckDB on the same tables."""
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from oracle_check import TABLES, rows_of  # noqa: E402

SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf, f"{t}.parquet")
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_every_twin_has_a_query():
    assert set(SQL) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, sf, con, name):
    df = E.queries()[name](spark, sf)
    got, gcols = rows_of(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(SQL[name])
    want, wcols = rows_of([d[0] for d in res.description], res.fetchall())
    assert gcols == wcols
    assert len(got) == len(want)
    assert got == want


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["Reporting_Airline", "delay_rate", "flights"]
    assert df.count() > 0
