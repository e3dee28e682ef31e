"""Every query that SQL can express, against DuckDB over the same files."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from spindrift.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for name in os.listdir(SF):
        con.sql(f"create view {name.split('.')[0]} as select * from '{SF}/{name}'")
    return con


def plain(value):
    return round(value, 5) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    rows = registry.QUERIES[name](spark, SF)
    sql = duck.sql(registry.ORACLES[name])
    columns = sorted(rows.columns)
    assert columns == sorted(sql.columns)
    order = lambda row: tuple((v is None, str(v)) for v in row)
    got = sorted((tuple(plain(v) for v in r) for r in rows.select(*columns).collect()), key=order)
    want = sorted((tuple(plain(v) for v in r) for r in sql.select(", ".join(f'"{c}"' for c in columns)).fetchall()), key=order)
    assert got == want


def test_entry_gives_rows(spark):
    assert 0 < entry.entry(spark).count() <= 5


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
