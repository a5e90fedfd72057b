"""Every registered query against its DuckDB counterpart on the given tables."""

import datetime
import math

import duckdb
import pytest

import __spark_entry__ as entry_module
from tallywise.catalog.registry import TABLES

QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
    "boolean": "BOOLEAN",
}


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    yield con
    con.close()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return str(value)


def comparable(names, rows):
    order = sorted(names)
    places = [names.index(n) for n in order]
    return sorted(tuple(plain(r[i]) for i in places) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_duckdb(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    result = duck.execute(ORACLES[name])
    types = {d[0]: str(d[1]) for d in result.description}
    assert {c: TYPES.get(t, t) for c, t in df.dtypes} == types
    expected = comparable([d[0] for d in result.description], result.fetchall())
    assert comparable(df.columns, df.collect()) == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).columns


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["x", "y", "moving_avg"]
    assert df.count() > 0
