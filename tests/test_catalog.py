"""Every catalogued query against its DuckDB SQL on the smallest tables."""

import datetime as dt
import os

import duckdb
import pytest

from larkspur import catalog

SMALL = "/root/testdata/sf0.001"
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "TIMESTAMP": "timestamp_ntz", "DATE": "date", "BOOLEAN": "boolean"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for name in os.listdir(SMALL):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS FROM '{SMALL}/{name}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6) + 0.0
    return value.isoformat() if isinstance(value, (dt.date, dt.datetime)) else value


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, SMALL)
    want = duck.sql(catalog.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    kinds = dict(df.dtypes)
    assert {c: kinds[c] for c in columns} == {c: TYPES[str(t)] for c, t in zip(want.columns, want.types, strict=True)}
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    held = [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
    assert got == sorted((tuple(plain(r[c]) for c in columns) for r in held), key=str)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_oracle_runs(spark, name):
    assert catalog.QUERIES[name](spark, SMALL).count() > 0
