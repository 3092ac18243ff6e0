import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from pairwright import catalogue


@pytest.fixture(scope="module")
def tables(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return con


def plain(v):
    return (None if math.isnan(v) else round(v, 6)) if isinstance(v, float) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, tables, name):
    df = catalogue.QUERIES[name](spark, sf)
    got = df.collect()
    if name in catalogue.ORACLES:
        want = tables.sql(catalogue.ORACLES[name])
        assert rows_of(df.columns, got) == rows_of(want.columns, want.fetchall())


def test_contract(spark):
    assert entry.entry(spark).count() == 174
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.QUERIES) <= set(entry.queries())
