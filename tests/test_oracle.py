"""Every registered query that has SQL gives the rows DuckDB gives."""

import os
from importlib import import_module

import duckdb
import pytest

import __spark_entry__ as entry
from shotspark import catalog

NAMES = [n for family in catalog.FAMILIES for n in import_module(f"shotspark.catalog.{family}").QUERIES]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return con


def text(v):
    return repr(v) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    assert len(set(cols)) == len(cols)
    got = sorted(tuple(map(text, r)) for r in df.select(*cols).collect())
    if name not in entry.oracle_sql():
        return
    rel = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(tuple(text(r[i]) for i in at) for r in rel.fetchall())
