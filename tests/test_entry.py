"""The driver contract: names agree, SQL gives the same rows, the engine works without the text-collection subpackage."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from quernstone.plans import registry

DATA = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6))
    return str(value)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_its_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    rows, columns = df.collect(), df.columns
    if name not in registry.SQL:
        return
    result = duck.execute(registry.SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(columns) == sorted(names)
    order, theirs = sorted(range(len(columns)), key=lambda i: columns[i]), sorted(range(len(names)), key=lambda i: names[i])
    assert sorted(tuple(plain(r[i]) for i in order) for r in rows) == sorted(tuple(plain(r[i]) for i in theirs) for r in result.fetchall())
