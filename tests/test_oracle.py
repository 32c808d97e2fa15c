"""Every registered query against its SQL counterpart on the given tables."""

import glob
import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql
from opsight.plans.catalog import QUERIES

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(oracle_sql())


def test_entry(spark):
    assert entry(spark).count() == 4


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, FOLDER)
    columns = sorted(found.columns)
    expected = duck.execute(oracle_sql()[name])
    names = [d[0] for d in expected.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    right = sorted((tuple(str(r[i]) for i in order) for r in expected.fetchall()))
    left = sorted(tuple(str(r[c]) for c in columns) for r in found.collect())
    assert left == right
