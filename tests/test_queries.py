"""Every registered query against its oracle on the smallest driver tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from codeloom.checks import ORACLES, QUERIES
from codeloom.checks.views import TABLES

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="driver tables not present")

SPARK_TO_DUCK = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "boolean": "BOOLEAN", "double": "DOUBLE", "date": "DATE"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def normal(value):
    return repr(value) if isinstance(value, float) and not math.isnan(value) else str(value)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_an_oracle():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    result = entry.queries()[name](spark, str(FOLDER))
    expected = duck.sql(entry.oracle_sql()[name])
    columns = sorted(result.columns)
    assert columns == sorted(expected.columns)
    types = dict(zip(expected.columns, map(str, expected.types)))
    assert {f.name: SPARK_TO_DUCK[f.dataType.simpleString()] for f in result.schema.fields} == types
    got = sorted(tuple(normal(row[c]) for c in columns) for row in result.collect())
    order = [expected.columns.index(c) for c in columns]
    want = sorted(tuple(normal(row[i]) for i in order) for row in expected.fetchall())
    assert got == want
