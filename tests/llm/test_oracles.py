"""Queries of the subpackage that SQL can express, against DuckDB."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from codeloom.llm.queries import ORACLES, QUERIES

FOLDER = Path("/root/testdata/sf0.001")
TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER"}


@pytest.mark.skipif(not FOLDER.exists(), reason="driver tables not present")
@pytest.mark.parametrize("name", list(ORACLES))
def test_query_matches_oracle(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "embeddings"):
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    want, got = connection.sql(ORACLES[name]), QUERIES[name](spark, str(FOLDER))
    assert {f.name: TYPES[f.dataType.simpleString()] for f in got.schema.fields} == dict(zip(want.columns, map(str, want.types)))
    assert Counter(tuple(r) for r in got.select(*want.columns).collect()) == Counter(want.fetchall())
