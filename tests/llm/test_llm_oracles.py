"""Operators with SQL give the same rows in Spark and DuckDB."""

import glob
import os

import duckdb
import pytest
from conftest import FOLDER

from playtrace.llm import queries  # noqa: F401
from playtrace.llm.registry import ORACLES, QUERIES

SPARK_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    cursor = duck.execute(ORACLES[name])
    described = {c[0]: str(c[1]) for c in cursor.description}
    assert {c: SPARK_TYPES[t] for c, t in df.dtypes} == described
    columns = list(described)
    left = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    right = sorted(repr(tuple(r)) for r in cursor.fetchall())
    assert left == right and left
