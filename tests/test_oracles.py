"""Every query with SQL gives the same rows in Spark and DuckDB."""

import glob
import os

import duckdb
import pytest
from conftest import FOLDER

import __spark_entry__ as entry

SPARK_TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def canon(row):
    return tuple(repr(0.0 if isinstance(v, float) and v == 0 else v) for v in row)


def compare(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    cursor = duck.execute(entry.oracle_sql()[name])
    described = {c[0]: str(c[1]) for c in cursor.description}
    order = [c[0] for c in cursor.description]
    expected = cursor.fetchall()
    assert sorted(order) == columns
    assert {c: SPARK_TYPES[t] for c, t in df.dtypes} == described
    places = [order.index(c) for c in columns]
    left = sorted(canon(r[c] for c in columns) for r in df.collect())
    right = sorted(canon(r[i] for i in places) for r in expected)
    assert left == right
    assert left


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    compare(spark, duck, name)


HOT = ["w1_running_attempts", "w2_assessment_counter", "b12_title_history", "b13_event_code_history", "w12_second_last_assessment",
       "b15_features_main", "l1_balanced_resample_over"]


@pytest.mark.parametrize("name", HOT)
def test_matches_sql_when_keys_are_hot(spark, duck, hot_keys, name):
    compare(spark, duck, name)


def test_every_query_is_registered_once_and_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.select("installation_id", "game_session").distinct().count() == df.count()
