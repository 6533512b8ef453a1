"""Named queries over the given tables, most with the SQL another engine runs for the same answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function: Query) -> Query:
        QUERIES[name] = lambda spark, folder: plain_types(function(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def plain_types(df: DataFrame, digits: int = 6) -> DataFrame:
    """Integers as bigint, fractions rounded, so that two engines can be compared by value."""
    columns = []
    for field in df.schema.fields:
        column, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, T.IntegralType):
            column = column.cast("bigint")
        elif isinstance(kind, T.FractionalType):
            column = F.round(column.cast("double"), _digits(field.name, digits))
        columns.append(column.alias(field.name))
    return df.select(*columns)


def _digits(name: str, digits: int) -> int:
    """Deviations of millisecond values have too many digits for six decimals."""
    return 3 if name.startswith(("cumsd", "std_total")) else digits
