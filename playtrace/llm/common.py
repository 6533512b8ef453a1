"""What several operators share: tables, words as a column, intermediate tables."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playtrace.runtime import materialize

SEPARATORS = r"[\x20\x09-\x0D]+"
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Lets Python workers that see the driver's folders import this package; elsewhere it is installed or sent as py-files."""
    root, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in environment.get("PYTHONPATH", "").split(":"):
        environment["PYTHONPATH"] = ":".join(filter(None, [environment.get("PYTHONPATH", ""), root]))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATORS), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """A-Z become a-z; all other characters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, also where ``use`` reads it for each element of an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def settle(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back; its shuffle files go as soon as it is written.

    The written table outlives executors, so what follows never recomputes what came before.
    """
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP_CONF, "false")
    conf.set(CLEANUP_CONF, "true")
    try:
        return materialize(df, label)
    finally:
        conf.set(CLEANUP_CONF, before)


def bytes_of(df: DataFrame) -> int:
    """The planner's size of a settled table, which is the size of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = 32 << 20) -> DataFrame:
    """A broadcast hint only where the settled table's files are below ``limit`` bytes; else the planner's choice."""
    return F.broadcast(df) if bytes_of(df) <= limit else df
