"""Shared folder, materialised tables and size limits."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GROUP_ROWS_CONF = "spark.playtrace.groupRows"
GROUP_ROWS_DEFAULT = 2_000_000


def ship(spark: SparkSession) -> None:
    """Lets Python workers that see the driver's folders import this package; elsewhere it is installed or sent as py-files."""
    root, environment = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    if root not in environment.get("PYTHONPATH", "").split(":"):
        environment["PYTHONPATH"] = ":".join(filter(None, [environment.get("PYTHONPATH", ""), root]))


def group_rows(spark: SparkSession) -> int:
    """Largest number of rows of one key that an ordered window may give to a single task."""
    return int(spark.conf.get(GROUP_ROWS_CONF, str(GROUP_ROWS_DEFAULT)))


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a temporary one only in local mode."""
    context = spark.sparkContext
    named = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        named = tempfile.mkdtemp(prefix="playtrace-")
        context.setCheckpointDir(named)
    return named.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage at a place that outlives executors. Being columnar, each later branch reads only
    the columns it needs, and the planner knows the size.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int = 64 << 20) -> DataFrame:
    """A broadcast hint if the files of a materialised ``df`` hold at most ``limit`` bytes; else as it is."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= limit else df
