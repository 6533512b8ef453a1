"""Readers and writers of the log, the labels, the feature matrix and the predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from playtrace.config import DEFAULT_LOG, EventLog

EVENT_LOG_SCHEMA = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("game_session", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("event_data", T.StringType()),
    T.StructField("installation_id", T.StringType()),
    T.StructField("event_count", T.IntegerType()),
    T.StructField("event_code", T.IntegerType()),
    T.StructField("game_time", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("world", T.StringType()),
])

LABELS_SCHEMA = T.StructType([
    T.StructField("installation_id", T.StringType()),
    T.StructField("game_session", T.StringType()),
    T.StructField("accuracy_group", T.IntegerType()),
])

PREDICTIONS_SCHEMA = T.StructType([
    T.StructField("installation_id", T.StringType()),
    T.StructField("accuracy_group", T.IntegerType()),
])


def _read(spark: SparkSession, path: str, schema: T.StructType | None, kind: str | None = None, multi_line: bool = False) -> DataFrame:
    """``kind`` is csv or parquet; without it, CSV for a path that ends in ``.csv`` or ``.csv.gz``, else parquet.

    A CSV field that does not fit its type, or a row with too few or too many fields, fails the read rather than becoming null.
    Files are split, so a large log is read by many tasks; a quoted line break then fails the read. ``multi_line`` reads such files,
    each by one task.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind is None:
        kind = "csv" if path.rstrip("/").endswith((".csv", ".csv.gz")) else "parquet"
    if kind == "csv":
        return reader.csv(path, header=True, quote='"', escape='"', multiLine=multi_line, mode="FAILFAST")
    if kind != "parquet":
        raise ValueError(f"no reader for {kind}")
    return reader.parquet(path)


def read_event_log(
    spark: SparkSession, path: str, schema: T.StructType = EVENT_LOG_SCHEMA, kind: str | None = None, multi_line: bool = False
) -> DataFrame:
    return _read(spark, path, schema, kind, multi_line)


def read_labels(spark: SparkSession, path: str, schema: T.StructType = LABELS_SCHEMA, kind: str | None = None, multi_line: bool = False) -> DataFrame:
    return _read(spark, path, schema, kind, multi_line)


def read_feature_matrix(
    spark: SparkSession,
    features_path: str,
    labels_path: str,
    keys: list[str] | None = None,
    features_schema: T.StructType | None = None,
) -> DataFrame:
    """Features and their label column, joined on the keys rather than on row position."""
    keys = keys or DEFAULT_LOG.keys
    return _read(spark, features_path, features_schema).join(read_labels(spark, labels_path), keys, "inner")


def distinct_session_ids(df: DataFrame, log: EventLog = DEFAULT_LOG) -> DataFrame:
    return df.select(*log.keys).distinct()


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").csv(path, header=True, quote='"', escape='"')


def write_predictions(df: DataFrame, path: str, prediction: str = "prediction", log: EventLog = DEFAULT_LOG) -> None:
    """Entity and predicted group as CSV with a header; written in parts by the tasks that hold the rows."""
    write_csv(df.select(log.entity, F.col(prediction).cast("int").alias("accuracy_group")), path)
