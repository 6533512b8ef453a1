"""View of a plain activity table (user, time, type, JSON properties) as an event log.

The activity table has no sessions, titles or attempt codes; they are derived here by fixed rules, so that
every operator can run over the given tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playtrace.operators.scan import OrderedScan, latest, position, previous, total
from playtrace.runtime import materialize

# Fixed values of the view.
SESSION_GAP_SECONDS = 43_200
WORLDS = ["NONE", "TREETOPCITY", "MAGMAPEAK", "CRYSTALCAVES"]
ASSESSMENT_TITLES = ["Bird Measurer", "Block Stacker", "Pan Balancer", "Shell Sorter", "Big Tent"]
GAME_TITLES = ["Hoop Roll", "Jar Fill", "Rope Swing"]
ACTIVITY_TITLES = ["Sand Play", "Egg Hunt"]


def _pick(values: list[str], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


def _seconds_between(start: str, end: str) -> Column:
    """Exact seconds with microseconds, whatever the session's time zone."""
    return (F.col(end) - F.col(start)).cast("interval second").cast("decimal(20,6)")


def game_events(spark: SparkSession, folder: str) -> DataFrame:
    """Event log with the columns of ``EventLog`` derived from ``events``."""
    raw = spark.read.parquet(f"{folder}/events.parquet").select(
        "user_id", "ts", "event_id", "event_type",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    scan = OrderedScan(raw, ["user_id"], ["ts", "event_id"])
    scan.with_running(before_ts=previous(F.col("ts")), place=position())
    fresh = F.col("before_ts").isNull() | (_seconds_between("before_ts", "ts") > SESSION_GAP_SECONDS)
    head = F.struct("event_type", "k", "ts", "place")
    scan.with_running(seq=total(fresh.cast("bigint")), head=latest(F.when(fresh, head)))

    ft, fk, k = F.col("head.event_type"), F.col("head.k"), F.col("k")
    kind = (
        F.when(ft.isin("purchase", "error"), "Assessment")
        .when(ft == "signup", "Game")
        .when(ft == "click", "Activity")
        .otherwise("Clip")
    )
    title = (
        F.when(F.col("type") == "Assessment", F.concat(_pick(ASSESSMENT_TITLES, fk), F.lit(" (Assessment)")))
        .when(F.col("type") == "Clip", F.concat(F.lit("Trail - Level "), (fk % 3 + 1).cast("string")))
        .when(F.col("type") == "Game", _pick(GAME_TITLES, fk))
        .otherwise(_pick(ACTIVITY_TITLES, fk))
    )
    bird = F.col("title").startswith("Bird")
    in_assessment = F.col("type") == "Assessment"
    code = (
        F.when(in_assessment & F.col("event_type").isin("purchase", "click"), F.when(bird, 4110).otherwise(4100))
        .when(in_assessment & (F.col("event_type") == "view"), F.when(bird, 4100).otherwise(4110))
        .otherwise(2000 + 10 * (k % 4))
    )
    payload = F.concat(
        F.lit('{"event_code":'), F.col("event_code").cast("string"),
        F.lit(',"correct":'), F.when(k % 2 == 0, "true").otherwise("false"),
        F.when(k % 5 == 0, "").otherwise(F.concat(F.lit(',"duration":'), (k * 100).cast("string"))),
        F.lit("}"),
    )
    entity = F.concat(F.lit("i"), F.lpad(F.col("user_id").cast("string"), 6, "0"))
    return (
        scan.result()
        .withColumn("installation_id", entity)
        .withColumn("game_session", F.concat("installation_id", F.lit("-"), F.lpad(F.col("seq").cast("string"), 4, "0")))
        .withColumn("event_count", (F.col("place") - F.col("head.place") + 1).cast("int"))
        .withColumn("game_time", F.floor(_seconds_between("head.ts", "ts") * 1000).cast("bigint"))
        .withColumn("type", kind)
        .withColumn("world", _pick(WORLDS, fk))
        .withColumn("title", title)
        .withColumn("event_code", code)
        .withColumn("event_data", payload)
        .select(
            F.col("event_id").cast("string").alias("event_id"), "game_session", F.col("ts").alias("timestamp"),
            "event_data", "installation_id", "event_count", "event_code", "game_time", "title", "type", "world",
        )
    )


def stored_game_events(spark: SparkSession, folder: str) -> DataFrame:
    """The same log written down, for callers that read it more than once."""
    return materialize(game_events(spark, folder), "log")
