"""Calendar rows of assessment sessions, including the original's repeated rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtrace.config import DEFAULT_LOG, EventLog
from playtrace.functions.scalars import is_assessment, strip_suffix_chars
from playtrace.plans.datasets import at_group_extreme


def calendar_rows(events: DataFrame, keep: str = "smallest_hour", log: EventLog = DEFAULT_LOG) -> DataFrame:
    """Distinct (title, world, month, hour, year, weekday) per assessment session.

    ``keep='smallest_hour'`` keeps the rows of the smallest hour of day, ``'all'`` keeps one row per hour
    touched (a session over two hours then has two rows, as in the variant without the hour filter). Both may
    leave several rows per session; the feature table uses ``blocks.calendar_columns``, which gives one.
    """
    ts = F.col(log.ts)
    rows = (
        events.filter(is_assessment(log))
        .select(
            *log.keys,
            strip_suffix_chars(F.col(log.title), log.title_strip_chars).alias(log.title),
            log.world,
            F.month(ts).alias("month"), F.hour(ts).alias("hour"),
            F.year(ts).alias("year"), F.weekday(ts).alias("dayofweek"),
        )
        .distinct()
    )
    if keep == "all":
        return rows
    return at_group_extreme(rows, log.keys, "hour", largest=False)
