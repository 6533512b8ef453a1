"""Row expressions: flags, labels, ratios, calendar parts and text helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from playtrace.config import DEFAULT_LOG, EventLog


def parse_timestamp(column: Column) -> Column:
    """ISO-8601 text to timestamp; unreadable text becomes null."""
    return F.try_to_timestamp(column)


def calendar_parts(ts: Column) -> dict[str, Column]:
    """Date, month, hour, year and weekday (Monday = 0)."""
    return {
        "date": F.to_date(ts),
        "month": F.month(ts),
        "hour": F.hour(ts),
        "year": F.year(ts),
        "dayofweek": F.weekday(ts),
    }


def contains_token(text: Column, token: str) -> Column:
    """Substring test; null text holds no token."""
    return F.coalesce(text.contains(token), F.lit(False))


def is_assessment(log: EventLog = DEFAULT_LOG) -> Column:
    return F.coalesce(F.col(log.kind) == log.assessment, F.lit(False))


def attempt_flag(log: EventLog = DEFAULT_LOG) -> Column:
    """1 on an assessment event whose code is the attempt code of its title, else 0."""
    special = F.col(log.title).eqNullSafe(F.lit(log.special_title))
    code = F.col(log.code)
    plain_try = (code == log.attempt_code) & ~special & F.col(log.title).isNotNull()
    special_try = (code == log.special_code) & special
    return F.when(is_assessment(log) & (plain_try | special_try), 1).otherwise(0)


def success_flag(log: EventLog = DEFAULT_LOG) -> Column:
    """1 on an attempt whose payload holds the success token, else 0."""
    won = (attempt_flag(log) == 1) & contains_token(F.col(log.payload), log.success_token)
    return F.when(won, 1).otherwise(0)


def accuracy_group(successes: Column, attempts: Column) -> Column:
    """Ordinal label: 3 all right, 2 exactly half, 1 below half, else 0.

    Everything else includes no attempt at all and a share strictly between one half and one.
    """
    s, a = successes, attempts
    return (
        F.when((a > 0) & (s == a), 3)
        .when((a > 0) & (2 * s == a), 2)
        .when((s > 0) & (2 * s < a), 1)
        .otherwise(0)
    )


def safe_ratio(top: Column, bottom: Column) -> Column:
    """Quotient with 0/0 (and any division by zero) as 0."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom), F.lit(0.0))


def level_of(title: Column, word: str = DEFAULT_LOG.level_word) -> Column:
    """Last character of a title that names a level, as a number; 0 without the word, null if no digit."""
    digit = F.right(F.trim(title), F.lit(1)).try_cast("int")
    return F.when(contains_token(title, word), digit).otherwise(0)


def strip_suffix_chars(text: Column, chars: str = DEFAULT_LOG.title_strip_chars) -> Column:
    """Drop trailing characters that occur in ``chars`` (a set of characters, not a suffix)."""
    return F.rtrim(text, F.lit(chars))


def row_sum(*columns: Column) -> Column:
    """Sum across columns, nulls skipped."""
    return reduce(lambda x, y: x + y, [F.coalesce(c, F.lit(0)) for c in columns])


def paste(*columns: Column, sep: str = " ") -> Column:
    """Join the columns' text forms with ``sep``."""
    return F.concat_ws(sep, *[c.cast("string") for c in columns])


def slug(text: object) -> str:
    """Lower-case column-name form of a category value."""
    kept = "".join(ch.lower() if ch.isalnum() else " " for ch in str(text))
    return "_".join(kept.split())


def micros(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970 of a timestamp column with or without zone."""
    if isinstance(df.schema[column].dataType, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(column))
    return F.unix_micros(F.col(column))


def with_flags(df: DataFrame, log: EventLog = DEFAULT_LOG) -> DataFrame:
    """Add ``attempt`` and ``is_attempt_successful`` to every event."""
    return df.withColumns({"attempt": attempt_flag(log), "is_attempt_successful": success_flag(log)})
