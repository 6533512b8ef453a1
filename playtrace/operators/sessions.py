"""From events to sessions: the one heavy pass over the log, and the frames built on it."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtrace.config import DEFAULT_LOG, EventLog
from playtrace.functions.json import json_field
from playtrace.functions.scalars import accuracy_group, attempt_flag, is_assessment, micros, success_flag, with_flags
from playtrace.operators.aggregates import join_on_keys
from playtrace.operators.scan import KeySizes, OrderedScan, key_sizes, total
from playtrace.runtime import materialize


def _progress(log: EventLog) -> Column:
    """Play time and event counter of a row in one number, so that both maxima can be compared at once."""
    return F.col(log.elapsed).cast("decimal(24,0)") * F.lit(Decimal(10**13)) + F.col(log.count).cast("decimal(13,0)")


def session_frame(events: DataFrame, log: EventLog = DEFAULT_LOG, merged: bool = True) -> DataFrame:
    """One row per session with everything the session-level operators need.

    All aggregates keep fixed-width buffers, so Spark combines them in hash maps before the shuffle: a session
    that holds a third of the log arrives as one partial row per map task. ``terminal`` tells whether some row
    has both the largest play time and the largest event counter; sessions without one are left out of the
    terminal-order operators, as in the original rules.

    A session is taken to have one type, title and world. One that has several (or nulls beside them) still becomes one row,
    by a second and much smaller aggregate over the keys alone; without ``merged`` it is one row for each.
    """
    hour_then_time = F.hour(log.ts).cast("bigint") * F.lit(10**17) + micros(events, log.ts)
    tried = F.col("_attempt") == 1
    flagged = events.select(
        *log.keys, log.kind, log.title, log.world, log.ts, log.elapsed, log.count,
        attempt_flag(log).alias("_attempt"),
        success_flag(log).alias("_success"),
        _progress(log).alias("_progress"),
        hour_then_time.alias("_hour_then_time"),
        F.when(is_assessment(log), json_field(F.col(log.payload), log.duration_field, "double")).alias("_duration"),
    )
    # First with the texts as keys, so that buffers stay fixed-width; then the few parts of each session are merged.
    parts = flagged.groupBy(*log.keys, log.kind, log.title, log.world).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.min(log.ts).alias("first_ts"),
        F.max_by(log.ts, "_progress").alias("last_ts"),
        F.max_by(log.count, "_progress").alias("last_count"),
        F.max("_progress").alias("_top"),
        F.max(log.elapsed).alias("session_time"),
        F.max(log.count).cast("bigint").alias("session_events"),
        F.sum("_attempt").alias("attempts"),
        F.sum("_success").alias("successes"),
        F.max(F.when(tried, F.col(log.count))).alias("try_events"),
        F.max(F.when(tried, F.col(log.elapsed))).alias("try_time"),
        F.sum("_duration").alias("_duration"),
        F.count("_duration").alias("_durations"),
        F.min_by(log.ts, "_hour_then_time").alias("calendar_ts"),
        F.min("_hour_then_time").alias("_hour_then_time"),
    )
    whole = {"try_events": F.coalesce("try_events", F.lit(0)).cast("bigint"), "try_time": F.coalesce("try_time", F.lit(0)).cast("bigint"),
             "mean_duration": F.try_divide("_duration", "_durations")}
    grouped = parts.withColumns(whole).drop("_duration", "_durations", "_hour_then_time") if not merged else parts.groupBy(*log.keys).agg(
        *[F.max(c).alias(c) for c in (log.kind, log.title, log.world)],  # of a mixed session the largest, never two rows
        F.sum("_rows").alias("_rows"),
        F.min("first_ts").alias("first_ts"),
        F.max_by("last_ts", "_top").alias("last_ts"),
        F.max_by("last_count", "_top").alias("last_count"),
        F.max("_top").alias("_top"),
        F.max("session_time").alias("session_time"),
        F.max("session_events").alias("session_events"),
        F.sum("attempts").alias("attempts"),
        F.sum("successes").alias("successes"),
        F.coalesce(F.max("try_events"), F.lit(0)).cast("bigint").alias("try_events"),
        F.coalesce(F.max("try_time"), F.lit(0)).cast("bigint").alias("try_time"),
        F.try_divide(F.sum("_duration"), F.sum("_durations")).alias("mean_duration"),
        F.min_by("calendar_ts", "_hour_then_time").alias("calendar_ts"),
    )
    both = F.col("session_time").cast("decimal(24,0)") * F.lit(Decimal(10**13)) + F.col("session_events")
    return (
        grouped
        .withColumn("terminal", F.coalesce(F.col("_top") == both, F.lit(False)))
        .withColumn("fails", F.col("attempts") - F.col("successes"))
        .withColumn("accuracy_group", accuracy_group(F.col("successes"), F.col("attempts")))
        .withColumn("has_plain_row", F.col("_rows") > F.col("attempts"))
        .drop("_rows", "_top")
    )


def attempt_rows(events: DataFrame, log: EventLog = DEFAULT_LOG) -> DataFrame:
    """Attempt events only, copies of one event added up. The filter reaches the scan."""
    return (
        with_flags(events.filter(F.col(log.kind) == log.assessment)
                   .filter(F.col(log.code).isin(log.attempt_code, log.special_code)), log)
        .filter("attempt = 1")
        .groupBy(*log.keys, F.col(log.ts).alias("last_ts"), F.col(log.count).alias("last_count"))
        .agg(F.sum("attempt").alias("attempt"), F.sum("is_attempt_successful").alias("success"))
    )


# Places a row among the rows of its entity, by its last (terminal) event; attempts come before the session's end.
def terminal_order(log: EventLog = DEFAULT_LOG) -> list[str]:
    return ["last_ts", log.session, "last_count", "step"]


def first_order(log: EventLog = DEFAULT_LOG) -> list[str]:
    return ["first_ts", log.session]


class SessionSteps:
    """Sessions and attempt events of every entity in one table, written once.

    ``role`` is ``assessment`` or ``other`` for session rows and ``attempt`` for attempt events. Ordered by
    terminal event, it yields all histories that run over earlier sessions *and* the attempts made up to a
    given event, also when sessions of one entity overlap in time.
    """

    def __init__(self, events: DataFrame, log: EventLog = DEFAULT_LOG):
        self.log = log
        role = F.when(is_assessment(log), "assessment").otherwise("other")
        sessions = session_frame(events, log, merged=True).withColumns({"role": role, "step": F.lit(1)})
        attempts = attempt_rows(events, log).withColumns({"role": F.lit("attempt"), "step": F.lit(0)})
        self.table = materialize(sessions.unionByName(attempts, allowMissingColumns=True), "steps")
        self._sizes: KeySizes | None = None

    @property
    def sizes(self) -> KeySizes:
        """Rows per entity; also bounds the rows of any finer key."""
        if self._sizes is None:
            self._sizes = key_sizes(self.table, [self.log.entity])
        return self._sizes

    @property
    def sessions(self) -> DataFrame:
        return self.table.filter(F.col("role") != "attempt").drop("role", "step", "attempt", "success")

    @property
    def assessments(self) -> DataFrame:
        return self.sessions.filter(is_assessment(self.log))

    def by_first_event(self) -> OrderedScan:
        """Assessment sessions of each entity in order of first appearance."""
        return OrderedScan(self.assessments, [self.log.entity], first_order(self.log), sizes=self.sizes)

    def by_terminal_event(self) -> OrderedScan:
        """All sessions and attempts of each entity in order of terminal event."""
        return OrderedScan(self.table, [self.log.entity], terminal_order(self.log), sizes=self.sizes)

    def both_orders(self, first) -> OrderedScan:
        """``first`` applied in first-event order per role, then the terminal-order scan over its result.

        Laid out by entity once; both windows then only sort.
        """
        table = self.table
        scan = OrderedScan(table, [self.log.entity, "role"], first_order(self.log), sizes=self.sizes)
        if not scan.chunked:
            scan.df = table.repartition(self.log.entity)
        first(scan)
        return OrderedScan(scan.result(), [self.log.entity], terminal_order(self.log), sizes=self.sizes)


def title_measures(sessions: DataFrame, log: EventLog = DEFAULT_LOG) -> DataFrame:
    """Means per assessment title over the *distinct* (time, attempt, success) tuples of its events.

    A session contributes at most three tuples: a row that is no attempt, a failed and a successful attempt.
    """
    kinds = F.array_compact(F.array(
        F.when(F.col("has_plain_row"), F.struct(F.lit(0).alias("a"), F.lit(0).alias("s"))),
        F.when(F.col("fails") > 0, F.struct(F.lit(1).alias("a"), F.lit(0).alias("s"))),
        F.when(F.col("successes") > 0, F.struct(F.lit(1).alias("a"), F.lit(1).alias("s"))),
    ))
    tuples = (
        sessions.filter(is_assessment(log))
        .select(log.title, "session_time", F.explode(kinds).alias("k"))
        .select(log.title, "session_time", "k.a", "k.s")
        .distinct()
    )
    means = tuples.groupBy(log.title).agg(
        F.avg("session_time").alias("overall_mean_game_session_time"),
        F.avg("a").alias("overall_mean_attempt"),
        F.avg("s").alias("overall_mean_is_attempt_successful"),
    )
    share = F.try_divide("overall_mean_is_attempt_successful", "overall_mean_attempt")
    return means.withColumn("overall_mean_accuracy", share)


def with_session_measures(
    events: DataFrame, log: EventLog = DEFAULT_LOG, onto: DataFrame | None = None
) -> DataFrame:
    """Session totals, assessment totals and the assessment counter on every event (or on the rows ``onto``).

    Aggregate and join back rather than a window: a hot session is then combined before the shuffle, and its
    events can be split by the adaptive skew join.
    """
    sessions = materialize(session_frame(events, log, merged=True), "sessions")
    counted = (
        OrderedScan(sessions, [log.entity], first_order(log))
        .with_running(assessments_played_counter=total(is_assessment(log).cast("bigint")))
        .result()
    )
    only = lambda c: F.when(is_assessment(log), F.col(c))
    measures = counted.select(
        *log.keys,
        F.col("session_time").alias("total_game_session_time"),
        F.col("session_events").alias("total_game_session_events"),
        only("session_time").alias("assessment_session_time"),
        only("session_events").alias("assessment_number_of_events"),
        only("assessments_played_counter").alias("assessments_played_counter"),
    )
    return join_on_keys(events if onto is None else onto, measures, log.keys)


def with_running_attempts(events: DataFrame, log: EventLog = DEFAULT_LOG) -> DataFrame:
    """Attempts, successes and fails of the entity up to and including each event.

    The payload, by far the widest column, is read for the flags and not carried through the sort.
    """
    flagged = with_flags(events, log).drop(log.payload)
    scan = OrderedScan(flagged, [log.entity], [log.ts, log.session, log.count])
    scan.with_running(
        cumulative_attempts=total(F.col("attempt")),
        cumulative_successes=total(F.col("is_attempt_successful")),
    )
    return scan.result().withColumn("cumulative_fails", F.col("cumulative_attempts") - F.col("cumulative_successes"))


def prepare_events(events: DataFrame, log: EventLog = DEFAULT_LOG) -> DataFrame:
    """The event frame with flags, session measures and running attempts, without the payload."""
    return with_session_measures(events, log, onto=with_running_attempts(events, log))
