"""The feature table: one row per ended assessment session, in the four published variants."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtrace.config import DEFAULT_LOG, EventLog
from playtrace.functions.scalars import is_assessment, strip_suffix_chars
from playtrace.operators.sessions import SessionSteps, title_measures
from playtrace.plans import blocks as B
from playtrace.plans.calendar import calendar_rows
from playtrace.runtime import materialize, small

HOURS, WEEKDAYS = list(range(24)), list(range(7))


@dataclass(frozen=True)
class Vocabulary:
    """Category values fitted once and applied to every data set, so that all get the same columns."""

    worlds: tuple[str, ...]
    titles: tuple[str, ...]


@dataclass(frozen=True)
class Variant:
    """Which columns a variant has. The switches follow the differences between the published scripts."""

    fails_and_accuracy: bool = False
    group_counts: bool = False
    counter: bool = False
    past_accuracy: bool = False
    past_fails: bool = False
    past_order: bool = False
    time_moments: bool = True
    assessments_played: bool = True
    std_total_time: bool = True
    calendar: tuple[str, ...] = ("month", "hour", "year", "dayofweek")
    calendar_one_hot: bool = False
    title_statistics: bool = False
    own_label: bool = False


VARIANTS = {
    "main": Variant(
        fails_and_accuracy=True, group_counts=True, past_accuracy=True, past_fails=True, assessments_played=False,
        calendar=("month", "hour", "dayofweek"), title_statistics=True,
    ),
    "boosted": Variant(past_order=True),
    "stacked": Variant(group_counts=True, counter=True, past_order=True, past_fails=True),
    "self_label": Variant(
        group_counts=True, counter=True, past_fails=True, time_moments=False, std_total_time=False,
        calendar=(), calendar_one_hot=True, own_label=True,
    ),
}


def distinct_values(df: DataFrame, column: str, max_values: int = 2000) -> list:
    """Sorted distinct non-null values. Raises above ``max_values``: they become columns, so must stay few."""
    found = df.select(column).distinct().filter(F.col(column).isNotNull()).limit(max_values + 1).collect()
    if len(found) > max_values:
        raise ValueError(f"{column} has more than {max_values} values, too many for one column each")
    return sorted(r[0] for r in found)


def fit_vocabulary(events: DataFrame, log: EventLog = DEFAULT_LOG, max_values: int = 2000) -> Vocabulary:
    """Worlds and stripped titles of the assessments; ``events`` may be the log or its session table.

    Raises above ``max_values`` of either, see ``distinct_values``.
    """
    assessments = events.filter(is_assessment(log))
    stripped = assessments.select(
        log.world, strip_suffix_chars(F.col(log.title), log.title_strip_chars).alias(log.title))
    return Vocabulary(tuple(distinct_values(stripped, log.world, max_values)), tuple(distinct_values(stripped, log.title, max_values)))


def _columns(variant: Variant, dummies: list[str], log: EventLog) -> list[str]:
    frequency = B.frequency_per_type(log).outputs
    skip_past = set() if variant.fails_and_accuracy else {
        c for c in B.previous_accuracy().outputs if c.endswith(("_fails", "_accuracy"))}
    if not variant.group_counts:
        skip_past |= set(B.GROUP_COUNTS)
    past = [c for c in B.previous_accuracy().outputs if c not in skip_past]
    times = B.past_assessment_time_events().outputs
    out = [c for c in frequency if variant.assessments_played or c != "assessments_played"]
    out += [c for c in B.time_per_type(log).outputs if variant.std_total_time or c != "std_total_time_spent"]
    out += [*variant.calendar, *dummies]
    out += ["past_total_attempts", "past_total_successes", "past_assessments_played"]
    out += ["past_total_accuracy"] if variant.past_accuracy else []
    out += ["past_total_fails"] if variant.past_fails else []
    out += ["game_session_order"] if variant.past_order else []
    out += times if variant.time_moments else times[:2]
    out += B.time_and_events_till_attempt().outputs
    out += B.time_per_world(log).outputs + B.level_reached(log).outputs
    out += past + (["assessments_played_counter"] if variant.counter else [])
    return out


TITLE_STATISTICS = [
    "overall_mean_game_session_time", "overall_mean_attempt",
    "overall_mean_is_attempt_successful", "overall_mean_accuracy",
]


def build_features(
    events: DataFrame,
    variant: str | Variant = "main",
    vocabulary: Vocabulary | None = None,
    log: EventLog = DEFAULT_LOG,
    allow_fanout: bool = False,
    include_current: bool = True,
) -> DataFrame:
    """Keys plus the variant's feature columns, one row per ended assessment session.

    The log is read for one hash aggregate to sessions and one filtered pass over attempts; both are written
    once. All histories then share a single layout by entity and one sort per order. No block joins are needed
    except with the per-title statistics, which have one row per title.

    With ``allow_fanout`` a session has one row per distinct calendar value instead: within its smallest hour
    of day, or over all its hours where the variant has the hour one-hot.
    """
    chosen = VARIANTS[variant] if isinstance(variant, str) else variant
    calendar = None
    if allow_fanout:
        parts = ["hour", "dayofweek"] if chosen.calendar_one_hot else list(chosen.calendar)
        rows = calendar_rows(events, "all" if chosen.calendar_one_hot else "smallest_hour", log)
        calendar = rows.select(*log.keys, *parts).distinct()
    return features_of(SessionSteps(events, log), chosen, vocabulary, calendar, include_current)


def features_of(
    steps: SessionSteps,
    variant: str | Variant = "main",
    vocabulary: Vocabulary | None = None,
    calendar: DataFrame | None = None,
    include_current: bool = True,
) -> DataFrame:
    """``build_features`` over sessions that are prepared already.

    Without a vocabulary the worlds and titles of these sessions are used; pass the one fitted on the training
    log to give a test set the same columns. ``calendar`` replaces the calendar columns by its own rows, of
    which a session may have several. Totals by type and world and levels count the session itself unless
    ``include_current`` is false.
    """
    log = steps.log
    chosen = VARIANTS[variant] if isinstance(variant, str) else variant
    vocabulary = vocabulary or fit_vocabulary(steps.sessions, log)

    first = [B.assessment_counter(), B.previous_accuracy(), B.past_assessment_time_events(),
             B.time_and_events_till_attempt(), B.previous_mean_duration()]
    terminal = [B.session_order(log), B.running_attempts(log), B.past_attempts_and_successes(log),
                *[b(log, include_current) for b in (B.frequency_per_type, B.time_per_type, B.time_per_world, B.level_reached)]]
    scan = steps.both_orders(lambda s: B.run_blocks(s, first))
    rows = B.run_blocks(scan, terminal).result().filter(F.col("terminal") & (F.col("role") == "assessment"))

    title = strip_suffix_chars(F.col(log.title), log.title_strip_chars)
    if calendar is None:
        rows = rows.withColumns(B.calendar_columns(log))
    else:
        rows = rows.join(calendar, log.keys, "inner")
    dummies = B.one_hot(F.col(log.world), vocabulary.worlds, "world_") | B.one_hot(title, vocabulary.titles, "title_")
    if chosen.calendar_one_hot:
        dummies |= B.one_hot(F.col("hour"), HOURS, "hour_") | B.one_hot(F.col("dayofweek"), WEEKDAYS, "weekday_")
    rows = rows.withColumns(dummies)

    columns = _columns(chosen, list(dummies), log)
    if chosen.title_statistics:
        rows = rows.drop("mean_duration").withColumnRenamed("past_mean_duration", "mean_duration")
        rows = rows.join(small(materialize(title_measures(steps.sessions, log), "titles")), log.title, "inner")
        columns += [*TITLE_STATISTICS, "mean_duration"]
    if chosen.own_label:
        columns.append("accuracy_group")
    return rows.select(*log.keys, *columns)
