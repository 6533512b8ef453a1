"""Feature blocks: histories of each assessment session, declared as running measures.

A block runs in up to two stages on an ordered scan. Stage one reads the session columns, ``derive`` computes
from its results, stage two may run over those, and ``finish`` gives the output columns. Blocks that share an
order are merged stage by stage, so a feature table costs one sort per order whatever the number of blocks.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtrace.config import DEFAULT_LOG, EventLog
from playtrace.functions.scalars import (
    accuracy_group, attempt_flag, is_assessment, level_of, row_sum, safe_ratio, slug, success_flag,
)
from playtrace.operators.scan import OrderedScan, Running, deviation, highest, latest, mean, position, previous, total
from playtrace.operators.sessions import SessionSteps, first_order
from playtrace.runtime import materialize

PAST = ["ag", "att", "succ", "fails", "accuracy"]
GROUP_COUNTS = ["zeros", "ones", "twos", "threes"]


@dataclass
class Block:
    outputs: list[str]
    start: dict[str, Running] = field(default_factory=dict)
    derive: dict[str, Column] = field(default_factory=dict)
    follow: dict[str, Running] = field(default_factory=dict)
    finish: dict[str, Column] = field(default_factory=dict)


def _zero(column: Column | str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column, F.lit(0))


def run_blocks(scan: OrderedScan, blocks: list[Block]) -> OrderedScan:
    for stage in ("start", "derive", "follow", "finish"):
        merged = {}
        for block in blocks:
            merged.update(getattr(block, stage))
        if not merged:
            continue
        if stage in ("start", "follow"):
            scan.with_running(**merged)
        else:
            scan.df = scan.df.withColumns(merged)
    return scan


# --- histories over assessments, in order of first appearance ---


def assessment_counter() -> Block:
    """1-based rank of the assessment session within its entity."""
    return Block(["assessments_played_counter"], start={"assessments_played_counter": position()})


def previous_accuracy() -> Block:
    """Label, attempts, successes, fails and accuracy of the previous assessment, their running means and
    deviations, and how often each label has occurred. The first assessment's filled-in 0 counts as a label 0."""
    past = {f"past_assessment_{n}": n for n in PAST}
    start = {
        "past_assessment_ag": previous(F.col("accuracy_group")),
        "past_assessment_att": previous(F.col("attempts")),
        "past_assessment_succ": previous(F.col("successes")),
        "past_assessment_fails": previous(F.col("fails")),
    }
    derive = {c: _zero(c) for c in start}
    derive["past_assessment_accuracy"] = safe_ratio(
        _zero("past_assessment_succ"), _zero("past_assessment_att"))
    follow = {f"cummean_{n}": mean(F.col(c)) for c, n in past.items()}
    follow |= {f"cumstd_{n}": deviation(F.col(c)) for c, n in past.items()}
    for value, name in enumerate(GROUP_COUNTS):
        follow[name] = total((F.col("past_assessment_ag") == value).cast("bigint"))
    finish = {f"cumstd_{n}": _zero(f"cumstd_{n}") for n in PAST}
    outputs = [*past, *[f"cummean_{n}" for n in PAST], *[f"cumstd_{n}" for n in PAST], *GROUP_COUNTS]
    return Block(outputs, start, derive, follow, finish)


def _lag_with_moments(source: dict[str, str], means: dict[str, str], deviations: dict[str, str]) -> Block:
    """Previous value (0 at first) of each source column, with running mean and deviation of that."""
    return Block(
        outputs=[*source, *means, *deviations],
        start={name: previous(F.col(column)) for name, column in source.items()},
        derive={name: _zero(name) for name in source},
        follow={n: mean(F.col(c)) for n, c in means.items()} | {n: deviation(F.col(c)) for n, c in deviations.items()},
        finish={n: _zero(n) for n in deviations},
    )


def past_assessment_time_events() -> Block:
    time, events = "past_assessment_session_time", "past_assessment_number_of_events"
    return _lag_with_moments(
        {time: "session_time", events: "session_events"},
        {"cum_average_time": time, "cum_average_events": events},
        {"cumsd_time": time, "cumsd_events": events},
    )


def time_and_events_till_attempt() -> Block:
    """Time and event number of the last attempt in the previous assessment.

    The lag stays within the entity; the original shifts over all rows and so leaks from one entity to the next.
    """
    time, events = "time_past_till_attempt", "num_of_events_till_attempt"
    return _lag_with_moments(
        {f"prev_assessment_{time}": "try_time", f"prev_assessment_{events}": "try_events"},
        {f"cummean_assessment_{n}": f"prev_assessment_{n}" for n in (time, events)},
        {f"cumsd_assessment_{n}": f"prev_assessment_{n}" for n in (time, events)},
    )


def previous_mean_duration() -> Block:
    """Mean payload duration of the previous assessment (within the entity); 0 when there is none."""
    return Block(
        ["past_mean_duration"],
        start={"past_mean_duration": previous(F.col("mean_duration"))},
        finish={"past_mean_duration": _zero("past_mean_duration").cast("double")},
    )


# --- histories over all sessions, in order of terminal event ---


def _ended() -> Column:
    return F.coalesce(F.col("terminal"), F.lit(False))


def _ended_assessment(log: EventLog) -> Column:
    return _ended() & is_assessment(log)


def _kinds(log: EventLog) -> dict[str, str]:
    return {"activities": log.activity, "games": log.game, "assessments": log.assessment, "clips": log.clip}


def session_order(log: EventLog = DEFAULT_LOG) -> Block:
    """Place of the session among the ended sessions of its entity, and play time so far."""
    return Block(
        ["game_session_order", "cumulative_time_spent"],
        start={
            "game_session_order": total(F.when(_ended(), F.lit(1).cast("bigint"))),
            "cumulative_time_spent": total(F.when(_ended(), F.col("session_time"))),
        },
    )


def running_attempts(log: EventLog = DEFAULT_LOG) -> Block:
    """Attempts of the entity up to and including the terminal event of each session."""
    return Block(
        ["cumulative_attempts", "cumulative_successes", "cumulative_fails"],
        start={
            "cumulative_attempts": total(_zero("attempt").cast("bigint")),
            "cumulative_successes": total(_zero("success").cast("bigint")),
        },
        derive={"cumulative_fails": F.col("cumulative_attempts") - F.col("cumulative_successes")},
    )


def past_attempts_and_successes(log: EventLog = DEFAULT_LOG) -> Block:
    """Attempt totals as they stood at the end of the previous assessment.

    Needs ``running_attempts`` in the same scan and ``assessments_played_counter`` among the columns.
    """
    then = lambda c: latest(F.when(_ended_assessment(log), F.col(c)), before=True)
    counts = {
        "past_total_attempts": "cumulative_attempts",
        "past_total_successes": "cumulative_successes",
        "past_total_fails": "cumulative_fails",
        "past_assessments_played": "assessments_played_counter",
    }
    return Block(
        [*counts, "past_total_accuracy"],
        follow={name: then(column) for name, column in counts.items()},
        finish={name: _zero(name) for name in counts}
        | {"past_total_accuracy": safe_ratio(_zero("past_total_successes"), _zero("past_total_attempts"))},
    )


def frequency_per_type(log: EventLog = DEFAULT_LOG, include_current: bool = True) -> Block:
    names = {f"{plural}_played": kind for plural, kind in _kinds(log).items()}
    start = {
        name: total(F.when(_ended() & (F.col(log.kind) == kind), F.lit(1).cast("bigint")), not include_current)
        for name, kind in names.items()
    }
    start["total_games_played"] = total(F.when(_ended(), F.lit(1).cast("bigint")), not include_current)
    return Block(["total_games_played", *names], start, finish={n: _zero(n) for n in ["total_games_played", *names]})


def time_per_type(log: EventLog = DEFAULT_LOG, include_current: bool = True) -> Block:
    """Time by type so far, mean time per earlier session of the type, and mean and deviation of the total."""
    plurals = {p: k for p, k in _kinds(log).items() if p != "clips"}
    spent = {p: F.when(_ended() & (F.col(log.kind) == k), F.col("session_time")) for p, k in plurals.items()}
    start = {f"time_spent_on_{p}": total(c, not include_current) for p, c in spent.items()}
    start |= {f"average_time_spent_on_{p}": mean(c, before=True) for p, c in spent.items()}
    whole = F.when(_ended_assessment(log), F.col("total_time_spent"))
    return Block(
        ["total_time_spent", *start, "avg_total_time_spent", "std_total_time_spent"],
        start,
        derive={"total_time_spent": row_sum(*[F.col(f"time_spent_on_{p}") for p in plurals])},
        follow={"avg_total_time_spent": mean(whole), "std_total_time_spent": deviation(whole)},
        finish={n: _zero(n) for n in [*start, "std_total_time_spent"]},
    )


def time_per_world(log: EventLog = DEFAULT_LOG, include_current: bool = True) -> Block:
    names = {f"time_spent_in_{slug(w)}": w for w in log.worlds}
    return Block(
        list(names),
        start={
            n: total(F.when(_ended() & (F.col(log.world) == w), F.col("session_time")), not include_current)
            for n, w in names.items()
        },
        finish={n: _zero(n) for n in names},
    )


def level_reached(log: EventLog = DEFAULT_LOG, include_current: bool = True) -> Block:
    names = {f"level_reached_in_{slug(w)}": w for w in log.worlds}
    level = level_of(F.col(log.title), log.level_word)
    return Block(
        [*names, "total_level"],
        start={
            n: highest(F.when(_ended() & (F.col(log.world) == w), level), not include_current)
            for n, w in names.items()
        },
        finish={n: _zero(n) for n in names} | {"total_level": row_sum(*[F.col(n) for n in names])},
    )


def title_history(titles: list[str], log: EventLog = DEFAULT_LOG, include_current: bool = True) -> Block:
    """Per title of the vocabulary: visits so far, time and events of earlier sessions, and the entity's past
    attempts and successes written under the session's own title. Needs ``running_attempts`` in the scan."""
    start, finish, outputs = {}, {}, []
    at = {t: _ended() & (F.col(log.title) == t) for t in titles}
    for title, here in at.items():
        name = slug(title)
        start[f"visits_{name}"] = total(F.when(here, F.lit(1).cast("bigint")), not include_current)
        start[f"cumulative_timespent_{name}"] = total(F.when(here, F.col("session_time")), before=True)
        start[f"cumulative_events_{name}"] = total(F.when(here, F.col("session_events")), before=True)
    outputs += list(start)
    finish |= {n: _zero(n) for n in start}
    follow = {
        "session_past_attempts": latest(F.when(_ended(), F.col("cumulative_attempts")), before=True),
        "session_past_successes": latest(F.when(_ended(), F.col("cumulative_successes")), before=True),
    }
    for title, here in at.items():
        for what in ("attempts", "successes"):
            name = f"cumulative_{what}_{slug(title)}"
            finish[name] = F.when(here, _zero(f"session_past_{what}")).otherwise(F.lit(0).cast("bigint"))
            outputs.append(name)
    return Block(outputs, start, {}, follow, finish)


# --- blocks without a running order ---


def calendar_columns(log: EventLog = DEFAULT_LOG) -> dict[str, Column]:
    """Calendar parts of the earliest event within the session's smallest hour of day."""
    at = F.col("calendar_ts")
    return {"month": F.month(at), "hour": F.hour(at), "year": F.year(at), "dayofweek": F.weekday(at)}


def one_hot(column: Column, values: list, prefix: str) -> dict[str, Column]:
    """0/1 column per vocabulary value; an unseen or null value gives all zeros."""
    return {f"{prefix}{slug(v)}": F.coalesce((column == F.lit(v)).cast("int"), F.lit(0)) for v in values}


def event_code_history(events: DataFrame, codes: list[int], log: EventLog = DEFAULT_LOG) -> DataFrame:
    """Per assessment and event code: in how many sessions so far (this one included) the code has occurred."""
    seen = {f"code_{c}": F.max((F.col(log.code) == c).cast("bigint")) for c in codes}
    sessions = events.groupBy(*log.keys, log.kind).agg(
        F.min(log.ts).alias("first_ts"), *[_zero(c).alias(n) for n, c in seen.items()])
    scan = OrderedScan(materialize(sessions, "codes"), [log.entity], first_order(log))
    scan.with_running(**{n: total(F.col(n)) for n in seen})
    return scan.result().filter(is_assessment(log)).select(*log.keys, *seen)


def session_accuracy_group(events: DataFrame, log: EventLog = DEFAULT_LOG) -> DataFrame:
    """Self-computed label of every session; sessions without attempts (all non-assessments) get 0."""
    sums = events.groupBy(*log.keys).agg(
        F.sum(attempt_flag(log)).alias("attempts"), F.sum(success_flag(log)).alias("successes"))
    return sums.select(*log.keys, accuracy_group(F.col("successes"), F.col("attempts")).alias("accuracy_group"))


def first_event_block(steps: SessionSteps, *blocks: Block) -> DataFrame:
    """Keys and outputs of blocks over assessments in first-event order."""
    outputs = [c for b in blocks for c in b.outputs]
    return run_blocks(steps.by_first_event(), list(blocks)).result().select(*steps.log.keys, *outputs)


def terminal_event_block(steps: SessionSteps, *blocks: Block, only_assessments: bool = True) -> DataFrame:
    """Keys and outputs of blocks over all sessions in terminal-event order."""
    outputs = [c for b in blocks for c in b.outputs]
    rows = run_blocks(steps.by_terminal_event(), list(blocks)).result()
    keep = _ended_assessment(steps.log) if only_assessments else _ended()
    return rows.filter(keep).select(*steps.log.keys, *outputs)


def past_attempts_block(steps: SessionSteps) -> DataFrame:
    """``past_attempts_and_successes`` with its prerequisites."""
    log = steps.log
    scan = steps.both_orders(lambda s: run_blocks(s, [assessment_counter()]))
    needed = [running_attempts(log), session_order(log), past_attempts_and_successes(log)]
    rows = run_blocks(scan, needed).result().filter(_ended_assessment(log))
    return rows.select(*log.keys, "game_session_order", *needed[2].outputs)
