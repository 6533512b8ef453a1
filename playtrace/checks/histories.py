"""Queries over ordered histories and pivots: W, P and B rows of the inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from playtrace.checks.registry import query
from playtrace.checks.sql_views import (
    KEYS, W_FIRST, W_TERM, group_case, on_all, on_assessments, on_flags, on_frame, on_log, on_terminal, r3, r6,
)
from playtrace.config import DEFAULT_LOG as LOG
from playtrace.functions.scalars import strip_suffix_chars
from playtrace.operators.scan import OrderedScan, latest
from playtrace.operators.sessions import (
    SessionSteps, prepare_events, session_frame, title_measures, with_running_attempts, with_session_measures,
)
from playtrace.plans import blocks as B
from playtrace.plans import datasets as D
from playtrace.plans.calendar import calendar_rows
from playtrace.plans.features import TITLE_STATISTICS, build_features, distinct_values, fit_vocabulary
from playtrace.sources.activity import game_events, stored_game_events

PLACE = [*LOG.keys, "event_count"]

# Titles, codes and the like that the log view can hold.
TITLES = {
    "Bird Measurer (Assessment)": "bird_measurer_assessment", "Block Stacker (Assessment)": "block_stacker_assessment",
    "Pan Balancer (Assessment)": "pan_balancer_assessment", "Shell Sorter (Assessment)": "shell_sorter_assessment",
    "Big Tent (Assessment)": "big_tent_assessment", "Trail - Level 1": "trail_level_1",
    "Trail - Level 2": "trail_level_2", "Trail - Level 3": "trail_level_3", "Hoop Roll": "hoop_roll",
    "Jar Fill": "jar_fill", "Rope Swing": "rope_swing", "Sand Play": "sand_play", "Egg Hunt": "egg_hunt",
}
STRIPPED = {"Bird Measurer": "bird_measurer", "Block Stacker": "block_stacker", "Pan Balancer": "pan_balancer",
            "Shell Sorter": "shell_sorter", "Big T": "big_t"}
WORLDS = {"CRYSTALCAVES": "crystalcaves", "MAGMAPEAK": "magmapeak", "NONE": "none", "TREETOPCITY": "treetopcity"}
PLAYED_WORLDS = {w: s for w, s in WORLDS.items() if w != "NONE"}
CODES = [2000, 2010, 2020, 2030, 4100, 4110]
TYPES = {"activities": "Activity", "games": "Game", "assessments": "Assessment"}


def steps_of(spark, folder) -> SessionSteps:
    return SessionSteps(stored_game_events(spark, folder))


def pick(df, *columns):
    return df.select(*LOG.keys, *columns)


# --- event frame ---


@query("w1_running_attempts", on_frame(
    f"SELECT {KEYS}, event_count, cumulative_attempts, cumulative_successes, "
    "cumulative_attempts - cumulative_successes AS cumulative_fails FROM fr"))
def _(spark, folder):
    cumulative = ["cumulative_attempts", "cumulative_successes", "cumulative_fails"]
    return with_running_attempts(game_events(spark, folder)).select(*PLACE, *cumulative)


MEASURES = """
SELECT f.installation_id, f.game_session, f.event_count, f.session_time AS total_game_session_time,
  f.session_events AS total_game_session_events,
  CASE WHEN f.type = 'Assessment' THEN f.session_time END AS assessment_session_time,
  CASE WHEN f.type = 'Assessment' THEN f.session_events END AS assessment_number_of_events,
  a.counter AS assessments_played_counter{more}
FROM fr f LEFT JOIN a USING (installation_id, game_session)"""


@query("b0_prepare_events", on_all(MEASURES.format(
    more=", f.attempt, f.is_attempt_successful, f.cumulative_attempts, f.cumulative_successes, "
         "f.cumulative_attempts - f.cumulative_successes AS cumulative_fails")))
def _(spark, folder):
    return prepare_events(stored_game_events(spark, folder)).drop(
        "event_id", "timestamp", "event_code", "game_time", "title", "type", "world")


@query("b0_session_frame", on_terminal(
    f"SELECT {KEYS}, type, title, world, session_time, session_events, ord AS game_session_order, "
    f"CAST(sum(session_time) OVER w AS BIGINT) AS cumulative_time_spent FROM term {W_TERM}"))
def _(spark, folder):
    steps = steps_of(spark, folder)
    order = B.terminal_event_block(steps, B.session_order(), only_assessments=False)
    described = pick(steps.sessions, "type", "title", "world", "session_time", "session_events")
    return described.join(order, LOG.keys, "inner")


@query("w2_assessment_counter", on_all(
    "SELECT f.installation_id, f.game_session, f.event_count, a.counter AS assessments_played_counter "
    "FROM fr f LEFT JOIN a USING (installation_id, game_session)"))
def _(spark, folder):
    return with_session_measures(game_events(spark, folder)).select(*PLACE, "assessments_played_counter")


# --- running measures, one window idea each ---


@query("w3_session_order", on_terminal(f"SELECT {KEYS}, ord AS game_session_order FROM term"))
def _(spark, folder):
    return pick(B.terminal_event_block(steps_of(spark, folder), B.session_order(), only_assessments=False),
                "game_session_order")


@query("w4_cumulative_session_time", on_terminal(
    f"SELECT {KEYS}, CAST(sum(session_time) OVER w AS BIGINT) AS cumulative_time_spent FROM term {W_TERM}"))
def _(spark, folder):
    return pick(B.terminal_event_block(steps_of(spark, folder), B.session_order(), only_assessments=False),
                "cumulative_time_spent")


PAST = {"ag": "accuracy_group", "att": "attempts", "succ": "successes", "fails": "fails"}
LAGGED = f"""
p AS (
  SELECT *, {", ".join(f"lag({c}, 1, 0) OVER w AS past_assessment_{n}" for n, c in PAST.items())},
    lag(session_time, 1, 0) OVER w AS past_assessment_session_time,
    lag(session_events, 1, 0) OVER w AS past_assessment_number_of_events,
    lag(try_time, 1, 0) OVER w AS prev_assessment_time_past_till_attempt,
    lag(try_events, 1, 0) OVER w AS prev_assessment_num_of_events_till_attempt,
    coalesce(lag(mean_duration) OVER w, 0) AS past_mean_duration
  FROM a WINDOW w AS (PARTITION BY installation_id ORDER BY first_ts, game_session)
),
q AS (
  SELECT *, CASE WHEN past_assessment_att = 0 THEN 0.0
                 ELSE past_assessment_succ / CAST(past_assessment_att AS DOUBLE) END AS past_assessment_accuracy
  FROM p
)"""
NAMES5 = [*PAST, "accuracy"]
LAG_SQL = ", ".join(f"past_assessment_{n}" for n in PAST)
MEAN_SQL = ", ".join(r6(f"avg(past_assessment_{n}) OVER w", f"cummean_{n}") for n in NAMES5)
STD_SQL = ", ".join(r6(f"coalesce(stddev_samp(past_assessment_{n}) OVER w, 0)", f"cumstd_{n}") for n in NAMES5)
COUNT_SQL = ", ".join(
    f"CAST(sum(CASE WHEN past_assessment_ag = {i} THEN 1 ELSE 0 END) OVER w AS BIGINT) AS {n}"
    for i, n in enumerate(B.GROUP_COUNTS))
RATIO_SQL = r6("past_assessment_accuracy", "past_assessment_accuracy")


def first_sql(columns: str) -> str:
    return on_assessments(f"SELECT {KEYS}, {columns} FROM q {W_FIRST}", LAGGED)


@query("w5_lag_fill_zero", first_sql(LAG_SQL))
def _(spark, folder):
    return pick(B.first_event_block(steps_of(spark, folder), B.previous_accuracy()),
                *[f"past_assessment_{n}" for n in PAST])


@query("w6_expanding_mean", first_sql(MEAN_SQL))
def _(spark, folder):
    return pick(B.first_event_block(steps_of(spark, folder), B.previous_accuracy()),
                *[f"cummean_{n}" for n in NAMES5])


@query("w7_expanding_deviation", first_sql(STD_SQL))
def _(spark, folder):
    return pick(B.first_event_block(steps_of(spark, folder), B.previous_accuracy()),
                *[f"cumstd_{n}" for n in NAMES5])


LEVEL = ("coalesce(max(CASE WHEN world = '{w}' THEN CASE WHEN title LIKE '%Level%' "
         "THEN TRY_CAST(right(trim(title), 1) AS BIGINT) ELSE 0 END END) OVER w, 0)")
LEVEL_SQL = ", ".join(f"{LEVEL.format(w=w)} AS level_reached_in_{s}" for w, s in PLAYED_WORLDS.items())


@query("w8_running_max", on_terminal(f"SELECT {KEYS}, {LEVEL_SQL} FROM term {W_TERM}"))
def _(spark, folder):
    block = B.level_reached()
    rows = B.terminal_event_block(steps_of(spark, folder), block, only_assessments=False)
    return rows.drop("total_level")


PRIOR_SQL = ", ".join(
    r6(f"coalesce(avg(CASE WHEN type = '{k}' THEN session_time END) OVER b, 0)", f"average_time_spent_on_{p}")
    for p, k in TYPES.items())


@query("w9_prior_type_average", on_terminal(f"SELECT {KEYS}, {PRIOR_SQL} FROM term {W_TERM}"))
def _(spark, folder):
    rows = B.terminal_event_block(steps_of(spark, folder), B.time_per_type(), only_assessments=False)
    return pick(rows, *[f"average_time_spent_on_{p}" for p in TYPES])


@query("w10_forward_fill", on_terminal(
    f"SELECT {KEYS}, last_value(CASE WHEN type = 'Game' THEN session_time END IGNORE NULLS) OVER w AS last_game_time "
    f"FROM term {W_TERM}"))
def _(spark, folder):
    ended = steps_of(spark, folder).sessions.filter("terminal")
    scan = OrderedScan(ended, [LOG.entity], ["last_ts", LOG.session])
    scan.with_running(last_game_time=latest(F.when(F.col("type") == LOG.game, F.col("session_time"))))
    return pick(scan.result(), "last_game_time")


RANKED = """
ranked AS (SELECT *, row_number() OVER (PARTITION BY installation_id ORDER BY first_ts DESC, game_session DESC) AS from_last FROM a)"""


@query("w11_last_assessment", on_assessments(f"SELECT {KEYS} FROM ranked WHERE from_last = 1", RANKED))
def _(spark, folder):
    return D.last_assessment(steps_of(spark, folder).assessments)


@query("w12_second_last_assessment", on_assessments(
    f"SELECT {KEYS}, accuracy_group FROM ranked WHERE from_last = 2", RANKED))
def _(spark, folder):
    return D.second_last_assessment(steps_of(spark, folder).assessments)


@query("w13_all_but_second_last_assessment", on_assessments(
    f"SELECT {KEYS}, accuracy_group FROM ranked WHERE from_last <> 2", RANKED))
def _(spark, folder):
    return D.all_but_second_last_assessment(steps_of(spark, folder).assessments)


CALENDAR = """
cal AS (
  SELECT DISTINCT installation_id, game_session, rtrim(title, ' (Assessment)') AS title, world,
    month(timestamp) AS month, hour(timestamp) AS hour, year(timestamp) AS year,
    CAST(isodow(timestamp) - 1 AS BIGINT) AS dayofweek
  FROM ge WHERE type = 'Assessment'
)"""


@query("w14_rows_at_group_extreme", on_log(
    "SELECT * FROM cal c WHERE hour = (SELECT min(hour) FROM cal d WHERE d.installation_id = c.installation_id "
    "AND d.game_session = c.game_session)", CALENDAR))
def _(spark, folder):
    return calendar_rows(game_events(spark, folder))


@query("w14_rows_at_group_max", on_terminal(
    f"SELECT {KEYS}, ord AS game_session_order FROM term QUALIFY ord = max(ord) OVER (PARTITION BY installation_id)"))
def _(spark, folder):
    order = B.terminal_event_block(steps_of(spark, folder), B.session_order(), only_assessments=False)
    return pick(D.at_group_extreme(order, [LOG.entity], "game_session_order"), "game_session_order")


@query("w15_running_group_counts", first_sql(COUNT_SQL))
def _(spark, folder):
    return pick(B.first_event_block(steps_of(spark, folder), B.previous_accuracy()), *B.GROUP_COUNTS)


# --- pivots ---


def count_so_far(condition: str) -> str:
    return f"CAST(coalesce(sum(CASE WHEN {condition} THEN 1 ELSE 0 END) OVER w, 0) AS BIGINT)"


def time_so_far(condition: str) -> str:
    return f"CAST(coalesce(sum(CASE WHEN {condition} THEN session_time ELSE 0 END) OVER w, 0) AS BIGINT)"


def on_ended_assessments(inner: str, outer: str = "*") -> str:
    return on_terminal(f"SELECT {outer} EXCLUDE (type) FROM (SELECT {KEYS}, type, {inner} FROM term {W_TERM}) z "
                       "WHERE type = 'Assessment'")


PLAYED_SQL = ", ".join(f"{count_so_far(f'type = {chr(39)}{k}{chr(39)}')} AS {p}_played"
                       for p, k in {**TYPES, "clips": "Clip"}.items())
TYPE_TIME_SQL = ", ".join(f"{time_so_far(f'type = {chr(39)}{k}{chr(39)}')} AS time_spent_on_{p}" for p, k in TYPES.items())
WORLD_TIME_SQL = ", ".join(f"{time_so_far(f'world = {chr(39)}{w}{chr(39)}')} AS time_spent_in_{s}"
                           for w, s in PLAYED_WORLDS.items())


@query("p1_sessions_per_type", on_terminal(f"SELECT {KEYS}, {PLAYED_SQL} FROM term {W_TERM}"))
def _(spark, folder):
    rows = B.terminal_event_block(steps_of(spark, folder), B.frequency_per_type(), only_assessments=False)
    return rows.drop("total_games_played")


@query("p2_time_per_type", on_terminal(f"SELECT {KEYS}, {TYPE_TIME_SQL} FROM term {W_TERM}"))
def _(spark, folder):
    rows = B.terminal_event_block(steps_of(spark, folder), B.time_per_type(), only_assessments=False)
    return pick(rows, *[f"time_spent_on_{p}" for p in TYPES])


@query("p3_time_per_world", on_terminal(f"SELECT {KEYS}, {WORLD_TIME_SQL} FROM term {W_TERM}"))
def _(spark, folder):
    return B.terminal_event_block(steps_of(spark, folder), B.time_per_world(), only_assessments=False)


@query("p4_level_per_world", on_ended_assessments(LEVEL_SQL))
def _(spark, folder):
    return B.terminal_event_block(steps_of(spark, folder), B.level_reached()).drop("total_level")


def title_block(spark, folder, prefix: str):
    steps = steps_of(spark, folder)
    block = B.title_history(distinct_values(steps.sessions, LOG.title))
    rows = B.terminal_event_block(steps, B.running_attempts(), block)
    return pick(rows, *[c for c in block.outputs if c.startswith(prefix)])


VISITS = ", ".join(f"{count_so_far(f'title = {chr(39)}{t}{chr(39)}')} AS visits_{s}" for t, s in TITLES.items())


def before_sql(column: str, prefix: str) -> str:
    return ", ".join(
        f"CAST(coalesce(sum(CASE WHEN title = '{t}' THEN {column} ELSE 0 END) OVER b, 0) AS BIGINT) AS {prefix}{s}"
        for t, s in TITLES.items())


def past_sql(column: str, prefix: str) -> str:
    return ", ".join(
        f"CASE WHEN title = '{t}' THEN coalesce(lag({column}) OVER l, 0) ELSE 0 END AS {prefix}{s}"
        for t, s in TITLES.items())


P6 = before_sql("session_time", "cumulative_timespent_")
P7 = before_sql("session_events", "cumulative_events_")
P8 = past_sql("cumulative_attempts", "cumulative_attempts_")
P9 = past_sql("cumulative_successes", "cumulative_successes_")


@query("p5_visits_per_title", on_ended_assessments(VISITS))
def _(spark, folder):
    return title_block(spark, folder, "visits_")


@query("p6_time_per_title", on_ended_assessments(P6))
def _(spark, folder):
    return title_block(spark, folder, "cumulative_timespent_")


@query("p7_events_per_title", on_ended_assessments(P7))
def _(spark, folder):
    return title_block(spark, folder, "cumulative_events_")


@query("p8_past_attempts_per_title", on_ended_assessments(P8))
def _(spark, folder):
    return title_block(spark, folder, "cumulative_attempts_")


@query("p9_past_successes_per_title", on_ended_assessments(P9))
def _(spark, folder):
    return title_block(spark, folder, "cumulative_successes_")


CODE_HISTORY = on_log(
    f"SELECT {KEYS}, " + ", ".join(f"code_{c}" for c in CODES) + " FROM hist WHERE type = 'Assessment'",
    "\nper AS (SELECT installation_id, game_session, type, min(timestamp) AS first_ts, "
    + ", ".join(f"max(CASE WHEN event_code = {c} THEN 1 ELSE 0 END) AS c{c}" for c in CODES)
    + " FROM ge GROUP BY installation_id, game_session, type)",
    "\nhist AS (SELECT *, " + ", ".join(f"CAST(sum(c{c}) OVER w AS BIGINT) AS code_{c}" for c in CODES)
    + " FROM per WINDOW w AS (PARTITION BY installation_id ORDER BY first_ts, game_session ROWS UNBOUNDED PRECEDING))",
)


@query("p10_event_code_counts", CODE_HISTORY)
def _(spark, folder):
    events = game_events(spark, folder)
    return B.event_code_history(events, distinct_values(events, LOG.code))


@query("b13_event_code_history", CODE_HISTORY)
def _(spark, folder):
    return B.event_code_history(game_events(spark, folder), CODES)


WORLD_HOT = ", ".join(f"CAST(world = '{w}' AS BIGINT) AS world_{s}" for w, s in WORLDS.items())
TITLE_HOT = ", ".join(f"CAST(rtrim(title, ' (Assessment)') = '{t}' AS BIGINT) AS title_{s}" for t, s in STRIPPED.items())


@query("p11_one_hot", on_assessments(f"SELECT {KEYS}, {WORLD_HOT}, {TITLE_HOT} FROM a"))
def _(spark, folder):
    events = stored_game_events(spark, folder)
    known = fit_vocabulary(events)
    title = strip_suffix_chars(F.col(LOG.title))
    hot = B.one_hot(F.col(LOG.world), known.worlds, "world_") | B.one_hot(title, known.titles, "title_")
    return pick(session_frame(events).filter("type = 'Assessment'").withColumns(hot), *hot)


EARLIEST = """
early AS (
  SELECT installation_id, game_session, arg_min(timestamp, (hour(timestamp), timestamp)) AS moment
  FROM ge WHERE type = 'Assessment' GROUP BY installation_id, game_session
)"""
HOUR_HOT = ", ".join(f"CAST(hour(moment) = {h} AS BIGINT) AS hour_{h}" for h in range(24))
DAY_HOT = ", ".join(f"CAST(isodow(moment) - 1 = {d} AS BIGINT) AS weekday_{d}" for d in range(7))


@query("p12_one_hot_calendar", on_log(f"SELECT {KEYS}, {HOUR_HOT}, {DAY_HOT} FROM early", EARLIEST))
def _(spark, folder):
    sessions = session_frame(game_events(spark, folder)).filter("type = 'Assessment'")
    calendar = B.calendar_columns()
    hot = B.one_hot(calendar["hour"], list(range(24)), "hour_")
    hot |= B.one_hot(calendar["dayofweek"], list(range(7)), "weekday_")
    return pick(sessions.withColumns(hot), *hot)


# --- blocks ---


@query("b1_previous_accuracy", first_sql(", ".join([LAG_SQL, RATIO_SQL, MEAN_SQL, STD_SQL, COUNT_SQL])))
def _(spark, folder):
    return B.first_event_block(steps_of(spark, folder), B.previous_accuracy())


PAST_TOTALS = """
pt AS (
  SELECT t.installation_id, t.game_session, t.ord AS game_session_order,
    lag(t.cumulative_attempts, 1, 0) OVER w AS past_total_attempts,
    lag(t.cumulative_successes, 1, 0) OVER w AS past_total_successes,
    lag(t.cumulative_fails, 1, 0) OVER w AS past_total_fails,
    lag(a.counter, 1, 0) OVER w AS past_assessments_played
  FROM term t JOIN a USING (installation_id, game_session) WHERE t.type = 'Assessment'
  WINDOW w AS (PARTITION BY t.installation_id ORDER BY t.ord)
),
pta AS (
  SELECT *, CASE WHEN past_total_attempts = 0 THEN 0.0
                 ELSE past_total_successes / CAST(past_total_attempts AS DOUBLE) END AS past_total_accuracy
  FROM pt
)"""


@query("b2_past_attempts_and_successes", on_all(
    f"SELECT {KEYS}, game_session_order, past_total_attempts, past_total_successes, past_total_fails, "
    f"past_assessments_played, {r6('past_total_accuracy', 'past_total_accuracy')} FROM pta", PAST_TOTALS))
def _(spark, folder):
    return B.past_attempts_block(steps_of(spark, folder))


B3_MEAN = ", ".join([
    r6("avg(past_assessment_session_time) OVER w", "cum_average_time"),
    r6("avg(past_assessment_number_of_events) OVER w", "cum_average_events")])
B3_SQL = ", ".join([
    "past_assessment_session_time", "past_assessment_number_of_events", B3_MEAN,
    r3("coalesce(stddev_samp(past_assessment_session_time) OVER w, 0)", "cumsd_time"),
    r3("coalesce(stddev_samp(past_assessment_number_of_events) OVER w, 0)", "cumsd_events")])


@query("b3_past_assessment_time_events", first_sql(B3_SQL))
def _(spark, folder):
    return B.first_event_block(steps_of(spark, folder), B.past_assessment_time_events())


TILL = ["time_past_till_attempt", "num_of_events_till_attempt"]
B4_SQL = ", ".join(
    [f"prev_assessment_{n}" for n in TILL]
    + [r6(f"avg(prev_assessment_{n}) OVER w", f"cummean_assessment_{n}") for n in TILL]
    + [r3(f"coalesce(stddev_samp(prev_assessment_{n}) OVER w, 0)", f"cumsd_assessment_{n}") for n in TILL])


@query("b4_time_and_events_till_attempt", first_sql(B4_SQL))
def _(spark, folder):
    return B.first_event_block(steps_of(spark, folder), B.time_and_events_till_attempt())


@query("b5_frequency_per_type", on_ended_assessments(f"ord AS total_games_played, {PLAYED_SQL}"))
def _(spark, folder):
    return B.terminal_event_block(steps_of(spark, folder), B.frequency_per_type())


TIME_BLOCK = f"""
tt AS (SELECT {KEYS}, type, ord, {TYPE_TIME_SQL}, {PRIOR_SQL} FROM term {W_TERM}),
ta AS (
  SELECT *, time_spent_on_activities + time_spent_on_games + time_spent_on_assessments AS total_time_spent
  FROM tt WHERE type = 'Assessment'
),
tb AS (
  SELECT * EXCLUDE (type, ord), {r6("avg(total_time_spent) OVER w", "avg_total_time_spent")},
    {r3("coalesce(stddev_samp(total_time_spent) OVER w, 0)", "std_total_time_spent")}
  FROM ta WINDOW w AS (PARTITION BY installation_id ORDER BY ord ROWS UNBOUNDED PRECEDING)
)"""


@query("b6_time_per_type", on_terminal("SELECT * FROM tb", TIME_BLOCK))
def _(spark, folder):
    return B.terminal_event_block(steps_of(spark, folder), B.time_per_type())


@query("b7_time_per_world", on_ended_assessments(WORLD_TIME_SQL))
def _(spark, folder):
    return B.terminal_event_block(steps_of(spark, folder), B.time_per_world())


LEVEL_TOTAL = " + ".join(f"level_reached_in_{s}" for s in PLAYED_WORLDS.values())


@query("b8_level_reached", on_ended_assessments(LEVEL_SQL, f"{LEVEL_TOTAL} AS total_level, *"))
def _(spark, folder):
    return B.terminal_event_block(steps_of(spark, folder), B.level_reached())


CAL_SQL = "month(moment) AS month, hour(moment) AS hour, year(moment) AS year, CAST(isodow(moment) - 1 AS BIGINT) AS dayofweek"


@query("b9_calendar_and_dummies", on_assessments(
    f"SELECT {KEYS}, {CAL_SQL}, {WORLD_HOT}, {TITLE_HOT} FROM a JOIN early USING ({KEYS})", EARLIEST))
def _(spark, folder):
    events = stored_game_events(spark, folder)
    known = fit_vocabulary(events)
    title = strip_suffix_chars(F.col(LOG.title))
    columns = B.calendar_columns() | B.one_hot(F.col(LOG.world), known.worlds, "world_")
    columns |= B.one_hot(title, known.titles, "title_")
    return pick(session_frame(events).filter("type = 'Assessment'").withColumns(columns), *columns)


TITLE_MEANS = """
tuples AS (SELECT DISTINCT title, session_time, attempt, is_attempt_successful FROM fr WHERE type = 'Assessment'),
tm AS (
  SELECT title, avg(session_time) AS overall_mean_game_session_time, avg(attempt) AS overall_mean_attempt,
    avg(is_attempt_successful) AS overall_mean_is_attempt_successful,
    avg(is_attempt_successful) / nullif(avg(attempt), 0) AS overall_mean_accuracy
  FROM tuples GROUP BY title
)"""
TITLE_MEANS_SQL = ", ".join(r6(c, c) for c in TITLE_STATISTICS)


@query("b10_overall_title_measures", on_all(
    f"SELECT {KEYS}, {TITLE_MEANS_SQL} FROM a JOIN tm USING (title)", TITLE_MEANS))
def _(spark, folder):
    steps = steps_of(spark, folder)
    return pick(steps.assessments.join(title_measures(steps.sessions), LOG.title), *TITLE_STATISTICS)


@query("b11_mean_duration", first_sql(r6("past_mean_duration", "mean_duration")))
def _(spark, folder):
    rows = B.first_event_block(steps_of(spark, folder), B.previous_mean_duration())
    return rows.withColumnRenamed("past_mean_duration", "mean_duration")


@query("b12_title_history", on_ended_assessments(", ".join([VISITS, P6, P7, P8, P9])))
def _(spark, folder):
    return title_block(spark, folder, "")


GROUPS = f"SELECT {KEYS}, {group_case('sum(is_attempt_successful)', 'sum(attempt)')} AS accuracy_group FROM fl GROUP BY {KEYS}"


@query("b14_session_accuracy_group", on_flags(GROUPS))
def _(spark, folder):
    return B.session_accuracy_group(game_events(spark, folder))


# --- feature table ---

FEATURE_VIEWS = [
    LAGGED,
    f"\nfirsts AS (SELECT {KEYS}, counter AS assessments_played_counter, {LAG_SQL}, {RATIO_SQL}, {MEAN_SQL}, {STD_SQL}, "
    f"{COUNT_SQL}, {B3_SQL}, {B4_SQL}, {r6('past_mean_duration', 'mean_duration')} FROM q {W_FIRST})",
    PAST_TOTALS,
    TIME_BLOCK,
    f"\nterms AS (SELECT {KEYS}, title, world, type, ord AS total_games_played, {PLAYED_SQL}, {WORLD_TIME_SQL}, {LEVEL_SQL} "
    f"FROM term {W_TERM})",
    EARLIEST,
    TITLE_MEANS,
    f"\ndum AS (SELECT {KEYS}, {CAL_SQL}, {WORLD_HOT}, {TITLE_HOT}, {HOUR_HOT}, {DAY_HOT} "
    f"FROM term JOIN early USING ({KEYS}) WHERE type = 'Assessment')",
    f"\nlab AS ({GROUPS})",
    f"""
feat AS (
  SELECT *, {LEVEL_TOTAL} AS total_level,
    {r6('past_total_accuracy', 'past_total_accuracy_')}, {TITLE_MEANS_SQL.replace(' AS overall', ' AS r_overall')}
  FROM terms JOIN firsts USING ({KEYS}) JOIN pta USING ({KEYS}) JOIN tb USING ({KEYS}) JOIN dum USING ({KEYS})
    JOIN lab USING ({KEYS}) JOIN tm USING (title)
  WHERE type = 'Assessment'
)""",
]


def feature_sql(variant: str, source: str = "feat", extra: str = "", where: str = "") -> str:
    return on_all(f"SELECT {KEYS}, {feature_columns_sql(variant)}{extra} FROM {source}{where}", *FEATURE_VIEWS)


def feature_columns_sql(variant: str) -> str:
    """Column list of the variant, spelled out from the blocks above."""
    past = ["ag", "att", "succ"] + (["fails", "accuracy"] if variant == "main" else [])
    columns = ["total_games_played", "activities_played", "games_played"]
    columns += [] if variant == "main" else ["assessments_played"]
    columns += ["clips_played", "total_time_spent", *[f"time_spent_on_{p}" for p in TYPES],
                *[f"average_time_spent_on_{p}" for p in TYPES], "avg_total_time_spent"]
    columns += [] if variant == "self_label" else ["std_total_time_spent", "month", "hour", "dayofweek"]
    columns += ["year"] if variant in ("boosted", "stacked") else []
    columns += [f"world_{s}" for s in WORLDS.values()] + [f"title_{s}" for s in STRIPPED.values()]
    if variant == "self_label":
        columns += [f"hour_{h}" for h in range(24)] + [f"weekday_{d}" for d in range(7)] + ["accuracy_group"]
    columns += ["past_total_attempts", "past_total_successes", "past_assessments_played"]
    columns += ["past_total_accuracy_ AS past_total_accuracy"] if variant == "main" else []
    columns += [] if variant == "boosted" else ["past_total_fails"]
    columns += ["game_session_order"] if variant in ("boosted", "stacked") else []
    columns += ["past_assessment_session_time", "past_assessment_number_of_events"]
    columns += [] if variant == "self_label" else ["cum_average_time", "cum_average_events", "cumsd_time", "cumsd_events"]
    columns += [f"prev_assessment_{n}" for n in TILL] + [f"cummean_assessment_{n}" for n in TILL]
    columns += [f"cumsd_assessment_{n}" for n in TILL]
    columns += [f"time_spent_in_{s}" for s in PLAYED_WORLDS.values()]
    columns += [f"level_reached_in_{s}" for s in PLAYED_WORLDS.values()] + ["total_level"]
    columns += [f"past_assessment_{n}" for n in past] + [f"cummean_{n}" for n in past] + [f"cumstd_{n}" for n in past]
    columns += [] if variant == "boosted" else list(B.GROUP_COUNTS)
    columns += ["assessments_played_counter"] if variant in ("stacked", "self_label") else []
    columns += [f"r_{c} AS {c}" for c in TITLE_STATISTICS] + ["mean_duration"] if variant == "main" else []
    return ", ".join(columns)


@query("b15_features_main", feature_sql("main"))
def _(spark, folder):
    return build_features(stored_game_events(spark, folder), "main")


@query("b15_features_boosted", feature_sql("boosted"))
def _(spark, folder):
    return build_features(stored_game_events(spark, folder), "boosted")


@query("b15_features_stacked", feature_sql("stacked"))
def _(spark, folder):
    return build_features(stored_game_events(spark, folder), "stacked")


@query("b15_features_self_label", feature_sql("self_label"))
def _(spark, folder):
    return build_features(stored_game_events(spark, folder), "self_label")


def fanout_sql(variant: str, parts: str, keep: str) -> str:
    """One representative moment per distinct calendar value instead of one per session."""
    several = f"""
early AS (
  SELECT {KEYS}, min(timestamp) AS moment FROM ge WHERE type = 'Assessment'
  GROUP BY {KEYS}, {parts}{keep}
)"""
    views = [several if v == EARLIEST else v for v in FEATURE_VIEWS]
    return on_all(f"SELECT {KEYS}, {feature_columns_sql(variant)} FROM feat", *views)


@query("b15_features_main_fanout", fanout_sql(
    "main", "month(timestamp), hour(timestamp), isodow(timestamp)",
    f" QUALIFY hour(moment) = min(hour(moment)) OVER (PARTITION BY {KEYS})"))
def _(spark, folder):
    return build_features(stored_game_events(spark, folder), "main", allow_fanout=True)


@query("b15_features_self_label_fanout", fanout_sql("self_label", "hour(timestamp), isodow(timestamp)", ""))
def _(spark, folder):
    return build_features(stored_game_events(spark, folder), "self_label", allow_fanout=True)
