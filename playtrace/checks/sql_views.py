"""SQL text shared by the oracles: the event log view and the frames built on it."""

from __future__ import annotations

EVENTS = """
raw_events AS (
  SELECT event_id, ts, user_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events
),
marked AS (
  SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 43200000000
                 THEN 1 ELSE 0 END AS fresh
  FROM raw_events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
),
numbered AS (
  SELECT *, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS seq
  FROM marked
),
headed AS (
  SELECT *, first_value(event_type) OVER s AS ft, first_value(k) OVER s AS fk, first_value(ts) OVER s AS t0,
         row_number() OVER s AS rn
  FROM numbered WINDOW s AS (PARTITION BY user_id, seq ORDER BY ts, event_id)
),
typed AS (
  SELECT *, 'i' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS installation_id,
    CASE WHEN ft IN ('purchase', 'error') THEN 'Assessment' WHEN ft = 'signup' THEN 'Game'
         WHEN ft = 'click' THEN 'Activity' ELSE 'Clip' END AS type,
    ['NONE', 'TREETOPCITY', 'MAGMAPEAK', 'CRYSTALCAVES'][fk % 4 + 1] AS world
  FROM headed
),
titled AS (
  SELECT *, CASE type
      WHEN 'Assessment' THEN ['Bird Measurer', 'Block Stacker', 'Pan Balancer', 'Shell Sorter', 'Big Tent'][fk % 5 + 1] || ' (Assessment)'
      WHEN 'Clip' THEN 'Trail - Level ' || CAST(1 + fk % 3 AS VARCHAR)
      WHEN 'Game' THEN ['Hoop Roll', 'Jar Fill', 'Rope Swing'][fk % 3 + 1]
      ELSE ['Sand Play', 'Egg Hunt'][fk % 2 + 1] END AS title
  FROM typed
),
coded AS (
  SELECT *, CASE WHEN type = 'Assessment' AND event_type IN ('purchase', 'click') THEN CASE WHEN title LIKE 'Bird%' THEN 4110 ELSE 4100 END
                 WHEN type = 'Assessment' AND event_type = 'view' THEN CASE WHEN title LIKE 'Bird%' THEN 4100 ELSE 4110 END
                 ELSE 2000 + 10 * (k % 4) END AS event_code
  FROM titled
),
ge AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, installation_id || '-' || lpad(CAST(seq AS VARCHAR), 4, '0') AS game_session,
    ts AS timestamp,
    '{"event_code":' || CAST(event_code AS VARCHAR) || ',"correct":' || CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END
      || CASE WHEN k % 5 = 0 THEN '' ELSE ',"duration":' || CAST(100 * k AS VARCHAR) END || '}' AS event_data,
    installation_id, CAST(rn AS BIGINT) AS event_count, CAST(event_code AS BIGINT) AS event_code,
    (epoch_us(ts) - epoch_us(t0)) // 1000 AS game_time, title, type, world
  FROM coded
)"""

FLAGS = """
tried AS (
  SELECT *, CAST(CASE WHEN type = 'Assessment' AND ((event_code = 4100 AND title <> 'Bird Measurer (Assessment)')
                   OR (event_code = 4110 AND title = 'Bird Measurer (Assessment)')) THEN 1 ELSE 0 END AS BIGINT) AS attempt
  FROM ge
),
fl AS (
  SELECT *, CAST(CASE WHEN attempt = 1 AND event_data LIKE '%true%' THEN 1 ELSE 0 END AS BIGINT) AS is_attempt_successful
  FROM tried
)"""

# Event frame: session totals, running attempts.
FRAME = """
fr AS (
  SELECT *, max(game_time) OVER s AS session_time, max(event_count) OVER s AS session_events,
    CAST(sum(attempt) OVER o AS BIGINT) AS cumulative_attempts,
    CAST(sum(is_attempt_successful) OVER o AS BIGINT) AS cumulative_successes
  FROM fl
  WINDOW s AS (PARTITION BY installation_id, game_session),
         o AS (PARTITION BY installation_id ORDER BY timestamp, game_session, event_count ROWS UNBOUNDED PRECEDING)
)"""


def group_case(s: str = "successes", a: str = "attempts") -> str:
    return (f"CAST(CASE WHEN {a} > 0 AND {s} = {a} THEN 3 WHEN {a} > 0 AND 2 * {s} = {a} THEN 2 "
            f"WHEN {s} > 0 AND 2 * {s} < {a} THEN 1 ELSE 0 END AS BIGINT)")


# Assessment sessions in order of first appearance.
ASSESSMENTS = f"""
asum AS (
  SELECT installation_id, game_session, any_value(title) AS title, any_value(world) AS world, min(timestamp) AS first_ts,
    CAST(sum(attempt) AS BIGINT) AS attempts, CAST(sum(is_attempt_successful) AS BIGINT) AS successes,
    max(game_time) AS session_time, max(event_count) AS session_events,
    coalesce(max(CASE WHEN attempt = 1 THEN event_count END), 0) AS try_events,
    coalesce(max(CASE WHEN attempt = 1 THEN game_time END), 0) AS try_time,
    avg(TRY_CAST(json_extract_string(event_data, '$.duration') AS DOUBLE)) AS mean_duration
  FROM fl WHERE type = 'Assessment' GROUP BY installation_id, game_session
),
a AS (
  SELECT *, attempts - successes AS fails, {group_case()} AS accuracy_group,
    row_number() OVER (PARTITION BY installation_id ORDER BY first_ts, game_session) AS counter
  FROM asum
)"""

# Ended sessions in order of their terminal event.
TERMINAL = """
term AS (
  SELECT installation_id, game_session, type, title, world, timestamp AS last_ts, session_time, session_events,
    cumulative_attempts, cumulative_successes, cumulative_attempts - cumulative_successes AS cumulative_fails,
    row_number() OVER (PARTITION BY installation_id ORDER BY timestamp, game_session) AS ord
  FROM fr WHERE game_time = session_time AND event_count = session_events
)"""

W_FIRST = "WINDOW w AS (PARTITION BY installation_id ORDER BY first_ts, game_session ROWS UNBOUNDED PRECEDING), l AS (PARTITION BY installation_id ORDER BY first_ts, game_session)"
W_TERM = ("WINDOW w AS (PARTITION BY installation_id ORDER BY ord ROWS UNBOUNDED PRECEDING), "
          "b AS (PARTITION BY installation_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), "
          "l AS (PARTITION BY installation_id ORDER BY ord)")

KEYS = "installation_id, game_session"


def with_views(*parts: str, select: str) -> str:
    """One statement from the shared views the select needs, ``ge`` first."""
    return "WITH " + ",".join([EVENTS, *parts]) + "\n" + select


def on_log(select: str, *extra: str) -> str:
    return with_views(*extra, select=select)


def on_flags(select: str, *extra: str) -> str:
    return with_views(FLAGS, *extra, select=select)


def on_frame(select: str, *extra: str) -> str:
    return with_views(FLAGS, FRAME, *extra, select=select)


def on_assessments(select: str, *extra: str) -> str:
    return with_views(FLAGS, ASSESSMENTS, *extra, select=select)


def on_terminal(select: str, *extra: str) -> str:
    return with_views(FLAGS, FRAME, TERMINAL, *extra, select=select)


def on_all(select: str, *extra: str) -> str:
    return with_views(FLAGS, FRAME, TERMINAL, ASSESSMENTS, *extra, select=select)


def r6(expression: str, name: str) -> str:
    return f"round({expression}, 6) AS {name}"


def r3(expression: str, name: str) -> str:
    return f"round({expression}, 3) AS {name}"
