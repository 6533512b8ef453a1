"""Queries over sources, row expressions, aggregates, joins and set operations: S, N, X, G, J and U rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from playtrace.checks.histories import CALENDAR, LAGGED, PLACE, TITLE_MEANS, feature_sql, pick, steps_of
from playtrace.checks.registry import query
from playtrace.checks.sql_views import KEYS, on_all, on_assessments, on_flags, on_frame, on_log, on_terminal, r6
from playtrace.config import DEFAULT_LOG as LOG
from playtrace.functions import json as J
from playtrace.functions import scalars as X
from playtrace.operators import aggregates as A
from playtrace.operators.sessions import session_frame, title_measures
from playtrace.plans import blocks as B
from playtrace.plans import datasets as D
from playtrace.plans.calendar import calendar_rows
from playtrace.plans.features import build_features, distinct_values, features_of
from playtrace.runtime import new_path
from playtrace.sources import tables as S
from playtrace.sources.activity import game_events, stored_game_events

LOG_COLUMNS = "event_id, game_session, event_data, installation_id, event_count, event_code, game_time, title, type, world"


# --- sources and sinks ---


@query("s1_read_event_log", on_log(
    f"SELECT {LOG_COLUMNS}, strftime(timestamp, '%Y-%m-%d %H:%M:%S.%f') AS at_text FROM ge"))
def _(spark, folder):
    """Write the log as CSV and read it back with the documented schema."""
    events = game_events(spark, folder)
    path = new_path(spark, "log-csv")
    S.write_csv(events.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS")), path)
    back = S.read_event_log(spark, path, kind="csv")
    text = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at_text")
    return back.select(*[c.strip() for c in LOG_COLUMNS.split(",")], text)


LABELS = f"SELECT {KEYS}, accuracy_group FROM a WHERE attempts > 0"


def labels_of(spark, folder):
    """Label table: accuracy group of the assessments with at least one attempt."""
    sessions = session_frame(game_events(spark, folder))
    return sessions.filter(X.is_assessment() & (F.col("attempts") > 0)).select(*LOG.keys, "accuracy_group")


@query("s2_read_labels", on_assessments(LABELS))
def _(spark, folder):
    path = new_path(spark, "labels-csv")
    S.write_csv(labels_of(spark, folder), path)
    return S.read_labels(spark, path, kind="csv")


@query("s3_read_feature_matrix", on_terminal(
    f"SELECT t.installation_id, t.game_session, t.ord AS game_session_order, CAST(l.accuracy_group AS BIGINT) AS accuracy_group FROM term t "
    f"JOIN (SELECT {KEYS}, CASE WHEN s = n THEN 3 WHEN 2 * s = n THEN 2 WHEN s > 0 AND 2 * s < n THEN 1 ELSE 0 END "
    f"AS accuracy_group FROM (SELECT {KEYS}, sum(attempt) AS n, sum(is_attempt_successful) AS s FROM fl GROUP BY {KEYS}) "
    f"WHERE n > 0) l USING ({KEYS})"))
def _(spark, folder):
    x, y = new_path(spark, "features"), new_path(spark, "labels")
    B.terminal_event_block(steps_of(spark, folder), B.session_order()).drop("cumulative_time_spent").write.parquet(x)
    labels_of(spark, folder).write.parquet(y)
    return S.read_feature_matrix(spark, x, y)


@query("s4_write_predictions", on_assessments("SELECT installation_id, accuracy_group FROM a"))
def _(spark, folder):
    path = new_path(spark, "predictions-csv")
    sessions = session_frame(game_events(spark, folder)).filter(X.is_assessment())
    S.write_predictions(sessions, path, prediction="accuracy_group")
    return spark.read.schema(S.PREDICTIONS_SCHEMA).csv(path, header=True)


@query("s5_distinct_session_ids", on_log(f"SELECT DISTINCT {KEYS} FROM ge"))
def _(spark, folder):
    return S.distinct_session_ids(game_events(spark, folder))


# --- JSON ---


@query("n1_json_expand", on_log(
    f"SELECT {KEYS}, event_count, event_data, " + ", ".join(
        f"json_extract_string(event_data, '$.{k}') AS field_{k}" for k in ("correct", "duration", "event_code")) + " FROM ge"))
def _(spark, folder):
    events = game_events(spark, folder).select(*PLACE, "event_data")
    return J.json_expand(events, "event_data", prefix="field_")


@query("n1_json_expand_typed", on_log(
    f"SELECT {KEYS}, event_count, CAST(json_extract_string(event_data, '$.correct') AS BOOLEAN) AS correct, "
    "CAST(json_extract_string(event_data, '$.duration') AS BIGINT) AS duration FROM ge"))
def _(spark, folder):
    schema = T.StructType([T.StructField("correct", T.BooleanType()), T.StructField("duration", T.LongType())])
    events = game_events(spark, folder).select(*PLACE, "event_data")
    return J.json_expand(events, "event_data", schema=schema).drop("event_data")


@query("n2_json_field", on_log(
    f"SELECT {KEYS}, event_count, TRY_CAST(json_extract_string(event_data, '$.duration') AS BIGINT) AS duration FROM ge"))
def _(spark, folder):
    return game_events(spark, folder).select(*PLACE, J.json_field(F.col("event_data"), "duration", "bigint").alias("duration"))


@query("n3_contains_token", on_log(
    f"SELECT {KEYS}, event_count, event_data LIKE '%true%' AS has_true, event_data LIKE '%false%' AS has_false FROM ge"))
def _(spark, folder):
    text = F.col("event_data")
    return game_events(spark, folder).select(
        *PLACE, X.contains_token(text, "true").alias("has_true"), X.contains_token(text, "false").alias("has_false"))


# --- row expressions ---


@query("x1_parse_timestamp", """
SELECT event_id, epoch_us(ts) AS us, CAST(NULL AS TIMESTAMP) IS NULL AS bad_is_null FROM events""")
def _(spark, folder):
    """ISO text with a zone letter parses to the same instant; unreadable text gives null."""
    events = spark.read.parquet(f"{folder}/events.parquet")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return events.select(
        "event_id",
        F.unix_micros(X.parse_timestamp(iso)).alias("us"),
        X.parse_timestamp(F.concat(F.lit("x"), iso)).isNull().alias("bad_is_null"),
    )


@query("x2_calendar_parts", on_log(
    f"SELECT {KEYS}, event_count, strftime(timestamp, '%Y-%m-%d') AS date, month(timestamp) AS month, "
    "hour(timestamp) AS hour, year(timestamp) AS year, CAST(isodow(timestamp) - 1 AS BIGINT) AS dayofweek FROM ge"))
def _(spark, folder):
    parts = X.calendar_parts(F.col("timestamp"))
    parts["date"] = parts["date"].cast("string")
    return game_events(spark, folder).withColumns(parts).select(*PLACE, *parts)


@query("x3_attempt_flag", on_flags(f"SELECT {KEYS}, event_count, attempt FROM fl"))
def _(spark, folder):
    return game_events(spark, folder).select(*PLACE, X.attempt_flag().alias("attempt"))


@query("x4_success_flag", on_flags(f"SELECT {KEYS}, event_count, is_attempt_successful FROM fl"))
def _(spark, folder):
    return game_events(spark, folder).select(*PLACE, X.success_flag().alias("is_attempt_successful"))


@query("x5_accuracy_group", on_assessments(f"SELECT {KEYS}, attempts, successes, accuracy_group FROM a"))
def _(spark, folder):
    return pick(session_frame(game_events(spark, folder)).filter(X.is_assessment()),
                "attempts", "successes", "accuracy_group")


@query("x6_safe_ratio", on_assessments(
    f"SELECT {KEYS}, {r6('CASE WHEN attempts = 0 THEN 0.0 ELSE successes / CAST(attempts AS DOUBLE) END', 'accuracy')} FROM a"))
def _(spark, folder):
    ratio = X.safe_ratio(F.col("successes"), F.col("attempts")).alias("accuracy")
    return pick(session_frame(game_events(spark, folder)).filter(X.is_assessment()), ratio)


@query("x7_fails", on_assessments(f"SELECT {KEYS}, attempts - successes AS fails FROM a"))
def _(spark, folder):
    return pick(session_frame(game_events(spark, folder)).filter(X.is_assessment()), "fails")


@query("x8_level_of", on_log(
    f"SELECT {KEYS}, event_count, CASE WHEN title LIKE '%Level%' THEN TRY_CAST(right(trim(title), 1) AS BIGINT) ELSE 0 END "
    "AS level FROM ge"))
def _(spark, folder):
    return game_events(spark, folder).select(*PLACE, X.level_of(F.col("title")).alias("level"))


@query("x9_strip_suffix_chars", on_log("SELECT DISTINCT title, rtrim(title, ' (Assessment)') AS stripped FROM ge"))
def _(spark, folder):
    titles = game_events(spark, folder).select("title").distinct()
    return titles.select("title", X.strip_suffix_chars(F.col("title")).alias("stripped"))


@query("x10_set_membership", on_log(
    f"SELECT {KEYS}, event_count, event_code IN (4100, 4110) AS is_try_code, world IN ('MAGMAPEAK', 'NONE') AS in_world FROM ge"))
def _(spark, folder):
    return game_events(spark, folder).select(
        *PLACE, F.col("event_code").isin(4100, 4110).alias("is_try_code"),
        F.col("world").isin("MAGMAPEAK", "NONE").alias("in_world"))


@query("x11_fill_null_with_zero", on_log(
    f"SELECT {KEYS}, event_count, coalesce(TRY_CAST(json_extract_string(event_data, '$.duration') AS BIGINT), 0) AS duration "
    "FROM ge"))
def _(spark, folder):
    duration = J.json_field(F.col("event_data"), "duration", "bigint").alias("duration")
    return game_events(spark, folder).select(*PLACE, duration).na.fill(0, ["duration"])


@query("x12_row_sum", on_log(
    f"SELECT {KEYS}, event_count, event_count + coalesce(TRY_CAST(json_extract_string(event_data, '$.duration') AS BIGINT), 0) "
    "+ game_time AS summed FROM ge"))
def _(spark, folder):
    duration = J.json_field(F.col("event_data"), "duration", "bigint")
    return game_events(spark, folder).select(
        *PLACE, X.row_sum(F.col("event_count"), duration, F.col("game_time")).alias("summed"))


@query("x13_round_to_int", "SELECT event_id, CAST(round_even(value, 0) AS BIGINT) AS rounded FROM events")
def _(spark, folder):
    return spark.read.parquet(f"{folder}/events.parquet").select(
        "event_id", F.bround("value", 0).cast("bigint").alias("rounded"))


@query("x14_paste", on_assessments(
    "SELECT installation_id, string_agg(concat_ws('/', title, CAST(attempts AS VARCHAR)), '; ' ORDER BY game_session) "
    "AS pasted FROM a GROUP BY installation_id"))
def _(spark, folder):
    sessions = session_frame(game_events(spark, folder)).filter(X.is_assessment())
    pasted = sessions.withColumn("pasted", X.paste(F.col("title"), F.col("attempts"), sep="/"))
    return A.paste_collapse(pasted, [LOG.entity], LOG.session, "pasted", "; ")


@query("x15_select_rename_drop", on_log(
    "SELECT world, title AS game_title, game_session, installation_id, event_count FROM ge"))
def _(spark, folder):
    return (game_events(spark, folder).withColumnRenamed("title", "game_title").drop("event_data", "event_code", "type")
            .select("world", "game_title", *PLACE))


@query("x16_keep_columns", on_log("SELECT installation_id, game_session, event_count, title FROM ge"))
def _(spark, folder):
    return A.keep_columns(game_events(spark, folder), ["title", "event_count", "game_session", "installation_id", "absent"])


@query("x17_row_filters", on_frame(
    f"SELECT {KEYS}, event_count, game_time FROM fr "
    "WHERE type = 'Assessment' AND game_time = session_time AND event_count = session_events"))
def _(spark, folder):
    last = ((F.col("game_time") == F.col("total_game_session_time"))
            & (F.col("event_count") == F.col("total_game_session_events")))
    return A.session_totals(game_events(spark, folder)).filter(X.is_assessment() & last).select(*PLACE, "game_time")


@query("x18_distinct_rows", on_log("SELECT DISTINCT installation_id, title, world FROM ge"))
def _(spark, folder):
    return game_events(spark, folder).select("installation_id", "title", "world").distinct()


# --- aggregates ---


@query("g1_session_totals", on_frame(
    f"SELECT {KEYS}, event_count, session_time AS total_game_session_time, session_events AS total_game_session_events FROM fr"))
def _(spark, folder):
    totals = ["total_game_session_time", "total_game_session_events"]
    return A.session_totals(game_events(spark, folder)).select(*PLACE, *totals)


@query("g2_assessment_totals", on_frame(
    f"SELECT {KEYS}, event_count, CASE WHEN type = 'Assessment' THEN session_time END AS assessment_session_time, "
    "CASE WHEN type = 'Assessment' THEN session_events END AS assessment_number_of_events FROM fr"))
def _(spark, folder):
    totals = ["assessment_session_time", "assessment_number_of_events"]
    return A.session_totals(game_events(spark, folder), only_assessments=True).select(*PLACE, *totals)


@query("g3_session_attempt_sums", on_flags(
    f"SELECT {KEYS}, CAST(sum(attempt) AS BIGINT) AS attempts, CAST(sum(is_attempt_successful) AS BIGINT) AS successes "
    f"FROM fl GROUP BY {KEYS}"))
def _(spark, folder):
    return pick(session_frame(game_events(spark, folder)), "attempts", "successes")


@query("g4_conditional_max", on_assessments(f"SELECT {KEYS}, try_events, try_time FROM a"))
def _(spark, folder):
    return pick(session_frame(game_events(spark, folder)).filter(X.is_assessment()), "try_events", "try_time")


@query("g5_session_mean_duration", on_assessments(f"SELECT {KEYS}, {r6('mean_duration', 'mean_duration')} FROM a"))
def _(spark, folder):
    return A.session_mean_of_field(game_events(spark, folder), "duration")


@query("g6_overall_measures", on_frame("SELECT title, " + ", ".join(
    r6(c, c) for c in ("overall_mean_game_session_time", "overall_mean_attempt", "overall_mean_is_attempt_successful",
                       "overall_mean_accuracy")) + " FROM tm", TITLE_MEANS))
def _(spark, folder):
    return title_measures(session_frame(game_events(spark, folder)))


@query("g7_class_proportions", on_assessments(
    f"SELECT accuracy_group, count(*) AS n, {r6('count(*) / CAST((SELECT count(*) FROM a) AS DOUBLE)', 'proportion')} "
    "FROM a GROUP BY accuracy_group"))
def _(spark, folder):
    return A.class_proportions(session_frame(game_events(spark, folder)).filter(X.is_assessment()), "accuracy_group")


@query("g8_rating_histogram", on_assessments(
    "SELECT r AS rating, count(a.attempts) AS n FROM (SELECT unnest(range(0, (SELECT max(attempts) FROM a) + 3)) AS r) "
    "LEFT JOIN a ON a.attempts = r GROUP BY r"))
def _(spark, folder):
    """Attempts per assessment, counted from 0 to two above the largest."""
    assessments = session_frame(game_events(spark, folder)).filter(X.is_assessment())
    high = assessments.agg(F.max("attempts")).first()[0] + 2
    return A.rating_histogram(assessments, "attempts", 0, high)


RATINGS = LAGGED + """,
ratings AS (
  SELECT installation_id, game_session, world, accuracy_group AS rater_a, past_assessment_ag AS rater_b,
    1 + session_events % 3 AS weight FROM q
)"""


def ratings_of(spark, folder):
    """Label and previous label of every assessment, with a group (world) and a weight."""
    steps = steps_of(spark, folder)
    past = B.first_event_block(steps, B.previous_accuracy()).select(*LOG.keys, "past_assessment_ag")
    return steps.assessments.join(past, LOG.keys).select(
        *LOG.keys, "world", F.col("accuracy_group").alias("rater_a"), F.col("past_assessment_ag").alias("rater_b"),
        (F.col("session_events") % 3 + 1).alias("weight"))


@query("g9_confusion_matrix", on_assessments(
    "SELECT x AS a, y AS b, count(rater_a) AS n FROM (SELECT unnest(range(0, 4)) AS x) CROSS JOIN (SELECT unnest(range(0, 4)) AS y) "
    "LEFT JOIN ratings ON rater_a = x AND rater_b = y GROUP BY x, y", RATINGS))
def _(spark, folder):
    return A.confusion_matrix(ratings_of(spark, folder), "rater_a", "rater_b", 0, 3)


@query("g9_confusion_matrix_wide", on_assessments(
    "SELECT rater_a AS a, " + ", ".join(f"count(*) FILTER (rater_b = {i}) AS b_{i}" for i in range(4))
    + " FROM ratings GROUP BY rater_a", RATINGS))
def _(spark, folder):
    return A.confusion_matrix_wide(ratings_of(spark, folder), "rater_a", "rater_b", [0, 1, 2, 3])


@query("g10_least_frequent", on_log(
    "SELECT event_code, n FROM (SELECT event_code, count(*) AS n FROM ge GROUP BY event_code) ORDER BY n, event_code LIMIT 1"))
def _(spark, folder):
    return A.least_frequent(game_events(spark, folder), "event_code")


@query("g11_class_count_range", "SELECT min(n) AS smallest, max(n) AS largest FROM (SELECT count(*) AS n FROM labels GROUP BY quality)")
def _(spark, folder):
    return A.class_count_range(spark.read.parquet(f"{folder}/labels.parquet"), "quality")


CORRELATED = ["attempts", "fails", "session_time", "session_events", "try_time", "constant"]


@query("g12_feature_label_correlation", on_assessments(
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 6) AS correlation "
        f"FROM (SELECT CAST({'1' if c == 'constant' else c} AS DOUBLE) AS x, CAST(accuracy_group AS DOUBLE) AS y FROM a)"
        for c in CORRELATED)))
def _(spark, folder):
    assessments = session_frame(game_events(spark, folder)).filter(X.is_assessment()).withColumn("constant", F.lit(1))
    return A.feature_label_correlation(assessments, "accuracy_group", CORRELATED)


@query("g13_distinct_titles", on_log("SELECT DISTINCT title FROM ge"))
def _(spark, folder):
    return game_events(spark, folder).select("title").distinct().orderBy("title")


@query("g14_distinct_count_per_cell", on_log(
    f"SELECT {KEYS}, " + ", ".join(
        f"count(DISTINCT CASE WHEN event_code = {c} THEN event_code END) AS code_{c}" for c in (2000, 2010, 2020, 2030, 4100, 4110))
    + f" FROM ge GROUP BY {KEYS}"))
def _(spark, folder):
    events = game_events(spark, folder)
    codes = distinct_values(events, "event_code")
    cells = events.groupBy(*LOG.keys).pivot("event_code", codes).agg(F.count_distinct("event_code"))
    return cells.select(*LOG.keys, *[F.coalesce(F.col(str(c)), F.lit(0)).alias(f"code_{c}") for c in codes])


@query("g15_row_mode", on_assessments(
    f"SELECT {KEYS}, v AS vote FROM (SELECT {KEYS}, v, row_number() OVER (PARTITION BY {KEYS} ORDER BY count(*) DESC, v) AS rn "
    "FROM (SELECT *, unnest([least(attempts, 3), successes, accuracy_group, fails]) AS v FROM a) "
    f"GROUP BY {KEYS}, v) WHERE rn = 1"))
def _(spark, folder):
    votes = session_frame(game_events(spark, folder)).filter(X.is_assessment()).withColumn(
        "capped", F.least("attempts", F.lit(3).cast("bigint"))).withColumn("label", F.col("accuracy_group").cast("bigint"))
    return pick(A.row_mode(votes, ["capped", "successes", "label", "fails"], "vote"), "vote")


@query("g15_mode_of_rows", on_log(
    "SELECT installation_id, event_code FROM (SELECT installation_id, event_code, row_number() OVER "
    "(PARTITION BY installation_id ORDER BY count(*) DESC, event_code) AS rn FROM ge GROUP BY installation_id, event_code) "
    "WHERE rn = 1"))
def _(spark, folder):
    return A.modes(game_events(spark, folder), [LOG.entity], "event_code")


@query("g16_first_per_group", on_assessments(
    "SELECT world, arg_min(weight, game_session) AS weight FROM ratings GROUP BY world", RATINGS))
def _(spark, folder):
    return A.first_by(ratings_of(spark, folder), ["world"], "weight", LOG.session)


# --- joins ---


@query("j1_join_blocks", on_all(
    f"SELECT {KEYS}, counter AS assessments_played_counter, ord AS game_session_order, session_time, accuracy_group FROM "
    f"(SELECT {KEYS}, counter, accuracy_group FROM a) JOIN (SELECT {KEYS}, ord, session_time FROM term) USING ({KEYS})"))
def _(spark, folder):
    steps = steps_of(spark, folder)
    return D.join_blocks([
        B.first_event_block(steps, B.assessment_counter()),
        pick(B.terminal_event_block(steps, B.session_order()), "game_session_order"),
        pick(steps.assessments, "session_time", "accuracy_group"),
    ])


ORDERED = f"\nsorted AS (SELECT {KEYS}, ord AS game_session_order FROM term WHERE type = 'Assessment')"
LABELLED = f"\nlabelled AS ({LABELS})"
LAST = (f"\nlast_one AS (SELECT {KEYS} FROM a QUALIFY row_number() OVER "
        "(PARTITION BY installation_id ORDER BY first_ts DESC, game_session DESC) = 1)")


def order_block(steps):
    return pick(B.terminal_event_block(steps, B.session_order()), "game_session_order")


def known_labels(steps):
    return pick(steps.assessments.filter("attempts > 0"), "accuracy_group")


@query("j2_join_labels", on_all(f"SELECT * FROM sorted JOIN labelled USING ({KEYS})", ORDERED, LABELLED))
def _(spark, folder):
    steps = steps_of(spark, folder)
    return D.training_set(order_block(steps), known_labels(steps))


@query("j3_right_join", on_all(
    f"SELECT {KEYS}, accuracy_group FROM labelled RIGHT JOIN last_one USING ({KEYS})", LABELLED, LAST))
def _(spark, folder):
    steps = steps_of(spark, folder)
    return D.prediction_set(known_labels(steps), D.last_assessment(steps.assessments))


@query("j4_left_join", on_all(
    f"SELECT {KEYS}, accuracy_group FROM last_one LEFT JOIN labelled USING ({KEYS})", LABELLED, LAST))
def _(spark, folder):
    steps = steps_of(spark, folder)
    return D.target_features(D.last_assessment(steps.assessments), known_labels(steps))


@query("j5_left_join_by_id", "SELECT doc_id, n_chars, CAST(quality AS BIGINT) AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def _(spark, folder):
    documents = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "n_chars")
    return documents.join(spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality"), "doc_id", "left")


@query("j6_semi_join_two_memberships", on_all(
    "SELECT * FROM sorted WHERE game_session IN (SELECT game_session FROM last_one) "
    "AND installation_id IN (SELECT installation_id FROM last_one)", ORDERED, LAST))
def _(spark, folder):
    steps = steps_of(spark, folder)
    return D.members_of_both(order_block(steps), D.last_assessment(steps.assessments))


@query("j7_semi_join_pair", on_all(f"SELECT * FROM sorted SEMI JOIN last_one USING ({KEYS})", ORDERED, LAST))
def _(spark, folder):
    steps = steps_of(spark, folder)
    return D.restrict_to(order_block(steps), D.last_assessment(steps.assessments))


@query("j8_anti_join", on_all(
    "SELECT * FROM sorted WHERE NOT EXISTS (SELECT 1 FROM last_one l WHERE l.game_session = sorted.game_session)",
    ORDERED, LAST))
def _(spark, folder):
    steps = steps_of(spark, folder)
    last = D.last_assessment(steps.assessments).select(LOG.session)
    return order_block(steps).join(last, LOG.session, "left_anti")


@query("j9_title_dimension_join", on_frame(
    f"SELECT {KEYS}, title, {r6('overall_mean_attempt', 'overall_mean_attempt')} FROM "
    f"(SELECT DISTINCT {KEYS}, title FROM fr WHERE type = 'Assessment') JOIN tm USING (title)", TITLE_MEANS))
def _(spark, folder):
    """Few titles: the planner broadcasts them by measured size, or splits a hot title in a shuffle join."""
    steps = steps_of(spark, folder)
    means = title_measures(steps.sessions).select("title", "overall_mean_attempt")
    return pick(steps.assessments.join(means, "title"), "title", "overall_mean_attempt")


@query("j10_bind_columns", on_log(
    f"SELECT {KEYS}, event_count, event_code, json_extract_string(event_data, '$.correct') AS correct FROM ge"))
def _(spark, folder):
    """Columns of two frames over the same rows, bound by key."""
    events = game_events(spark, folder)
    left = events.select(*PLACE, "event_code")
    right = events.select(*PLACE, F.get_json_object("event_data", "$.correct").alias("correct"))
    return left.join(right, PLACE, "inner")


# --- unions, sorts, limits ---


@query("u1_union_classes", on_assessments(f"SELECT {KEYS}, accuracy_group FROM a"))
def _(spark, folder):
    sessions = pick(steps_of(spark, folder).assessments, "accuracy_group")
    slices = [sessions.filter(F.col("accuracy_group") == g) for g in range(4)]
    return slices[0].unionByName(slices[1]).unionByName(slices[2]).unionByName(slices[3])


@query("u2_sort", on_log(f"SELECT {KEYS}, event_count FROM ge ORDER BY installation_id, timestamp, game_session"))
def _(spark, folder):
    return game_events(spark, folder).orderBy("installation_id", "timestamp", "game_session").select(*PLACE)


# --- data sets ---


@query("b16_training_set", feature_sql("main", f"feat JOIN labelled l USING ({KEYS})", ", l.accuracy_group").replace(
    "\nlab AS (", f"\nlabelled AS ({LABELS}),\nlab AS ("))
def _(spark, folder):
    steps = steps_of(spark, folder)
    return D.training_set(features_of(steps, "main"), known_labels(steps))


@query("b16_prediction_set", feature_sql("main", f"feat RIGHT JOIN last_one USING ({KEYS})").replace(
    "\nlab AS (", LAST + ",\nlab AS ("))
def _(spark, folder):
    steps = steps_of(spark, folder)
    return D.prediction_set(features_of(steps, "main"), D.last_assessment(steps.assessments))


@query("b16_holdout_split", feature_sql(
    "self_label", "feat", ", CASE WHEN assessments_played = max(assessments_played) OVER (PARTITION BY installation_id) "
    "THEN 'latest' ELSE 'earlier' END AS part"))
def _(spark, folder):
    earlier, latest = D.holdout_split(build_features(stored_game_events(spark, folder), "self_label"))
    return earlier.withColumn("part", F.lit("earlier")).unionByName(latest.withColumn("part", F.lit("latest")))


@query("b9_calendar_rows_all_hours", on_log("SELECT * FROM cal", CALENDAR))
def _(spark, folder):
    return calendar_rows(game_events(spark, folder), keep="all")
