"""Hand-computed micro-logs for the rules that the given tables do not exercise."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from playtrace.functions import scalars as X
from playtrace.operators import aggregates as A
from playtrace.operators.sessions import SessionSteps, session_frame, with_running_attempts
from playtrace.plans import blocks as B
from playtrace.plans import datasets as D
from playtrace.plans.calendar import calendar_rows
from playtrace.plans.features import VARIANTS, build_features, fit_vocabulary
from playtrace.sources.tables import EVENT_LOG_SCHEMA

T0 = dt.datetime(2024, 1, 1, 12, 0)
BLOCK, BIRD = "Block Stacker (Assessment)", "Bird Measurer (Assessment)"
WON, LOST = '{"correct":true}', '{"correct":false}'


def event(session, minute, count, code=2000, data=LOST, entity="e", title=BLOCK, kind="Assessment", world="MAGMAPEAK",
          time=None, start=T0):
    ts = start + dt.timedelta(minutes=minute)
    return ("t", session, ts, data, entity, count, code, time if time is not None else minute * 60000, title, kind, world)


def log(spark, *rows):
    return spark.createDataFrame(list(rows), EVENT_LOG_SCHEMA)


def by_session(df):
    return {r["game_session"]: r for r in df.collect()}


@pytest.fixture(params=[False, True], ids=["plain", "hot"])
def either_way(request, spark):
    if request.param:
        spark.conf.set("spark.playtrace.groupRows", "1")
    yield
    spark.conf.unset("spark.playtrace.groupRows")


def interleaved(spark):
    """Session a starts first but ends last; attempts alternate."""
    return log(
        spark,
        event("a", 0, 1), event("b", 1, 1), event("a", 2, 2, 4100, WON), event("b", 3, 2, 4100, LOST),
        event("b", 4, 3), event("a", 5, 3, 4100, LOST),
    )


def test_interleaved_sessions_keep_both_orders(spark, either_way):
    steps = SessionSteps(interleaved(spark))
    first = by_session(B.first_event_block(steps, B.assessment_counter(), B.previous_accuracy()))
    assert (first["a"]["assessments_played_counter"], first["b"]["assessments_played_counter"]) == (1, 2)
    assert (first["b"]["past_assessment_att"], first["b"]["past_assessment_succ"], first["b"]["past_assessment_ag"]) == (2, 1, 2)
    past = by_session(B.past_attempts_block(steps))
    assert (past["b"]["game_session_order"], past["a"]["game_session_order"]) == (1, 2)
    # b ends at minute 4: one won attempt of a and its own lost one lie before.
    assert (past["a"]["past_total_attempts"], past["a"]["past_total_successes"]) == (2, 1)
    assert past["a"]["past_assessments_played"] == 2
    assert past["b"]["past_total_attempts"] == 0


def test_running_attempts_per_event(spark, either_way):
    rows = {(r["game_session"], r["event_count"]): r for r in with_running_attempts(interleaved(spark)).collect()}
    assert [rows[k]["cumulative_attempts"] for k in [("a", 1), ("b", 1), ("a", 2), ("b", 2), ("b", 3), ("a", 3)]] == [0, 0, 1, 2, 2, 3]
    assert rows[("a", 3)]["cumulative_fails"] == 2


def test_session_without_terminal_row_drops_out(spark):
    events = log(
        spark,
        event("bad", 0, 1), event("bad", 1, 3, 4100, WON, time=10), event("bad", 2, 2, time=20),
        event("good", 60, 1), event("good", 61, 2),
    )
    frame = by_session(session_frame(events))
    assert (frame["bad"]["terminal"], frame["good"]["terminal"]) == (False, True)
    features = by_session(build_features(events, "main"))
    assert list(features) == ["good"]
    # The dropped session still counts in first-event histories and in the running attempts.
    assert features["good"]["past_assessment_ag"] == 3
    assert features["good"]["total_games_played"] == 1


def test_single_assessment(spark, either_way):
    events = log(spark, event("a", 0, 1), event("a", 1, 2, 4100, WON))
    steps = SessionSteps(events)
    assert D.second_last_assessment(steps.assessments).count() == 0
    assert D.last_assessment(steps.assessments).count() == 1
    row = build_features(events, "main").first().asDict()
    lags = [v for k, v in row.items() if k.startswith(("past_", "prev_", "cumstd", "cumsd", "cummean"))]
    assert lags and all(v == 0 for v in lags)
    assert (row["zeros"], row["ones"], row["twos"], row["threes"]) == (1, 0, 0, 0)
    assert row["std_total_time_spent"] == 0


def test_accuracy_groups(spark):
    rows = [(3, 3, 3), (1, 2, 2), (1, 3, 1), (0, 2, 0), (2, 3, 0), (0, 0, 0)]
    df = spark.createDataFrame(rows, "s int, a int, want int")
    got = df.select("want", X.accuracy_group(F.col("s"), F.col("a")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got)


def test_zero_attempts_and_decoy_codes(spark):
    events = log(
        spark,
        event("plain", 0, 1, 4110, WON), event("bird", 60, 1, 4100, WON, title=BIRD),
        event("real", 120, 1, 4110, WON, title=BIRD),
    )
    rows = by_session(session_frame(events))
    assert [rows[s]["attempts"] for s in ("plain", "bird", "real")] == [0, 0, 1]
    assert [rows[s]["accuracy_group"] for s in ("plain", "bird", "real")] == [0, 0, 3]
    assert session_frame(events).select(X.safe_ratio(F.col("successes"), F.col("attempts"))).filter("game_session = 'plain'").first()[0] == 0.0


def test_midnight_keeps_the_smallest_hour(spark):
    start = dt.datetime(2024, 1, 1, 23, 50)
    events = log(spark, event("a", 0, 1, start=start), event("a", 20, 2, start=start))
    kept = calendar_rows(events).collect()
    assert [(r["hour"], r["dayofweek"]) for r in kept] == [(0, 1)]
    assert calendar_rows(events, keep="all").count() == 2
    row = build_features(events, "boosted").first()
    assert (row["hour"], row["dayofweek"], row["month"], row["year"]) == (0, 1, 1, 2024)


def test_null_payload_and_title_give_zero_flags(spark):
    events = log(spark, event("a", 0, 1, 4100, None), event("b", 1, 1, 4100, WON, title=None), event("c", 2, 1, None, WON))
    rows = X.with_flags(events).select("attempt", "is_attempt_successful").collect()
    assert [tuple(r) for r in rows] == [(1, 0), (0, 0), (0, 0)]


def test_level_text_and_title_strip(spark):
    df = spark.createDataFrame([("Level 12",), ("Level x",), ("Hoops",), ("Trail - Level 3 ",), (None,)], "t string")
    assert [r[0] for r in df.select(X.level_of(F.col("t"))).collect()] == [2, None, 0, 3, 0]
    df = spark.createDataFrame([("Big Tent (Assessment)",), ("Pan Balancer (Assessment)",)], "t string")
    assert [r[0] for r in df.select(X.strip_suffix_chars(F.col("t"))).collect()] == ["Big T", "Pan Balancer"]


def test_mode_ties_take_the_smallest(spark):
    df = spark.createDataFrame([(3, 0, 3, 0), (1, 2, 2, None)], "a int, b int, c int, d int")
    assert [r["mode"] for r in A.row_mode(df, ["a", "b", "c", "d"]).collect()] == [0, 2]
    long = spark.createDataFrame([(1, 3), (1, 0), (1, 3), (1, 0)], "k int, v int")
    assert A.modes(long, ["k"], "v").first()["v"] == 0


def test_constant_feature_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0, 0), (1.0, 4.0, 1), (1.0, 6.0, 2)], "c double, x double, y int")
    table = {r["feature"]: r["correlation"] for r in A.feature_label_correlation(df, "y").collect()}
    assert table["c"] is None and abs(table["x"] - 1) < 1e-12
    assert A.correlated_features(df, "y") == ["x"]


def test_paste(spark):
    df = spark.createDataFrame([("k", 2, "b", 1), ("k", 1, "a", 2)], "k string, o int, s string, n int")
    pasted = df.withColumn("p", X.paste(F.col("s"), F.col("n"), sep="-"))
    assert A.paste_collapse(pasted, ["k"], "o", "p", "+").first()["p"] == "a-2+b-1"


def test_train_and_test_get_the_same_columns(spark):
    train = log(spark, event("a", 0, 1), event("b", 60, 1, title=BIRD, world="CRYSTALCAVES"))
    test = log(spark, event("c", 0, 1, entity="f"))
    known = fit_vocabulary(train)
    for variant in VARIANTS:
        assert build_features(train, variant, known).columns == build_features(test, variant, known).columns


def test_total_time_includes_the_current_session_unless_told_otherwise(spark):
    steps = SessionSteps(log(spark, event("a", 0, 1), event("a", 2, 2), event("b", 60, 1, time=0), event("b", 63, 2, time=5)))
    now = by_session(B.terminal_event_block(steps, B.time_per_type()))
    then = by_session(B.terminal_event_block(steps, B.time_per_type(include_current=False)))
    assert (now["b"]["time_spent_on_assessments"], then["b"]["time_spent_on_assessments"]) == (120005, 120000)
    assert then["a"]["total_time_spent"] == 0
