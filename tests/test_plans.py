"""The plans are the ones meant for a cluster."""

import re

from conftest import FOLDER

from playtrace.operators.sessions import SessionSteps, attempt_rows, session_frame
from playtrace.plans.features import features_of, fit_vocabulary
from playtrace.sources.activity import stored_game_events


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_session_pass_combines_before_one_shuffle(spark):
    events = stored_game_events(spark, FOLDER)
    plan = plan_of(session_frame(events, merged=False))
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("HashAggregate") == 2 and "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
    assert "Window" not in plan
    # Parts of one session meet in a second shuffle, which carries a row for each session.
    assert plan_of(session_frame(events)).count("Exchange hashpartitioning") == 2


def test_attempt_pass_filters_at_the_scan(spark):
    plan = plan_of(attempt_rows(stored_game_events(spark, FOLDER)))
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", plan).group(1)
    assert "EqualTo(type,Assessment)" in pushed and "In(event_code" in pushed
    read = re.search(r"FileScan parquet \[(.*?)\]", plan).group(1)
    assert "world" not in read and "game_time" not in read


def test_feature_table_lays_out_by_entity_once(spark):
    steps = SessionSteps(stored_game_events(spark, FOLDER))
    plan = plan_of(features_of(steps, "boosted", fit_vocabulary(steps.sessions)))
    assert plan.count("Exchange") == 1 and plan.count("Exchange hashpartitioning(installation_id") == 1
    assert len(re.findall(r"\bSort \[", plan)) == 2
    assert not any(w in plan for w in ("Join", "CartesianProduct", "Python", "SinglePartition"))


def test_nothing_in_the_session_operators_is_python_or_cartesian(spark):
    from __spark_entry__ import queries

    for name in ("b2_past_attempts_and_successes", "w2_assessment_counter", "g6_overall_measures", "g7_class_proportions",
                 "m3_cohen_kappa", "l1_balanced_resample_over", "j6_semi_join_two_memberships"):
        plan = plan_of(queries()[name](spark, FOLDER))
        assert not any(w in plan for w in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEval")), name


def test_unused_blocks_are_pruned(spark):
    steps = SessionSteps(stored_game_events(spark, FOLDER))
    plan = plan_of(features_of(steps, "main", fit_vocabulary(steps.sessions)).select("installation_id", "zeros"))
    assert "cumsd_time" not in plan and "time_spent_in" not in plan


def test_class_proportions_use_no_window(spark):
    from playtrace.operators.aggregates import class_proportions

    shares = class_proportions(spark.createDataFrame([(1,), (1,), (None,), (2,)], "c int"), "c")
    assert "Window" not in shares._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in shares.collect()] == [(None, 1, 0.25), (2, 1, 0.25), (1, 2, 0.5)]
