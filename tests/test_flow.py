"""The README's flow from two logs to written predictions."""

import pytest
from conftest import FOLDER
from pyspark.sql import functions as F

from playtrace.models import combined, learners
from playtrace.operators import aggregates
from playtrace.operators.sessions import SessionSteps
from playtrace.plans import datasets
from playtrace.plans.features import features_of, fit_vocabulary
from playtrace.runtime import materialize, new_path
from playtrace.sources.activity import stored_game_events
from playtrace.sources.tables import PREDICTIONS_SCHEMA, write_predictions


def test_from_logs_to_predictions(spark):
    events = stored_game_events(spark, FOLDER)
    train = SessionSteps(events.filter("installation_id < 'i000010'"))
    test = SessionSteps(events.filter("installation_id >= 'i000010'"))
    known = fit_vocabulary(train.sessions)
    labels = train.assessments.filter("attempts > 0").select("installation_id", "game_session", "accuracy_group")
    table = materialize(datasets.training_set(features_of(train, "main", known), labels))
    names = aggregates.correlated_features(table.drop("installation_id", "game_session"), "accuracy_group", 0.05)
    assert names and "accuracy_group" not in names
    targets = datasets.prediction_set(features_of(test, "main", known), datasets.last_assessment(test.assessments))
    keys = ["installation_id", "game_session"]
    voted = combined.resample_and_vote(
        learners.assemble(table, names, "accuracy_group", keys), learners.assemble(targets, names, keep=keys),
        learners.forest(trees=5, depth=4), keys, rounds=2)
    path = new_path(spark, "out-csv")
    write_predictions(voted, path)
    back = spark.read.schema(PREDICTIONS_SCHEMA).csv(path, header=True)
    assert back.count() == test.assessments.select("installation_id").distinct().count() > 0
    assert back.filter(~F.col("accuracy_group").isin(0, 1, 2, 3)).count() == 0


def test_a_cluster_without_shared_folder_is_refused():
    from playtrace import runtime

    class Context:
        master = "spark://somewhere"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        runtime.shared_folder(Session())
