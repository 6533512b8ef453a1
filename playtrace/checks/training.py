"""Queries that train models: T rows, plus the importance sorts of U."""

from __future__ import annotations

from pyspark.sql import functions as F

from playtrace.checks.histories import FEATURE_VIEWS, feature_columns_sql, on_all
from playtrace.checks.registry import plain_types, query
from playtrace.config import DEFAULT_LOG as LOG
from playtrace.models import combined as C
from playtrace.models import histograms as H
from playtrace.models import learners as E
from playtrace.models import selection as P
from playtrace.models.neighbours import NeighbourLearner, nearest, neighbour_votes
from playtrace.operators import aggregates as A
from playtrace.operators.metrics import compare_models
from playtrace.plans import datasets as D
from playtrace.plans.features import build_features
from playtrace.runtime import materialize
from playtrace.sources.activity import stored_game_events

CLASSES = 4


def game_sets(spark, folder, columns: list[str] | None = None):
    """Assembled (train, test, feature names): all assessments but the latest of each entity, and those."""
    features = build_features(stored_game_events(spark, folder), "self_label")
    names = columns or [c for c in features.columns if c not in (*LOG.keys, "accuracy_group")]
    earlier, latest = D.holdout_split(features)
    rows = earlier.withColumn("part", F.lit("train")).unionByName(latest.withColumn("part", F.lit("test")))
    both = E.assemble(rows, names, "accuracy_group", [*LOG.keys, "part"])
    return both.filter("part = 'train'").drop("part"), both.filter("part = 'test'").drop("part"), names


def predicted(model, test):
    return model.predict(test).select(*LOG.keys, F.col("label").cast("int"), F.col("prediction").cast("int"))


def vectors_of(spark, folder):
    return spark.read.parquet(f"{folder}/embeddings.parquet").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")


@query("t1_random_forest")
def _(spark, folder):
    train, test, _ = game_sets(spark, folder)
    return predicted(E.forest(20, 6).fit(train), test)


@query("t2_boosted_trees")
def _(spark, folder):
    train, test, _ = game_sets(spark, folder)
    return predicted(E.boosted_trees(3, 3).fit(train), test)


@query("t3_decision_tree")
def _(spark, folder):
    train, test, _ = game_sets(spark, folder)
    return predicted(E.decision_tree(6).fit(train), test)


@query("t4_logistic_regression")
def _(spark, folder):
    train, test, _ = game_sets(spark, folder)
    return predicted(E.logistic(30).fit(train), test)


@query("t5_bagged_trees")
def _(spark, folder):
    train, test, _ = game_sets(spark, folder)
    return predicted(E.bagged_trees(10, 6).fit(train), test)


@query("t6_adaptive_boosting")
def _(spark, folder):
    train, test, _ = game_sets(spark, folder)
    return predicted(C.AdaptiveBoosting(CLASSES).fit(train), test)


@query("t7_perceptron")
def _(spark, folder):
    train, test, names = game_sets(spark, folder)
    return predicted(E.perceptron(len(names), CLASSES, 100, 30).fit(train), test)


def neighbour_sql(k: int) -> str:
    return f"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings),
pairs AS (
  SELECT q.vec_id, t.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.e, t.e), t.vec_id) AS n
  FROM v q CROSS JOIN v t
)
SELECT vec_id, CAST(label AS BIGINT) AS vote FROM (
  SELECT vec_id, label, row_number() OVER (PARTITION BY vec_id ORDER BY count(*) DESC, label) AS place
  FROM pairs WHERE n <= {k} GROUP BY vec_id, label
) WHERE place = 1"""


@query("t8_nearest_neighbour_vote", neighbour_sql(8))
def _(spark, folder):
    rows = vectors_of(spark, folder)
    votes = neighbour_votes(nearest(rows, rows, 8))
    return rows.join(votes, "v").select(F.col("id").alias("vec_id"), "vote")


@query("t9_ordinal_classifier")
def _(spark, folder):
    train, test, _ = game_sets(spark, folder)
    return predicted(C.OrdinalLearner(E.forest(5, 5), CLASSES).fit(train), test)


CHANCES = [f"abs(embedding[{i}])" for i in (1, 2, 3)]


@query("t9_ordinal_combination", """
SELECT vec_id, round(s0, 6) AS s0, round(s1, 6) AS s1, round(s2, 6) AS s2, round(s3, 6) AS s3,
  CASE WHEN s0 >= greatest(s1, s2, s3) THEN 0 WHEN s1 >= greatest(s2, s3) THEN 1 WHEN s2 >= s3 THEN 2 ELSE 3 END AS picked
FROM (SELECT vec_id, 1 - a AS s0, a - b AS s1, b - c AS s2, c AS s3 FROM (
  SELECT vec_id, abs(CAST(embedding[1] AS DOUBLE)) AS a, abs(CAST(embedding[2] AS DOUBLE)) AS b,
    abs(CAST(embedding[3] AS DOUBLE)) AS c FROM embeddings))""".replace("THEN 0", "THEN CAST(0 AS BIGINT)"))
def _(spark, folder):
    rows = vectors_of(spark, folder)
    scores = C.ordinal_scores([F.abs(F.col("v")[i]) for i in range(3)])
    rows = rows.select(F.col("id").alias("vec_id"), scores.alias("s"))
    return rows.select("vec_id", *[F.col("s")[i].alias(f"s{i}") for i in range(4)],
                       E.argmax(F.col("s")).cast("int").alias("picked"))


VOTES_SQL = """
WITH v AS (
  SELECT vec_id, unnest([CAST(label % 3 AS BIGINT), CAST(abs(embedding[1]) * 1000 AS INT) % 3, vec_id % 3]) AS choice,
    unnest([2, 1, 1]) AS w FROM embeddings
)
SELECT vec_id, choice FROM (
  SELECT vec_id, choice, row_number() OVER (PARTITION BY vec_id ORDER BY sum(w) DESC, choice) AS n FROM v GROUP BY vec_id, choice
) WHERE n = 1"""


@query("t10_hard_vote", VOTES_SQL)
def _(spark, folder):
    rows = vectors_of(spark, folder)
    third = (F.round(F.abs(F.element_at("v", 1)) * 1000).cast("bigint") % 3)
    votes = F.array(
        F.struct((F.col("label") % 3).cast("bigint").alias("choice"), F.lit(2).alias("w")),
        F.struct(third.alias("choice"), F.lit(1).alias("w")),
        F.struct((F.col("id") % 3).alias("choice"), F.lit(1).alias("w")))
    long = rows.select(F.col("id").alias("vec_id"), F.explode(votes).alias("x")).select("vec_id", "x.choice", "x.w")
    return C.hard_vote(long, ["vec_id"], "choice", "w")


@query("t10_voting_models")
def _(spark, folder):
    train, test, _ = game_sets(spark, folder)
    members = [E.forest(5, 5).fit(train), E.decision_tree(4).fit(train), E.logistic(20).fit(train)]
    return predicted(C.VotingModel(members, CLASSES, [1.0, 1.0, 1.0]), test)


@query("t11_resample_and_vote")
def _(spark, folder):
    train, test, _ = game_sets(spark, folder)
    voted = C.resample_and_vote(train, test, H.HistogramForest(CLASSES, 10, 6), LOG.keys, rounds=40)
    return voted.select(*LOG.keys, *[f"pred_{i}" for i in range(40)], F.col("prediction").cast("int"))


def stack_bases():
    return [H.HistogramTree(CLASSES, 5), NeighbourLearner(CLASSES, LOG.session), C.AdaptiveBoosting(CLASSES),
            H.HistogramForest(CLASSES, 10, 5, "all"), H.HistogramForest(CLASSES, 10, 5)]


@query("t12_stacking")
def _(spark, folder):
    train, test, _ = game_sets(spark, folder)
    model = C.StackedLearner(stack_bases(), LOG.keys, folds=10).fit(train)
    names = [f"base_{i}" for i in range(len(model.bases))]
    judged = model.predict(model.base_scores(test, names))
    picks = [E.argmax(F.col(n)).cast("int").alias(n) for n in names]
    return judged.select(*LOG.keys, F.col("label").cast("int"), *picks, F.col("prediction").cast("int"))


def fitted_importances(spark, folder):
    train, _, names = game_sets(spark, folder)
    return E.feature_importances(E.forest(20, 6).fit(train), names, spark)


@query("t13_feature_importances")
def _(spark, folder):
    return fitted_importances(spark, folder)


@query("u3_sort_descending")
def _(spark, folder):
    return fitted_importances(spark, folder).orderBy(F.desc("importance"))


@query("u4_top_features")
def _(spark, folder):
    return E.top_features(fitted_importances(spark, folder), 10)


@query("t14_recursive_elimination")
def _(spark, folder):
    train, _, names = game_sets(spark, folder)
    return P.eliminate(train, names, 3, H.HistogramForest(CLASSES, 5, 5), keys=LOG.keys).table(spark)


@query("t15_elimination_sweep")
def _(spark, folder):
    train, test, names = game_sets(spark, folder)
    table, best = P.elimination_sweep(train, test, names, H.HistogramForest(CLASSES, 5, 5), LOG.keys)
    return table.withColumn("is_best", F.col("n_features") == best)


@query("t16_tree_count_sweep")
def _(spark, folder):
    train, test, _ = game_sets(spark, folder)
    return P.tree_count_sweep(train, test)


@query("t17_random_search")
def _(spark, folder):
    train, _, _ = game_sets(spark, folder)
    return P.random_search(train, keys=LOG.keys)[0]


def correlations_sql(rest: str = "") -> str:
    return on_all(
        "SELECT feature, correlation FROM (SELECT feature, round(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 6) AS correlation "
        f"FROM wide UNPIVOT INCLUDE NULLS (x FOR feature IN (COLUMNS(* EXCLUDE (y)))) GROUP BY feature) {rest}",
        *FEATURE_VIEWS, f"\nsel AS (SELECT {feature_columns_sql('self_label')} FROM feat)",
        "\nwide AS (SELECT CAST(COLUMNS(* EXCLUDE (accuracy_group)) AS DOUBLE), CAST(accuracy_group AS DOUBLE) AS y FROM sel)")


def all_correlations(spark, folder):
    """Correlation of every numeric feature with the label, rounded so that two engines order equal values alike."""
    features = materialize(plain_types(build_features(stored_game_events(spark, folder), "self_label")), "features")
    names = [c for c in features.columns if c not in (*LOG.keys, "accuracy_group")]
    found = A.feature_label_correlation(features, "accuracy_group", names)
    return found.select("feature", F.round("correlation", 6).alias("correlation"))


@query("g12_all_feature_correlations", correlations_sql())
def _(spark, folder):
    return all_correlations(spark, folder)


@query("u3_sort_correlations_descending", correlations_sql("ORDER BY correlation DESC NULLS LAST, feature"))
def _(spark, folder):
    return all_correlations(spark, folder).orderBy(F.desc_nulls_last("correlation"), "feature")


@query("u4_top_correlations", correlations_sql("ORDER BY correlation DESC NULLS LAST, feature LIMIT 10"))
def _(spark, folder):
    return E.top_features(all_correlations(spark, folder).withColumnRenamed("correlation", "importance"), 10).withColumnRenamed("importance", "correlation")


@query("t18_correlation_filter", on_all(
    "SELECT feature, round(r, 6) AS correlation FROM (SELECT feature, covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) AS r "
    "FROM wide UNPIVOT INCLUDE NULLS (x FOR feature IN (COLUMNS(* EXCLUDE (y)))) GROUP BY feature) WHERE abs(r) > 0.05",
    *FEATURE_VIEWS, f"\nsel AS (SELECT {feature_columns_sql('self_label')} FROM feat)",
    "\nwide AS (SELECT CAST(COLUMNS(* EXCLUDE (accuracy_group)) AS DOUBLE), CAST(accuracy_group AS DOUBLE) AS y FROM sel)"))
def _(spark, folder):
    # Rounded as the views are, so that both engines correlate the same values.
    features = materialize(plain_types(build_features(stored_game_events(spark, folder), "self_label")), "features")
    return A.strong_correlations(features.drop(*LOG.keys), "accuracy_group", 0.05)


@query("m8_compare_trained_models")
def _(spark, folder):
    train, test, _ = game_sets(spark, folder)
    parts = []
    for name, learner in {"forest": E.forest(5, 5), "tree": E.decision_tree(5), "logistic": E.logistic(20)}.items():
        model = learner.fit(train)
        for split, rows in {"train": train, "test": test}.items():
            judged = model.predict(rows).select("label", "prediction")
            parts.append(judged.select(F.lit(name).alias("model"), F.lit(split).alias("split"), "*"))
    long = parts[0]
    for part in parts[1:]:
        long = long.unionByName(part)
    return compare_models(long, "label", "prediction", ["model", "split"])
