"""Metric identities, resampling and folds."""

import random

import pytest
from pyspark.sql import functions as F

from playtrace.operators import aggregates as A
from playtrace.operators import metrics as M
from playtrace.operators import sampling as L


def ratings(spark, seed=1, n=400, k=4):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(k), rng.randrange(k), rng.choice("xyz"), rng.random() + 0.1) for i in range(n)]
    return spark.createDataFrame(rows, "id int, a int, b int, g string, w double"), rows


def grid_kappa(rows, k):
    n = len(rows)
    seen = expected = 0.0
    for i in range(k):
        for j in range(k):
            d = (i - j) ** 2 / (k - 1) ** 2
            seen += d * sum(r[1] == i and r[2] == j for r in rows) / n
            expected += d * sum(r[1] == i for r in rows) * sum(r[2] == j for r in rows) / n / n
    return 1 - seen / expected


@pytest.mark.parametrize("seed", [1, 2])
def test_kappa_equals_grid_and_is_symmetric(spark, seed):
    df, rows = ratings(spark, seed)
    want = grid_kappa(rows, 4)
    one = M.quadratic_weighted_kappa(df, "a", "b").first()[0]
    assert abs(one - want) < 1e-12
    assert abs(M.quadratic_weighted_kappa(df, "b", "a").first()[0] - want) < 1e-12
    assert abs(M.quadratic_weighted_kappa_from_grid(df, "a", "b").first()[0] - want) < 1e-12


def test_kappa_without_disagreement_to_expect_is_null(spark):
    df = spark.createDataFrame([(1, 1), (1, 1)], "a int, b int")
    assert M.quadratic_weighted_kappa(df, "a", "b").first()[0] is None
    assert M.quadratic_weighted_kappa_from_grid(df, "a", "b").first()[0] is None
    assert M.cohen_kappa(df, "a", "b").first()[0] is None


def test_mean_kappa_clamps_and_weighs(spark):
    df = spark.createDataFrame([(1.0, 1.0), (0.0, 3.0)], "k double, w double")
    clamped = M.mean_kappa(spark.createDataFrame([(1.0,)], "k double"), "k").first()[0]
    assert abs(clamped - 0.999) < 1e-12
    assert 0 < M.mean_kappa(df, "k", "w").first()[0] < M.mean_kappa(df, "k").first()[0]


def test_report_and_matrix_agree(spark):
    df, rows = ratings(spark)
    matrix = {(r["a"], r["b"]): r["n"] for r in A.confusion_matrix(df, "a", "b", 0, 5).collect()}
    assert len(matrix) == 36 and sum(matrix.values()) == len(rows)
    report = {r["class"]: r for r in M.classification_report(df, "a", "b").collect()}
    for c in range(4):
        assert report[str(c)]["support"] == sum(matrix[c, j] for j in range(6))
        assert abs(report[str(c)]["recall"] * report[str(c)]["support"] - matrix[c, c]) < 1e-9
    agree = M.accuracy(df, "a", "b").first()[0]
    assert abs(report["weighted avg"]["recall"] - agree) < 1e-12


def test_a_class_never_predicted_scores_zero(spark):
    df = spark.createDataFrame([(0, 1), (1, 1)], "t int, p int")
    report = {r["class"]: r for r in M.classification_report(df, "t", "p").collect()}
    assert (report["0"]["precision"], report["0"]["recall"], report["0"]["f1"]) == (0, 0, 0)


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("mode,size", [("down", 20), ("over", 300)])
def test_resample_balances_with_replacement(spark, mode, size, hot):
    if hot:
        spark.conf.set("spark.playtrace.groupRows", "50")
    try:
        df = spark.range(400).select("id", F.when(F.col("id") < 300, 0).when(F.col("id") < 380, 1).otherwise(2).alias("y"))
        drawn = L.balanced_resample(df, "y", ["id"], mode, seed=5)
        assert {r["y"]: r["n"] for r in A.value_counts(drawn, "y").collect()} == {0: size, 1: size, 2: size}
        assert drawn.join(df, ["id", "y"], "left_semi").count() == 3 * size
        assert drawn.select("y", "draw").distinct().count() == 3 * size
    finally:
        spark.conf.unset("spark.playtrace.groupRows")


def test_seed_fixes_the_draw_and_folds_cover_everything(spark):
    df = spark.range(500).withColumn("y", F.col("id") % 2)
    a, b, c = [sorted(map(tuple, L.balanced_resample(df, "y", ["id"], seed=s).collect())) for s in (1, 1, 2)]
    assert a == b != c
    folds = {r["fold"]: r["count"] for r in L.kfold(df, 10, 1, ["id"]).groupBy("fold").count().collect()}
    assert sorted(folds) == list(range(10)) and sum(folds.values()) == 500 and min(folds.values()) > 25
