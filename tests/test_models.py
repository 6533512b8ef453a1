"""Learners beat guessing on separable data; combinations are exact."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from playtrace.models import combined as C
from playtrace.models import learners as E
from playtrace.models import selection as P
from playtrace.models.neighbours import NeighbourLearner, nearest, neighbour_votes
from playtrace.operators.metrics import accuracy_of, quadratic_kappa_of
from playtrace.runtime import materialize


@pytest.fixture(scope="module")
def data(spark):
    """Three classes that differ in the first two of four features."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(240):
        y = i % 3
        x = [y * 2 + rng.normal(0, 0.4), -y + rng.normal(0, 0.3), rng.normal(), rng.normal()]
        rows.append((i, [float(v) for v in x], float(y)))
    df = spark.createDataFrame(rows, "id long, v array<double>, label double")
    return materialize(df.select("id", array_to_vector("v").alias("features"), "label"), "test")


def kappa(df):
    return df.agg(quadratic_kappa_of("label", "prediction")).first()[0]


LEARNERS = {
    "forest": lambda: E.forest(5, 4), "bagged": lambda: E.bagged_trees(3, 4), "tree": lambda: E.decision_tree(4),
    "boosted": lambda: E.boosted_trees(3, 2), "logistic": lambda: E.logistic(30),
    "logistic one against rest": lambda: E.logistic(30, one_vs_rest=True), "perceptron": lambda: E.perceptron(4, 3, 8, 60),
    "adaptive": lambda: C.AdaptiveBoosting(3, rounds=6), "ordinal": lambda: C.OrdinalLearner(E.forest(3, 4), 3),
    "neighbours": lambda: NeighbourLearner(3, "id", 5),
    "stacked": lambda: C.StackedLearner([E.decision_tree(3), E.forest(3, 3)], ["id"], folds=2),
}


@pytest.mark.parametrize("name", list(LEARNERS))
def test_learns_separable_classes(data, name):
    judged = LEARNERS[name]().fit(data).predict(data)
    assert judged.count() == 240
    assert set(judged.columns) == {*data.columns, "prediction"}
    assert kappa(judged) > 0.85


def test_voting_and_resampling(data):
    models = [E.decision_tree(3).fit(data), E.forest(3, 3).fit(data), E.logistic(20).fit(data)]
    assert kappa(C.VotingModel(models, 3).predict(data)) > 0.85
    with pytest.raises(ValueError):
        C.VotingModel(models, 3, [1.0, 1.0]).predict(data)
    for compound in (False, True):
        voted = C.resample_and_vote(data, data, E.forest(3, 4), ["id"], rounds=2, compound=compound)
        assert voted.count() == 240 and kappa(voted) > 0.85


def test_vote_ties_take_the_smallest_class(spark):
    df = spark.createDataFrame([(2, 1), (1, 1), (0, 2)], "p int, q int")
    got = [r[0] for r in df.select(C.weighted_vote([F.col("p"), F.col("q")], [1.0, 1.0], 3)).collect()]
    assert got == [1, 1, 0]
    heavy = [r[0] for r in df.select(C.weighted_vote([F.col("p"), F.col("q")], [1.0, 2.0], 3)).collect()]
    assert heavy == [1, 1, 2]
    long = spark.createDataFrame([(1, 2, 1.0), (1, 0, 1.0), (2, 1, 3.0), (2, 0, 1.0)], "k int, c int, w double")
    assert {r["k"]: r["c"] for r in C.hard_vote(long, ["k"], "c", "w").collect()} == {1: 0, 2: 1}


def test_ordinal_scores(spark):
    df = spark.createDataFrame([(0.9, 0.7, 0.2)], "a double, b double, c double")
    scores = df.select(C.ordinal_scores([F.col("a"), F.col("b"), F.col("c")]).alias("s"), ).first()["s"]
    assert np.allclose(scores, [0.1, 0.2, 0.5, 0.2])
    with pytest.raises(ValueError):
        C.OrdinalLearner(E.forest(), 2).fit(df)


def brute(train, queries, k):
    out = {}
    for q in queries:
        d = sorted((float(np.sqrt(((np.array(v) - np.array(q)) ** 2).sum())), i) for i, v in train)
        out[tuple(q)] = [i for _, i in d[:k]]
    return out


@pytest.mark.parametrize("block,pivots", [(4000, 8), (20, 5), (7, None)])
def test_neighbours_are_exact_with_copies_and_small_blocks(spark, block, pivots):
    rng = np.random.default_rng(5)
    points = [[float(x) for x in np.round(rng.normal(size=3), 1)] for _ in range(150)]
    points += [[0.5, 0.5, 0.5]] * 75  # a third of the rows are copies of one
    train = list(enumerate(points))
    df = spark.createDataFrame([(i, v, i % 2) for i, v in train], "id long, v array<double>, label int")
    found = nearest(df, df, 4, block_rows=block, pivots=pivots)
    got = {}
    for r in found.orderBy("distance", "id").collect():
        got.setdefault(tuple(r["v"]), []).append(r["id"])
    assert got == brute(train, points, 4)
    assert neighbour_votes(found).count() == len(got)


def test_neighbours_with_text_ids(spark):
    df = spark.createDataFrame([(f"r{i}", [float(i)], i % 2) for i in range(40)], "id string, v array<double>, label int")
    found = nearest(df, df, 1, block_rows=5, pivots=6)
    assert {r["v"][0]: r["id"] for r in found.collect()} == {float(i): f"r{i}" for i in range(40)}
    with pytest.raises(ValueError):
        nearest(df.filter("label > 5"), df, 1)


def test_neighbours_with_fewer_rows_than_k(spark):
    df = spark.createDataFrame([(1, [0.0], 1), (2, [1.0], 0)], "id long, v array<double>, label int")
    assert nearest(df, df, 5).count() == 4


def test_importances_and_elimination(spark, data):
    names = ["a", "b", "c", "d"]
    table = E.feature_importances(E.forest(5, 4).fit(data), names, spark)
    values = [r["importance"] for r in table.collect()]
    assert values == sorted(values, reverse=True) and abs(sum(values) - 1) < 1e-9
    assert {r["feature"] for r in E.top_features(table, 2).collect()} == {"a", "b"}
    kept = {r["feature"]: r for r in P.eliminate(data, names, 2, E.forest(5, 4)).table(spark).collect()}
    assert {n for n, r in kept.items() if r["support"]} == {"a", "b"}
    assert sorted(r["ranking"] for r in kept.values()) == [1, 1, 2, 3]
    sweep, best = P.elimination_sweep(data, data, names, E.forest(5, 4))
    scores = {r["n_features"]: r["accuracy"] for r in sweep.collect()}
    assert sorted(scores) == [1, 2, 3, 4] and scores[best] == max(scores.values())


def test_tree_count_sweep_ends_at_the_whole_forest(data):
    rows = P.tree_count_sweep(data, data, largest=5, depth=3).collect()
    assert sorted((r["n_trees"], r["split"]) for r in rows) == [(n, s) for n in range(1, 6) for s in ("test", "train")]
    from pyspark.ml.classification import RandomForestClassifier

    whole = RandomForestClassifier(numTrees=5, maxDepth=3, seed=42).fit(data).transform(data)
    last = [r["kappa"] for r in rows if r["n_trees"] == 5]
    assert abs(last[0] - kappa(whole)) < 1e-12


def test_random_search_returns_a_score_per_draw(data):
    grid = {"numTrees": [2, 3], "maxDepth": [2, None], "bootstrap": [True, False]}
    table, best = P.random_search(data, draws=2, folds=2, grid=grid)
    assert table.count() == 2 and len(best.trees) in (2, 3)
    assert best.predict(data).agg(accuracy_of("label", "prediction")).first()[0] > 0.8


def test_small_cells_share_a_block_of_rows(spark):
    from playtrace.models.neighbours import NeighbourIndex

    rng = np.random.default_rng(8)
    points = [[float(x) for x in 1e5 + rng.normal(size=4)] for _ in range(300)]  # far from 0, so products round
    df = spark.createDataFrame([(i, v, i % 2) for i, v in enumerate(points)], "id long, v array<double>, label int")
    index = NeighbourIndex(df, 3)
    assert len(index.centres) > 1 and (index._spans(index.rows_in) == [0, 1]).all()  # a query is copied once, not once a cell
    found = {}
    for r in index.find(df).orderBy("distance", "id").collect():
        found.setdefault(tuple(r["v"]), []).append(r["id"])
    assert found == brute(list(enumerate(points)), points, 3)
