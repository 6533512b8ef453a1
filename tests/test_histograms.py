"""Trees from weighted histograms: exact cuts, folds fitted together, resamples as weights."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from playtrace.models import combined as C
from playtrace.models import histograms as H
from playtrace.models import selection as P
from playtrace.models.neighbours import NeighbourLearner
from playtrace.operators import aggregates as A
from playtrace.operators import metrics as M
from playtrace.operators import sampling as L
from playtrace.runtime import materialize


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.integers(0, 6, 3)], i % 4) for i in range(200)]
    rows = [(i, x, float((x[0] > 2) + (x[1] > 3)) if i % 7 else 0.0, f) for i, x, f in rows]
    df = spark.createDataFrame(rows, "id long, v array<double>, label double, fold int")
    return materialize(df.withColumn("features", array_to_vector("v")), "test")


def best_stump(x, y, w, classes):
    """All cuts of all features by hand: (gain, feature, value) with the first of equals."""
    best = (-1.0, 0, 0.0)
    whole = np.array([w[y == c].sum() for c in range(classes)])
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for a, b in zip(values, values[1:]):
            left = np.array([w[(y == c) & (x[:, f] <= a)].sum() for c in range(classes)])
            right = whole - left
            gain = (left**2).sum() / left.sum() + (right**2).sum() / right.sum() - (whole**2).sum() / whole.sum()
            if gain > best[0] + 1e-9:
                best = (gain, f, (a + b) / 2)
    return best


def test_boosting_rounds_equal_brute_force(data):
    rows = data.orderBy("id").collect()
    x, y = np.array([r["v"] for r in rows]), np.array([int(r["label"]) for r in rows])
    model, w = C.AdaptiveBoosting(3, rounds=3).fit(data), np.ones(len(y))
    assert len(model.trees) == 3
    for stump, amount in zip(model.trees, model.weights):
        gain, feature, value = best_stump(x, y, w, 3)
        assert stump.feature[0] == feature and model.edges[feature][stump.cut[0]] == pytest.approx(value)
        side = x[:, feature] > value
        picks = [np.bincount(y[side == s], w[side == s], 3).argmax() for s in (False, True)]
        missed = np.where(side, picks[1], picks[0]) != y
        error = w[missed].sum() / w.sum()
        assert amount == pytest.approx(np.log((1 - error) / error) + np.log(2))
        w = w * np.exp(amount * missed)


def test_folds_together_equal_folds_apart(data):
    table = H.binned(data.select("id", "features", "label", "fold"), 3, ["id"])
    for learner in (H.HistogramTree(3, 3), H.AdaptiveBoosting(3, 4), H.HistogramForest(3, 2, 3)):
        together = learner.fit_folds(table, 4)
        assert len(together) == 5
        for fold in range(4):
            part = H.Binned(table.rows.filter(F.col("fold") != fold), table.edges, 3)
            if isinstance(learner, H.HistogramForest):
                seeds = [learner.seed * 100_003 + fold * 10_007 + i for i in range(2)]
                alone = H.grown(part, H.Bootstrap(H.Weights([-1]), [0, 0], seeds), 2, 3, 2, seeds)
            else:
                alone = learner.fit_folds(part, 0)[-1].trees
            assert [(t.feature, t.cut) for t in alone] == [(t.feature, t.cut) for t in together[fold].trees]


def test_a_deeper_and_larger_forest_repeats_the_smaller(data):
    table = H.binned(data.select("id", "features", "label"), 3, ["id"])
    small, large = (H.HistogramForest(3, n, d).fit_folds(table, 0)[-1] for n, d in ((2, 2), (4, 4)))
    bins = np.array([[0, 1, 2], [5, 5, 5], [3, 0, 4]], np.uint8)
    for few, many in zip(small.trees, large.trees):
        assert np.allclose(few.leaf_shares()[few.nodes_of(bins)], many.leaf_shares()[many.nodes_of(bins, 2)])


def test_one_neighbour_index_serves_all_folds(data):
    rows = data.select("id", "features", "label", "fold")
    together = NeighbourLearner(3, "id", 3).fit(rows, "fold").scores(rows, "s")
    found = {r["id"]: r["s"] for r in together.collect()}
    for fold in range(4):
        apart = NeighbourLearner(3, "id", 3).fit(rows.filter(F.col("fold") != fold)).scores(rows.filter(F.col("fold") == fold), "s")
        for r in apart.collect():
            assert found[r["id"]] == pytest.approx(r["s"])


def test_draw_counts_are_the_draws(data):
    index = L.ClassIndex(data.select("id", "label"), "label", ["id"])
    for mode in ("down", "over"):
        counts = {r["id"]: r["draws"] for r in index.draw_counts(mode, [5, 6]).collect()}
        assert len(counts) == 200
        for i, seed in enumerate((5, 6)):
            drawn = {r["id"]: r["count"] for r in index.draw(mode, seed).groupBy("id").count().collect()}
            assert drawn == {k: v[i] for k, v in counts.items() if v[i]}


def test_many_classes_and_many_ratings(spark):
    rows = spark.range(60_000).select("id", (F.col("id") % 20_000).alias("y"))
    assert L.ClassIndex(materialize(rows, "many"), "y", ["id"]).draw("down", 3).groupBy("y").count().agg(F.min("count"), F.max("count"), F.count("*")).first() == (3, 3, 20_000)
    pairs = spark.range(50_000).select((F.col("id") % 2000).cast("int").alias("a"), ((F.col("id") * 7) % 1999).cast("int").alias("b"))
    by_grid = M.quadratic_weighted_kappa_from_grid(pairs, "a", "b").first()[0]
    assert by_grid == pytest.approx(M.quadratic_weighted_kappa(pairs, "a", "b").first()[0], abs=1e-9)
    local = pairs.toPandas()
    chance = sum((local.a == r).mean() * (local.b == r).mean() for r in range(2000))
    agree = (local.a == local.b).mean()
    assert M.cohen_kappa(pairs, "a", "b").first()[0] == pytest.approx(1 - (1 - agree) / (1 - chance))
    assert A.rating_histogram(spark.createDataFrame([(0,), (3_000_000,)], "r int"), "r").count() == 3_000_001


def test_stack_hands_out_the_scores_of_its_bases(data):
    rows = data.select("id", "features", "label")
    learner = C.StackedLearner([H.HistogramTree(3, 3), NeighbourLearner(3, "id", 3), H.AdaptiveBoosting(3, 3)], ["id"], folds=3)
    model = learner.fit(rows)
    judged = model.predict(model.base_scores(rows, ["tree", "near", "boost"]))
    first = judged.first()
    assert all(sum(first[n]) == pytest.approx(1.0) for n in ("tree", "near", "boost")) and judged.count() == 200


def test_search_reads_smaller_settings_off_the_largest_fit(data):
    grid = {"numTrees": [2, 3, 5], "maxDepth": [2, 3, None], "minInstancesPerNode": [1, 4], "bootstrap": [True, False]}
    table, best = P.random_search(data.select("id", "features", "label"), draws=8, folds=2, seed=4, grid=grid, keys=["id"])
    found = {r["draw"]: (r["setting"], r["kappa"]) for r in table.collect()}
    assert len(found) == 8 and best.classes == 3
    rows = data.select("id", "features", "label").withColumn("fold", F.pmod(F.xxhash64(F.lit(4), "id"), F.lit(2)).cast("int"))
    binned = H.binned(rows, 3, ["id"])
    for draw in (0, 5):
        setting = dict(eval(found[draw][0]))
        kind, trees, depth = P._effective(setting)
        models = P._forest(kind, 3, trees, depth, 4).fit_weighted(binned, H.Weights([0, 1]), 2)
        judged = H.with_scores(binned.rows, {"s": models}).withColumn("prediction", P.argmax(F.col("s")))
        single = judged.groupBy("fold").agg(M.quadratic_kappa_of("label", "prediction").alias("k")).agg(F.avg("k")).first()[0]
        assert found[draw][1] == pytest.approx(single)


def test_one_task_grows_what_all_levels_together_grow(data):
    table = H.binned(data.select("id", "features", "label", "fold"), 3, ["id"])
    assert table.one_part
    spread = H.Binned(table.rows.repartition(3), table.edges, 3)  # several parts: a job for each level
    bins = np.array([[a, b, c] for a in range(6) for b in range(6) for c in range(6)], np.uint8)
    for learner in (H.HistogramTree(3, 6), H.HistogramForest(3, 3, 6, least=2.0), H.HistogramForest(3, 2, 4, "all", bootstrap=False)):
        for one, many in zip(learner.fit_folds(table, 4), learner.fit_folds(spread, 4)):
            for here, there in zip(one.trees, many.trees):
                assert len(here.feature) == len(there.feature)
                assert np.array_equal(here.leaf_shares()[here.nodes_of(bins)], there.leaf_shares()[there.nodes_of(bins)])


def test_search_judges_where_it_grows(data, monkeypatch):
    rows = data.select("id", "features", "label").withColumn("fold", (F.col("id") % 2).cast("int"))
    table = H.binned(rows, 3, ["id"])
    wanted = [(2, 2), (3, 4), (5, 2), (5, 4)]
    spread = H.Binned(table.rows, table.edges, 3)
    together = P._prefix_kappas(spread, ("sqrt", 1, True), wanted, 2, 7)
    monkeypatch.setattr(H.HistogramForest, "fit_weighted", None)  # no tree comes back to the driver
    monkeypatch.setattr(P, "TREES_A_TASK", 2)
    assert P._prefix_kappas(table, ("sqrt", 1, True), wanted, 2, 7) == pytest.approx(together)


def test_draws_are_dealt_over_tasks(data):
    index = L.ClassIndex(data.select("id", "label"), "label", ["id"])
    drawn = index._drawn_numbers("over", list(range(20)))
    assert drawn.select(F.spark_partition_id().alias("task")).distinct().count() > 1


def test_draws_do_not_go_through_the_driver(data):
    index = L.ClassIndex(data.select("id", "label"), "label", ["id"])
    for drawn in (index.draw("over", 3), index.draw_counts("over", [3, 4])):
        plan = drawn._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_shrinking_forests_read_rows_only_for_new_nodes_and_equal_forests_grown_anew(spark):
    rng = np.random.default_rng(11)
    matrix = rng.integers(0, 6, (600, 8)).astype(float)
    label = ((matrix[:, 0] > 2).astype(int) + (matrix[:, 1] > 3)).astype(float)
    rows = [(i, v.tolist(), y) for i, (v, y) in enumerate(zip(matrix, label.tolist()))]
    df = spark.createDataFrame(rows, "k bigint, v array<double>, label double")
    table = H.binned(df.withColumn("features", array_to_vector("v")), 3, ["k"])
    forest = H.HistogramForest(3, 3, 3)
    same = lambda a, b: all(x.feature == list(y.feature) and x.cut == list(y.cut) for x, y in zip(a.trees, b.trees))
    shrinking = H.ShrinkingForest(table, forest)
    left = list(range(8))
    assert same(shrinking.fit(left), forest.fit_weighted(table, H.Weights([-1]), 1)[0])
    fits = 1
    while len(left) > 1:
        weights = shrinking.fit(left).importances()
        left.remove(min(left, key=lambda f: (weights[f], f)))
        model, fits = shrinking.fit(left), fits + 1
        assert same(model, H.ShrinkingForest(table, forest).fit(left))
        assert {f for t in model.trees for f in t.feature} <= {-1, *left}
    assert shrinking.passes < 2 * fits  # three levels each, were all grown anew


def test_elimination_of_a_histogram_forest(spark, data):
    names = ["a", "b", "c"]
    learner = H.HistogramForest(3, 5, 4)
    kept = {r["feature"]: r["ranking"] for r in P.eliminate(data, names, 2, learner, keys=["id"]).table(spark).collect()}
    assert kept == {"a": 1, "b": 1, "c": 2}
    sweep, best = P.elimination_sweep(data, data, names, learner, ["id"])
    scores = {r["n_features"]: r["accuracy"] for r in sweep.collect()}
    whole = learner.fit_weighted(H.binned(data, 3, ["id"]), H.Weights([-1]), 1)[0].predict(data)
    assert sorted(scores) == [1, 2, 3] and scores[best] == max(scores.values())
    assert abs(scores[3] - whole.agg(M.accuracy_of("label", "prediction")).first()[0]) < 1e-12


def test_tree_count_sweep_in_tasks_counts_what_the_whole_forests_predict(data, monkeypatch):
    from pyspark.ml.classification import RandomForestClassifier

    rows = data.select("id", "features", "label")
    train, test = rows.filter("id % 3 > 0"), rows.filter("id % 3 = 0")
    monkeypatch.setattr(P, "DRIVER_ROWS", 100)
    monkeypatch.setattr(P, "JUDGED_ROWS", 30)
    monkeypatch.setattr(P, "saved_trees", None)  # no forest comes to the driver
    monkeypatch.setattr(RandomForestClassifier, "fit", None)
    found = {(r["n_trees"], r["split"]): r["kappa"] for r in P.tree_count_sweep(train, test, largest=4, depth=5).collect()}
    assert set(found) == {(n, s) for n in range(1, 5) for s in ("train", "test")}
    keyed = train.select("features", "label", F.xxhash64("id").alias("k"))
    for n in (1, 3, 4):
        whole = H.HistogramForest(3, n, 5).fit_weighted(H.binned(keyed, 3, ["k"]), H.Weights([-1]), 1)[0]
        for split, part in (("train", train), ("test", test)):
            assert found[n, split] == pytest.approx(whole.predict(part).agg(M.quadratic_kappa_of("label", "prediction")).first()[0])


def test_trees_of_several_smallest_leaves_are_those_grown_apart(data, monkeypatch):
    table = H.binned(data.select("id", "features", "label", "fold"), 3, ["id"])
    part = next(H._parts(iter(table.rows.toArrow().combine_chunks().to_batches()), 3))
    monkeypatch.setattr(H, "ROWS_AT_ONCE", 16)
    monkeypatch.setattr(H, "CELLS_AT_ONCE", 40)
    forest = H.HistogramForest(3, 1, 8)
    together = forest.trees_of(part, H.Weights([-1]), 0, [1.0, 2.0, 4.0])
    spread = H.Binned(table.rows.repartition(3), table.edges, 3)
    for least, tree in zip((1.0, 2.0, 4.0), together):
        apart = replace(forest, least=least).fit_weighted(spread, H.Weights([-1]), 1)[0].trees[0]
        assert len(tree.feature) == len(apart.feature)
        assert np.array_equal(tree.leaf_shares()[tree.nodes_of(part.bins)], apart.leaf_shares()[apart.nodes_of(part.bins)])
        assert [n.tolist() for n in tree.nodes_at(part.bins, [2, 8])] == [tree.nodes_of(part.bins, d).tolist() for d in (2, 8)]


def test_all_passes_of_all_fits_read_rows_that_are_packed_once(data, monkeypatch):
    packed, calls = H._packed_rows, []
    monkeypatch.setattr(H, "_packed_rows", lambda *given: calls.append(given) or packed(*given))
    table = H.binned(data.select("id", "features", "label", "fold"), 3, ["id"])
    spread = H.Binned(table.rows, table.edges, 3)  # a job for each level
    for learner in (H.HistogramTree(3, 2), H.AdaptiveBoosting(3, 3)):
        learner.fit_folds(spread, 4)
    assert len(calls) == 1
