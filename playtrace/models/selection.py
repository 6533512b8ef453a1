"""Choosing features and parameters: elimination, sweeps and random search."""

from __future__ import annotations

import pickle
import random
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import groupby
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playtrace.models.histograms import (
    ROWS_ALONE, Binned, Ensemble, HistogramForest, Rows, ShrinkingForest, Weights, bin_edges, binned, over_one_part, with_bins,
)
from playtrace.models.learners import MAX_DEPTH, Predictor, argmax  # noqa: F401
from playtrace.operators.metrics import accuracy_of, quadratic_kappa_of, quadratic_kappa_of_counts
from playtrace.runtime import materialize, new_path, ship

# The grid of the random search. ``None`` depth means unlimited.
SEARCH_GRID = {
    "numTrees": [200, 400, 600, 800, 1000, 1200, 1400, 1600, 1800, 2000],
    "featureSubsetStrategy": ["auto", "sqrt"],
    "maxDepth": [10, 20, 30, 40, 50, 60, 70, 80, 90, 100, 110, None],
    "minInstancesPerNode": [1, 2, 4],
    "bootstrap": [True, False],
}


def slice_features(df: DataFrame, indices: list[int]) -> DataFrame:
    """Only the given positions of the ``features`` vector."""
    slicer = VectorSlicer(inputCol="_all", outputCol="features", indices=indices)
    return slicer.transform(df.withColumnRenamed("features", "_all")).drop("_all")


@dataclass
class Elimination:
    """Order of elimination: ``order[i]`` is the feature dropped i-th, ``left`` the ones kept."""

    features: list[str]
    order: list[str]
    left: list[str]

    def table(self, spark) -> DataFrame:
        """(feature, support, ranking): kept features rank 1, the last one dropped 2, and so on."""
        rank = {name: 1 for name in self.left}
        rank |= {name: i + 2 for i, name in enumerate(reversed(self.order))}
        rows = [(n, n in set(self.left), rank[n]) for n in self.features]
        return spark.createDataFrame(rows, "feature string, support boolean, ranking int")


def eliminate(train: DataFrame, features: list[str], keep: int, learner, on_subset=None, keys: list[str] | None = None) -> Elimination:
    """Fit, drop the least important feature, repeat until ``keep`` are left.

    ``on_subset(names, indices, model)`` is called for every size fitted, the final one included. A ``HistogramForest`` bins the
    rows once and is grown anew only where a feature that went was in use; its models take the whole vector, those of other learners the
    positions ``indices``. ``keys`` tell its rows apart; without them rows with equal features and label share a sample.
    """
    left, order = list(range(len(features))), []
    shrinking = ShrinkingForest(binned(train, learner.classes, keys), learner) if isinstance(learner, HistogramForest) else None
    while True:
        model = shrinking.fit(left) if shrinking else learner.fit(slice_features(train, left))
        if on_subset:
            on_subset([features[i] for i in left], list(left), model)
        if len(left) <= keep:
            break
        weights = model.importances()[left] if shrinking else model.model.featureImportances.toArray()
        weakest = min(range(len(left)), key=lambda i: (weights[i], i))
        order.append(features[left.pop(weakest)])
    return Elimination(list(features), order, [features[i] for i in left])


def elimination_sweep(train: DataFrame, test: DataFrame, features: list[str], learner, keys: list[str] | None = None) -> tuple[DataFrame, int]:
    """Test accuracy for every number of features, from one elimination pass, and the best number.

    The best is the smallest number with the highest score. Histogram forests of all sizes are judged in one pass.
    """
    scores: dict[int, float] = {}
    forests: dict[int, Ensemble] = {}

    def score(names, indices, model):
        if isinstance(model, Ensemble):
            forests[len(names)] = model
            return
        judged = model.predict(slice_features(test, indices))
        scores[len(names)] = judged.agg(accuracy_of("label", "prediction").alias("a")).first()["a"]

    eliminate(train, features, 1, learner, score, keys)
    if forests:
        scores = _accuracies(test, forests)
    best, high = 0, 0.0
    for n in sorted(scores):
        if scores[n] > high:
            best, high = n, scores[n]
    rows = [(n, float(scores[n])) for n in sorted(scores)]
    return train.sparkSession.createDataFrame(rows, "n_features int, accuracy double"), best


def _accuracies(test: DataFrame, models: dict[int, Ensemble]) -> dict[int, float]:
    """Accuracy of each model, all over the same bins, in one pass over ``test``."""
    sizes, edges = list(models), next(iter(models.values())).edges
    told = test.sparkSession.sparkContext.broadcast(list(models.values()))

    @F.pandas_udf("array<double>")
    def picks(bins: pd.Series) -> pd.Series:
        matrix = np.frombuffer(b"".join(bins), np.uint8).reshape(len(bins), len(edges))
        return pd.Series(list(np.stack([model.scores_of(matrix).argmax(1) for model in told.value], 1).astype(float)))

    long = with_bins(test, edges).select("label", F.posexplode(picks("bins")).alias("place", "prediction"))
    found = long.groupBy("place").agg(accuracy_of("label", "prediction").alias("a")).collect()
    return {sizes[r["place"]]: r["a"] for r in found}


@dataclass
class SavedTree:
    """A fitted tree's nodes as arrays; values up to the threshold, or among the categories, go left."""

    feature: np.ndarray  # -1 at leaves
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    shares: np.ndarray
    categories: dict[int, np.ndarray]

    def shares_of(self, matrix: np.ndarray) -> np.ndarray:
        """Class shares of each row's leaf."""
        node, rows = np.zeros(len(matrix), np.int64), np.arange(len(matrix))
        while len(rows):
            at = node[rows]
            rows, at = rows[self.feature[at] >= 0], at[self.feature[at] >= 0]
            value = matrix[rows, self.feature[at]]
            left = value <= self.threshold[at]
            for n, among in self.categories.items():
                left[at == n] = np.isin(value[at == n], among)
            node[rows] = np.where(left, self.left[at], self.right[at])
        return self.shares[node]


def saved_trees(forest) -> list[SavedTree]:
    """Trees of a fitted forest in their order, read back from what its writer puts into the shared folder."""
    spark = SparkSession.active()
    path = new_path(spark, "forest")
    forest.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*", "nodeData.split.*").drop("split").toPandas()
    trees = []
    for _, own in nodes.sort_values(["treeID", "id"]).groupby("treeID"):
        stats, cuts = np.stack(own["impurityStats"].to_numpy()), own["leftCategoriesOrThreshold"].to_numpy()
        inner = own["leftChild"].to_numpy() >= 0
        continuous = own["numCategories"].to_numpy() < 0
        trees.append(SavedTree(
            np.where(inner, own["featureIndex"].to_numpy(), -1), np.array([c[0] if i and n else np.nan for c, i, n in zip(cuts, inner, continuous)]),
            own["leftChild"].to_numpy(), own["rightChild"].to_numpy(), stats / stats.sum(1, keepdims=True),
            {n: np.array(cuts[n]) for n in np.flatnonzero(inner & ~continuous)}))
    return trees


DRIVER_ROWS = 500_000  # rows times trees of a forest that the driver may hold
JUDGED_ROWS = 4_000  # rows whose class shares are handed on in one piece


def tree_count_sweep(
    train: DataFrame, test: DataFrame, largest: int = 99, depth: int | None = None, seed: int = 42
) -> DataFrame:
    """Kappa on both sets for forests of 1..largest trees, from one fit of the largest.

    A forest of n trees is the first n trees: their summed class shares give its prediction. All are judged in one pass.
    A forest that may be too large for the driver is grown from histograms in tasks instead, and judged where it is grown.
    """
    depth = min(depth or MAX_DEPTH, MAX_DEPTH)
    size = train.count()
    if DRIVER_ROWS < size * largest and size <= ROWS_ALONE:
        return _sweep_in_tasks(train, test, largest, depth, seed)
    forest = RandomForestClassifier(numTrees=largest, maxDepth=depth, seed=seed).fit(train)
    both = train.select("features", "label", F.lit("train").alias("split")).unionByName(
        test.select("features", "label", F.lit("test").alias("split")))
    ship(train.sparkSession)
    told = train.sparkSession.sparkContext.broadcast(saved_trees(forest))

    @F.pandas_udf("array<double>")
    def picks(vectors: pd.Series) -> pd.Series:
        matrix = np.stack(vectors.to_numpy())
        sums, out = 0.0, []
        for tree in told.value:
            sums = sums + tree.shares_of(matrix)
            out.append(sums.argmax(1))
        return pd.Series(list(np.stack(out, 1).astype(float)))

    long = both.select("split", "label", F.posexplode(picks(vector_to_array("features"))).alias("n", "prediction"))
    return long.groupBy((F.col("n") + 1).alias("n_trees"), "split").agg(
        quadratic_kappa_of("label", "prediction").alias("kappa"))


def _sweep_in_tasks(train: DataFrame, test: DataFrame, largest: int, depth: int, seed: int) -> DataFrame:
    """``tree_count_sweep`` whose trees never leave the task that grows them: each hands on the class shares of all rows."""
    keys = [c for c in train.columns if c not in ("features", "label")]
    number = F.xxhash64(*keys) if keys else F.xxhash64("features", "label")
    own = train.select("features", "label", number.alias("_number"), F.lit(0).alias("fold"))
    other = test.filter("label is not null").select("features", "label", F.lit(0).cast("bigint").alias("_number"), F.lit(1).alias("fold"))
    classes = int(train.agg(F.max("label")).first()[0]) + 1
    table = binned(own.unionByName(other), classes, ["_number"], edges=bin_edges(train))
    forest = HistogramForest(classes, 1, depth, "sqrt" if largest > 1 else "all", seed=seed)
    without_test = Weights([1])

    def judge(part: Rows, lot: int) -> Iterator[pa.RecordBatch]:
        tree = replace(forest, first=lot).trees_of(part, without_test, 0, [1.0])[0]
        yield from _in_blocks(tree.leaf_shares()[tree.nodes_of(part.bins)], lot + 1)
        if lot == 0:
            yield from _in_blocks(np.stack([part.label, part.more["fold"]], 1), 0)

    def picks(_, entries: Iterator[tuple]) -> Iterator[tuple]:
        for trees, values in entries:
            if trees == 0:
                label, fold = values.T.astype(np.int64)
                most, sums = max(int(label.max()) + 1, classes), 0.0
                continue
            sums = sums + values
            counts = np.bincount((fold * most + label) * classes + sums.argmax(1))
            for cell in np.flatnonzero(counts):
                yield trees, int(cell // classes // most), int(cell // classes % most), int(cell % classes), int(counts[cell])

    counted = _judged(over_one_part(table, ["bins", "label", "row", "fold"], largest, judge, BLOCK_KIND), picks, ["n_trees", "fold", "label", "prediction", "n"])
    split = F.when(F.col("fold") == 0, "train").otherwise("test").alias("split")
    return counted.groupBy("n_trees", split).agg(quadratic_kappa_of_counts("label", "prediction", "n").alias("kappa"))


BLOCK_KIND = "of bigint, block bigint, trees bigint, held binary"


def _in_blocks(values: np.ndarray, trees: int, of: int = 0) -> Iterator[pa.RecordBatch]:
    """``values`` of a task's rows, packed: those of some rows in each record, as ``_judged`` takes them."""
    for block in range(ceil(len(values) / JUDGED_ROWS)):
        held = zlib.compress(pickle.dumps(values[block * JUDGED_ROWS : (block + 1) * JUDGED_ROWS], 5), 1)
        numbers = [pa.array([n], pa.int64()) for n in (of, block, trees)]
        yield pa.RecordBatch.from_arrays([*numbers, pa.array([held], pa.binary())], ["of", "block", "trees", "held"])


def _judged(blocks: DataFrame, picks, columns: list[str]) -> DataFrame:
    """Rows of ``columns``, whole numbers, that ``picks`` makes of ``of`` and the (trees, values) of each block of rows in order of trees; counts, the last, are added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = ((of, block, trees, held) for batch in batches for of, block, trees, held in zip(*(c.to_pylist() for c in batch.columns)))
        for (of, _), own in groupby(entries, lambda e: e[:2]):
            found = list(picks(of, ((trees, pickle.loads(zlib.decompress(held))) for _, _, trees, held in own)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], columns)

    dealt = materialize(blocks, "shares").repartition("of", "block").sortWithinPartitions("of", "block", "trees")
    found = dealt.mapInArrow(run, ", ".join(f"{c} bigint" for c in columns))
    return found.groupBy(*columns[:-1]).agg(F.sum(columns[-1]).alias(columns[-1]))


TREES_AT_ONCE = 100  # trees of each fold that are grown together
TREES_A_TASK = 50  # of one fold, where a task grows them alone


def _effective(setting: dict) -> tuple[tuple, int, int]:
    """((features a node looks at, smallest leaf, bootstrap), trees, depth): what a drawn setting comes to when it is fitted."""
    width = "sqrt" if setting.get("featureSubsetStrategy", "auto") in ("auto", "sqrt") else setting["featureSubsetStrategy"]
    depth = min(setting.get("maxDepth", 5) or MAX_DEPTH, MAX_DEPTH)
    return (width, setting.get("minInstancesPerNode", 1), setting.get("bootstrap", True)), setting.get("numTrees", 20), depth


def _forest(kind: tuple, classes: int, trees: int, depth: int, seed: int, first: int = 0) -> HistogramForest:
    width, least, bootstrap = kind
    return HistogramForest(classes, trees, depth, width, float(least), bootstrap, seed, first)


def _prefix_kappas(table: Binned, kind: tuple, wanted: list[tuple[int, int]], folds: int, seed: int) -> dict[tuple[int, int], float]:
    """Mean kappa over the folds of each (trees, depth) of one kind of forest, from one fit of the largest.

    A node's features and a tree's sample follow from its seed and place alone, so fewer trees and shallower trees are
    parts of the same fit: their summed class shares are taken on the way. Where a task may hold the table, the one that grows trees
    judges its fold with them, and only sums of shares leave it.
    """
    if table.one_part or table.alone:
        return _kappas_in_place(table, {kind: wanted}, folds, seed)[kind]
    most, deepest = max(t for t, _ in wanted), max(d for _, d in wanted)
    left_out, trees = Weights(list(range(folds))), [[] for _ in range(folds)]
    for first in range(0, most, TREES_AT_ONCE):
        part = _forest(kind, table.classes, min(TREES_AT_ONCE, most - first), deepest, seed, first)
        for fold, model in enumerate(part.fit_weighted(table, left_out, folds)):
            trees[fold] += model.trees
    told = table.rows.sparkSession.sparkContext.broadcast((trees, sorted(wanted)))
    features, classes = len(table.edges), table.classes

    @F.pandas_udf("array<double>")
    def picks(bins: pd.Series, fold: pd.Series) -> pd.Series:
        trees, wanted = told.value
        matrix = np.frombuffer(b"".join(bins), np.uint8).reshape(len(bins), features)
        out = np.zeros((len(bins), len(wanted)))
        for number in range(folds):
            mine = np.flatnonzero(fold.to_numpy() == number)
            for depth in sorted({d for _, d in wanted}):
                sums = np.zeros((len(mine), classes))
                for i, tree in enumerate(trees[number]):
                    sums += tree.leaf_shares()[tree.nodes_of(matrix[mine], depth)]
                    for place, setting in enumerate(wanted):
                        if setting == (i + 1, depth):
                            out[mine, place] = sums.argmax(1)
        return pd.Series(list(out))

    long = table.rows.select("fold", "label", F.posexplode(picks("bins", "fold")).alias("place", "prediction"))
    return _mean_kappas(long, sorted(wanted))


def _kappas_in_place(table: Binned, kinds: dict[tuple, list[tuple[int, int]]], folds: int, seed: int) -> dict[tuple, dict[tuple[int, int], float]]:
    """``_prefix_kappas`` of several kinds in one job. Kinds that differ in their smallest leaf alone are grown together."""
    classes, groups, lots = table.classes, {}, []
    for width, least, bootstrap in sorted(kinds, key=str):
        groups.setdefault((width, bootstrap), []).append((width, least, bootstrap))
    for group, own in enumerate(groups.values()):
        counts = sorted({t for kind in own for t, _ in kinds[kind]})
        for start, end in zip([0, *counts], counts):  # no lot goes beyond a wanted number of trees
            lots += [(group, fold, first, min(first + TREES_A_TASK, end)) for first in range(start, end, TREES_A_TASK) for fold in range(folds)]
    lots.sort(key=lambda lot: (lot[2], lot[0]))
    groups, left_out = list(groups.values()), Weights(list(range(folds)))
    depths = {kind: sorted({d for _, d in wanted}) for kind, wanted in kinds.items()}
    most = {kind: max(t for t, _ in wanted) for kind, wanted in kinds.items()}
    places = {(kind, t, d): i for i, (kind, t, d) in enumerate((kind, t, d) for kind, wanted in kinds.items() for t, d in sorted(set(wanted)))}

    def judge(part: Rows, lot: int) -> Iterator[pa.RecordBatch]:
        group, fold, first, end = lots[lot]
        mine, grown = np.flatnonzero(part.more["fold"] == fold), [kind for kind in groups[group] if most[kind] > first]
        own, sums = part.bins[mine], [np.zeros((len(depths[kind]), len(mine), classes)) for kind in grown]
        one = _forest(grown[0], classes, 1, max(depths[kind][-1] for kind in grown), seed)
        for i in range(first, end):
            for tree, kind, held in zip(replace(one, first=i).trees_of(part, left_out, fold, [float(kind[1]) for kind in grown]), grown, sums):
                shares = tree.leaf_shares()
                for place, nodes in enumerate(tree.nodes_at(own, depths[kind])):
                    held[place] += shares[nodes]
        yield from _in_blocks(np.concatenate(sums).transpose(1, 0, 2), end, group * folds + fold)
        if first == 0:
            yield from _in_blocks(part.label[mine], 0, group * folds + fold)

    def picks(of: int, entries: Iterator[tuple]) -> Iterator[tuple]:
        group, fold = of // folds, of % folds
        last = 0
        for trees, values in entries:
            if trees == 0:
                label, upto = values, {}
                continue
            begin = 0
            for kind in (kind for kind in groups[group] if most[kind] > last):
                own = values[:, begin : begin + len(depths[kind])]
                begin += len(depths[kind])
                upto[kind] = upto[kind] + own if kind in upto else own
                for place, depth in enumerate(depths[kind]):
                    if (kind, trees, depth) in places:
                        counts = np.bincount(label * classes + upto[kind][:, place].argmax(1))
                        for cell in np.flatnonzero(counts):
                            yield places[kind, trees, depth], fold, int(cell // classes), int(cell % classes), int(counts[cell])
            last = trees

    counted = _judged(over_one_part(table, ["bins", "label", "row", "fold"], len(lots), judge, BLOCK_KIND), picks, ["place", "fold", "label", "prediction", "n"])
    found = _mean_over_folds(counted.groupBy("place", "fold").agg(quadratic_kappa_of_counts("label", "prediction", "n").alias("k")))
    return {kind: {(t, d): found[places[kind, t, d]] for t, d in wanted} for kind, wanted in kinds.items()}


def _mean_kappas(long: DataFrame, wanted: list[tuple[int, int]]) -> dict[tuple[int, int], float]:
    found = _mean_over_folds(long.groupBy("place", "fold").agg(quadratic_kappa_of("label", "prediction").alias("k")))
    return {wanted[place]: k for place, k in found.items()}


def _mean_over_folds(kappas: DataFrame) -> dict[int, float]:
    return {r["place"]: r["k"] for r in kappas.groupBy("place").agg(F.avg(F.coalesce("k", F.lit(float("-inf")))).alias("k")).collect()}


def random_search(
    train: DataFrame, draws: int = 100, folds: int = 3, seed: int = 42, grid: dict | None = None, keys: list[str] | None = None
) -> tuple[DataFrame, Predictor]:
    """Cross-validated kappa of every drawn random forest setting, and the model refitted with the first best.

    Settings that differ only in the number of trees or in depth are parts of one fit (``_prefix_kappas``); equal ones are
    judged once. ``keys`` tell rows apart; without them rows with equal features and label share fold and sample.
    """
    grid = grid or SEARCH_GRID
    pick = random.Random(seed)
    drawn = [{name: pick.choice(values) for name, values in grid.items()} for _ in range(draws)]
    apart = keys or ["features", "label"]
    folded = train.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), *apart), F.lit(folds)).cast("int"))
    classes = int(train.agg(F.max("label")).first()[0]) + 1
    table = binned(folded, classes, keys)
    kinds: dict[tuple, set] = {}
    for kind, trees, depth in map(_effective, drawn):
        kinds.setdefault(kind, set()).add((trees, depth))
    kinds = {kind: sorted(wanted) for kind, wanted in kinds.items()}
    if table.alone:
        kappas = _kappas_in_place(table, kinds, folds, seed)
    else:
        kappas = {kind: _prefix_kappas(table, kind, wanted, folds, seed) for kind, wanted in kinds.items()}
    score = lambda s: kappas[_effective(s)[0]][_effective(s)[1:]]
    rows = [(i, str(sorted(s.items(), key=str)), float(score(s))) for i, s in enumerate(drawn)]
    kind, trees, depth = _effective(max(drawn, key=score))
    forest = _forest(kind, classes, trees, depth, seed)
    best = forest.fit_stored(table) if table.alone else forest.fit_weighted(table, Weights([-1]), 1)[0]
    return train.sparkSession.createDataFrame(rows, "draw int, setting string, kappa double"), best
