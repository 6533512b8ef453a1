"""Trees grown from weighted histograms, many models in one pass over the rows.

Values are binned once: a feature with few values keeps them all, another is cut at quantiles. A row is then its bins, its
label and whatever weighs it. A level of every tree of every model is one aggregate: tasks sum the weights by (node, feature,
bin, class), Spark adds the sums, and the best cut of a node is found by running sums over its bins. The driver gets one row
per open node. Rows are never written again: which node a row is in, and what boosting has made of its weight, follows from the
trees that the tasks are given. A task holds the rows of its part and sums over all of them before it hands anything on. A table
of one part needs no sums of others: each task then grows some of the trees to their end over that part (``_alone``).

So folds, bootstrap samples and resamples are no data sets of their own: each is a weight, computed from the row or read from it.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, reduce
from math import ceil, log, sqrt
from threading import Lock

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playtrace.models.learners import Predictor
from playtrace.runtime import materialize, ship

MAX_BINS = 32
ROWS_PER_TASK = 50_000
ROWS_ALONE = 1_500_000  # whose bins a task may hold besides what growing a tree takes
TASKS_AT_ONCE = 32  # few parts of rows are read for several lots of models
DENSE_CELLS = 1 << 20  # beyond it, and beyond eight for each value, cells are found by sorting
ROWS_AT_ONCE, CELLS_AT_ONCE = 1 << 16, 1 << 19  # of nodes that are looked at together
LEAST_GAIN = 1e-9

# --- bins ---


def bin_edges(train: DataFrame, max_bins: int = MAX_BINS) -> list[np.ndarray]:
    """Cut points of each position of ``features``: between all values if there are at most ``max_bins``, else at quantiles."""
    values = train.select(F.posexplode(vector_to_array("features")).alias("feature", "value"))
    order = Window.partitionBy("feature").orderBy("value")
    few = values.distinct().withColumn("n", F.row_number().over(order)).filter(F.col("n") <= max_bins + 1)
    few = few.groupBy("feature").agg(F.sort_array(F.collect_list("value")).alias("values"))
    shares = [i / max_bins for i in range(1, max_bins)]
    cuts = values.groupBy("feature").agg(F.percentile_approx("value", shares, 10_000).alias("cuts"))
    edges: dict[int, np.ndarray] = {}
    for row in few.join(cuts, "feature").collect():
        known = np.array(row["values"])
        edges[row["feature"]] = (known[1:] + known[:-1]) / 2 if len(known) <= max_bins else np.unique(row["cuts"])
    return [edges[f] for f in sorted(edges)]


def with_bins(df: DataFrame, edges: list[np.ndarray]) -> DataFrame:
    """Adds ``bins``: one byte for each feature, the number of its cut points below the value."""
    if max(map(len, edges), default=0) > 255:
        raise ValueError("more than 256 bins")
    ship(df.sparkSession)

    @F.pandas_udf("binary")
    def place(vectors):
        import pandas as pd

        matrix = np.stack(vectors.to_numpy()) if len(vectors) else np.empty((0, len(edges)))
        found = np.empty(matrix.shape, np.uint8)
        for f, cuts in enumerate(edges):
            found[:, f] = np.searchsorted(cuts, matrix[:, f], "left")
        return pd.Series([row.tobytes() for row in found])

    return df.withColumn("bins", place(vector_to_array("features")))


@dataclass
class Rows:
    """One batch of rows in a task."""

    bins: np.ndarray
    label: np.ndarray
    row: np.ndarray
    more: dict[str, np.ndarray]

    @cached_property
    def columns(self) -> np.ndarray:
        """Bins feature by feature: one that is read over and over lies in one piece."""
        return np.ascontiguousarray(self.bins.T)


def _batch_rows(batch: pa.RecordBatch, features: int) -> Rows:
    column = batch.column("bins")
    data = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(batch), features)
    plain = lambda name: batch.column(name).to_numpy(zero_copy_only=False)
    more = {n: plain(n) for n in batch.schema.names if n not in ("bins", "label", "row")}
    more = {n: np.stack(v) if v.dtype == object and len(v) and np.ndim(v[0]) else v for n, v in more.items()}
    return Rows(data, plain("label").astype(np.int64), plain("row") if "row" in batch.schema.names else np.arange(len(batch)), more)


def _joined(held: list[Rows]) -> Rows:
    more = {n: np.concatenate([r.more[n] for r in held]) for n in held[0].more}
    return Rows(*[np.concatenate([getattr(r, n) for r in held]) for n in ("bins", "label", "row")], more)


def _parts(batches: Iterator[pa.RecordBatch], features: int) -> Iterator[Rows]:
    """The rows of a task, a few times ``ROWS_PER_TASK`` at most in one piece."""
    held: list[Rows] = []
    for batch in batches:
        if len(batch):
            held.append(_batch_rows(batch, features))
        if sum(len(r.label) for r in held) >= 4 * ROWS_PER_TASK:
            yield _joined(held)
            held = []
    if held:
        yield _joined(held)


# --- trees ---


@dataclass
class Tree:
    """Nodes by number: rows with bin <= cut go to ``child``, others to the next; ``feature`` is -1 at leaves."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    child: list[int] = field(default_factory=lambda: [0])
    path: list[int] = field(default_factory=lambda: [1])  # a node's place: its parent's twice, plus one on the right
    sums: list[np.ndarray] = field(default_factory=lambda: [None])  # weight of each class
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int, left: np.ndarray, right: np.ndarray, gain: float) -> tuple[int, int]:
        self.feature[node], self.cut[node], self.child[node], self.gain[node] = feature, cut, len(self.feature), gain
        for side, sums in enumerate((left, right)):
            self.feature.append(-1)
            self.cut.append(0)
            self.child.append(0)
            self.path.append(2 * self.path[node] + side)
            self.sums.append(sums)
            self.gain.append(0.0)
        return len(self.feature) - 2, len(self.feature) - 1

    def nodes_of(self, bins: np.ndarray, depth: int | None = None) -> np.ndarray:
        feature, cut, child = np.array(self.feature), np.array(self.cut), np.array(self.child)
        node, every = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(len(feature) if depth is None else depth):
            f = feature[node]
            inner = f >= 0
            if not inner.any():
                break
            node = np.where(inner, child[node] + (bins[every, np.maximum(f, 0)] > cut[node]), node)
        return node

    def nodes_at(self, bins: np.ndarray, depths: list[int]) -> list[np.ndarray]:
        """``nodes_of`` for each of the ascending ``depths``, on one way down."""
        feature, cut, child = np.array(self.feature), np.array(self.cut), np.array(self.child)
        flat, features, out = np.ascontiguousarray(bins).reshape(-1), bins.shape[1], []
        node, rows, done = np.zeros(len(bins), np.int64), np.arange(len(bins)), 0
        for depth in depths:
            for _ in range(done, depth):
                own = node[rows]
                inner = feature[own] >= 0
                rows, own = rows[inner], own[inner]
                if not len(rows):
                    break
                node[rows] = child[own] + (flat.take(rows * features + feature[own]) > cut[own])
            out.append(node.copy())
            done = depth
        return out

    def leaf_shares(self) -> np.ndarray:
        """Class shares of every node, by node number."""
        sums = np.asarray(self.sums)
        return sums / np.maximum(sums.sum(1, keepdims=True), 1e-300)


class Weights:
    """Weight of each row in model ``m``. This one: 1 in all rows but those of the fold the model leaves out."""

    def __init__(self, left_out: list[int]):
        self.left_out = left_out

    def of(self, rows: Rows, m: int) -> np.ndarray:
        if self.left_out[m] < 0:
            return np.ones(len(rows.label))
        return (rows.more["fold"] != self.left_out[m]).astype(float)


def uniform(row: np.ndarray, seed: int) -> np.ndarray:
    """A number in [0, 1) for each row number, the same in every task."""
    h = row.astype(np.int64).view(np.uint64) ^ np.uint64((seed * 0x9E3779B97F4A7C15) & (1 << 64) - 1)
    for shift, odd in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(odd)
    return ((h ^ (h >> np.uint64(33))) >> np.uint64(11)).astype(float) / float(1 << 53)


class Bootstrap(Weights):
    """How often each row is drawn: Poisson of mean 1, the large-sample law of drawing with replacement, times ``base``."""

    def __init__(self, base: Weights, owner: list[int], seeds: list[int]):
        self.base, self.owner, self.seeds = base, owner, seeds
        mass = np.cumsum(np.exp(-1) / np.cumprod(np.r_[1.0, np.arange(1, 18)]))
        self.mass = mass

    def of(self, rows: Rows, m: int) -> np.ndarray:
        base = self.base.of(rows, self.owner[m])
        if self.seeds[m] < 0:
            return base
        return base * np.searchsorted(self.mass, uniform(rows.row, self.seeds[m]), "right")


class Column(Weights):
    """Weights that rows carry: position ``m`` of an array column."""

    def __init__(self, name: str):
        self.name = name

    def of(self, rows: Rows, m: int) -> np.ndarray:
        return rows.more[self.name][:, m].astype(float)


def chosen_features(features: int, subset: int, seed: int, path: int) -> np.ndarray:
    """``subset`` features for one node, from the seed and the node's place alone: a deeper fit repeats a shallower one."""
    return chosen_among(np.arange(features), features, subset, seed, path)


def chosen_among(left: np.ndarray, features: int, subset: int, seed: int, path: int) -> np.ndarray:
    """``chosen_features`` where only some are ``left``: a node keeps those it chose before and fills up with the next ones."""
    if subset >= len(left):
        return left
    draw = uniform(np.arange(features) + np.int64((path * 1_000_003) % (1 << 61)), seed)
    return np.sort(left[np.argsort(draw[left], kind="stable")[:subset]])


def chosen_of_all(features: int, subset: int, seed: int, paths: np.ndarray) -> np.ndarray:
    """``chosen_features`` of several nodes, a row for each; places beyond 40 levels are Python's whole numbers."""
    if subset >= features:
        return np.tile(np.arange(features), (len(paths), 1))
    places = (paths * 1_000_003 % (1 << 61)).astype(np.int64)
    draw = uniform(np.arange(features)[None, :] + places[:, None], seed)
    return np.sort(np.argpartition(draw, subset - 1, axis=1)[:, :subset], axis=1)


@dataclass
class OpenNode:
    model: int
    node: int
    features: np.ndarray


def _cells(columns: np.ndarray, top: int, use: np.ndarray, label: np.ndarray, weight: np.ndarray, at: np.ndarray, asked: np.ndarray, classes: int) -> tuple:
    """(node, place in ``asked``, bin, weight of each class) of all cells that the rows ``use`` of ``columns`` fall in, sorted; row ``use[i]`` is in node ``at[i]``."""
    nodes, width = asked.shape
    size = nodes * width * top * classes
    if size <= max(DENSE_CELLS, 8 * len(use) * width):
        total, begin = np.empty((nodes, width, top, classes)), at * (top * classes) + label
        for place in range(width):
            feature = asked[:, place]
            bins = columns[feature[0]].take(use) if (feature == feature[0]).all() else columns[feature.take(at), use]
            cell = begin + bins.astype(np.uint16) * np.uint16(classes) if classes <= 256 else begin + bins.astype(np.int64) * classes
            total[:, place] = np.bincount(cell, weight, nodes * top * classes).reshape(nodes, top, classes)
        total = total.reshape(-1, classes)
        filled = np.flatnonzero(total.any(1))
        total = total[filled]
    else:
        taken = columns[asked[at], use[:, None]]
        cell = (((at[:, None] * width + np.arange(width)) * top + taken) * classes + label[:, None]).ravel()
        filled, found = np.unique(cell // classes, return_inverse=True)
        total = np.bincount(found * classes + cell % classes, np.repeat(weight, width), len(filled) * classes).reshape(-1, classes)
    return filled // (width * top), filled // top % width, filled % top, total


def _cuts(flat: np.ndarray, base: np.ndarray, label: np.ndarray, weight: np.ndarray | None, at: np.ndarray, asked: np.ndarray, tops: np.ndarray, classes: int, leasts: list[float]) -> list[tuple]:
    """For each of ``leasts`` (node, gain, place, cut, left sums, all sums) of the best cut of each node that has one.

    Row i is in node ``at[i]``, its bins begin at ``base[i]`` of ``flat`` and are below ``tops``; weights are whole numbers, 1 without any.
    """
    width = asked.shape[1]
    bins = tops[asked].ravel()
    ends = np.cumsum(bins)
    start, size = ends - bins, int(ends[-1])
    total, begin = np.zeros((classes, size)), start.reshape(asked.shape)
    for i in range(0, len(base), ROWS_AT_ONCE):
        own = at[i : i + ROWS_AT_ONCE]
        taken, cell = asked.take(own, axis=0), begin.take(own, axis=0)
        taken += base[i : i + ROWS_AT_ONCE, None]
        cell += flat.take(taken)
        cell += (label[i : i + ROWS_AT_ONCE] * size)[:, None]
        amounts = None if weight is None else np.repeat(weight[i : i + ROWS_AT_ONCE], width)
        total += np.bincount(cell.ravel(), amounts, classes * size).reshape(classes, size)
    filled = np.flatnonzero(total.sum(0))
    run, total = np.repeat(np.arange(len(bins)), bins)[filled], total[:, filled]
    first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    cells = np.diff(np.r_[first, len(run)])  # of each node and feature
    left = total.cumsum(1)
    before = left[:, first] - total[:, first]
    whole = left[:, first + cells - 1] - before
    left -= np.repeat(before, cells, axis=1)
    right = np.repeat(whole, cells, axis=1) - left
    on_left, on_right = left.sum(0), right.sum(0)
    squares = lambda w: np.einsum("cm,cm->m", w, w)
    gain = squares(left) / on_left + squares(right) / np.where(on_right > 0, on_right, 1.0) - np.repeat(squares(whole) / whole.sum(0), cells)
    node = run // width
    fresh = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    own_cells, of_run, out = np.diff(np.r_[fresh, len(node)]), np.repeat(np.arange(len(first)), cells), []
    for least in leasts:
        allowed = (on_left >= least) & (on_right >= least) & (on_right > 0)
        most = np.maximum.reduceat(np.where(allowed, gain, -np.inf), fresh)
        hits = np.flatnonzero((gain == np.repeat(most, own_cells)) & allowed)
        hits = hits[np.r_[True, node[hits[1:]] != node[hits[:-1]]]] if len(hits) else hits  # the first feature and bin of equals
        out.append((node[hits], gain[hits], run[hits] % width, filled[hits] - start[run[hits]], left[:, hits].T, whole[:, of_run[hits]].T))
    return out


def _lots(first: np.ndarray, cells: np.ndarray) -> Iterator[tuple[int, int]]:
    """Nodes one after another whose rows and cells are few enough to be looked at together, one node at least."""
    ends, begin = np.cumsum(cells), 0
    while begin < len(cells):
        done = ends[begin - 1] if begin else 0
        end = min(np.searchsorted(first, first[begin] + ROWS_AT_ONCE, "right") - 1, np.searchsorted(ends, done + CELLS_AT_ONCE, "right"))
        end = max(begin + 1, int(end))
        yield begin, end
        begin = end


def _alone_each(part: Rows, weight: np.ndarray, classes: int, depth: int, subset: int, seed: int, leasts: list[float]) -> list[Tree]:
    """For each smallest leaf of ``leasts`` the tree over rows that are all in ``part``: at each level the cuts that ``best_cuts`` finds.

    Trees that differ in their smallest leaf alone begin alike: as long as they cut alike, their rows are counted once.
    """
    use, features = np.flatnonzero(weight > 0), part.bins.shape[1]
    flat, base, label, weight = part.bins[use].reshape(-1), np.arange(len(use)) * features, part.label[use], weight[use]
    tops = part.bins.max(0).astype(np.int64) + 1 if len(part.label) else np.ones(features, np.int64)
    root, plain = np.bincount(label, weight, classes).astype(float), bool((weight == 1).all())
    # Of each tree: feature, cut, child, gain and class sums by node.
    grown_ = [[np.full(1, -1), np.zeros(1, int), np.zeros(1, int), np.zeros(1), root[None, :]] for _ in leasts]
    # Of each open node: its place, and its number in each tree (-1 where the tree has cut otherwise).
    path, number = np.ones(1, np.int64 if depth <= 40 else object), np.zeros((len(leasts), 1), np.int64)
    at = np.zeros(len(use), np.int64)
    for _ in range(depth):
        if not len(path) or not len(at):
            break
        asked = chosen_of_all(features, subset, seed, path)
        first = np.searchsorted(at, np.arange(len(path) + 1))  # rows are in order of their nodes
        found: list[list[tuple]] = [[] for _ in leasts]
        for begin, end in _lots(first, classes * tops[asked].sum(1)):
            rows = slice(first[begin], first[end])
            own = _cuts(flat, base[rows], label[rows], None if plain else weight[rows], at[rows] - begin, asked[begin:end], tops, classes, leasts)
            for held, (slot, *rest) in zip(found, own):
                held.append((slot + begin, *rest))
        splits = []
        for tree, held in enumerate(found):
            slot, gain, place, cut, left, whole = (np.concatenate(x) for x in zip(*held))
            good = np.flatnonzero((gain > LEAST_GAIN * whole.sum(1)) & (number[tree, slot] >= 0))
            slot, cut = slot[good], cut[good]
            splits.append((slot, gain[good], asked[slot, place[good]], cut, left[good], whole[good]))
        key = [(slot * features + feature) * 256 + cut for slot, _, feature, cut, _, _ in splits]
        entries, which = np.unique(np.concatenate(key), return_inverse=True)
        which = np.split(which, np.cumsum([len(k) for k in key])[:-1])
        e_slot, e_feature, e_cut = entries // 256 // features, entries // 256 % features, entries % 256
        after = np.full((len(leasts), 2 * len(entries)), -1)
        for tree, ((slot, gain, feature, cut, left, whole), entry) in enumerate(zip(splits, which)):
            nodes, (features_, cuts_, child_, gain_, sums_) = number[tree, slot], grown_[tree]
            features_[nodes], cuts_[nodes], child_[nodes], gain_[nodes] = feature, cut, len(features_) + 2 * np.arange(len(nodes)), gain
            both = np.stack([left, np.maximum(whole - left, 0.0)], 1).reshape(-1, classes)
            more = np.zeros(len(both), int)
            grown_[tree] = [np.r_[features_, more - 1], np.r_[cuts_, more], np.r_[child_, more], np.r_[gain_, more.astype(float)], np.concatenate([sums_, both])]
            further = ((both > 0).sum(1) > 1) & (both.sum(1) >= 2 * leasts[tree])
            after[tree, (2 * entry[:, None] + [0, 1]).ravel()] = np.where(further, len(features_) + np.arange(len(both)), -1)
        # Rows go on to the children that are looked at again, once for each way that trees cut their node.
        open_ = np.flatnonzero((after >= 0).any(0))
        path, number = (2 * np.repeat(path[e_slot], 2) + np.tile(np.arange(2), len(entries)))[open_], after[:, open_]
        counts = first[e_slot + 1] - first[e_slot]
        entry = np.repeat(np.arange(len(entries)), counts)
        rows = np.arange(len(entry)) + np.repeat(first[e_slot] - np.cumsum(counts) + counts, counts)
        child = 2 * entry + (flat.take(base[rows] + e_feature[entry]) > e_cut[entry])
        place = np.full(2 * len(entries), -1)
        place[open_] = np.arange(len(open_))
        child = place[child]
        stay = np.flatnonzero(child >= 0)
        child = child[stay]
        order = np.argsort(child.astype(np.uint16) if len(open_) <= 1 << 16 else child, kind="stable")
        rows, at = rows[stay[order]], child[order]
        base, label, weight = base[rows], label[rows], weight[rows]
    return [Tree(f.tolist(), c.tolist(), k.astype(np.int32), [], sums, gain) for f, c, k, gain, sums in grown_]  # places are of no more use


def _alone(part: Rows, weight: np.ndarray, classes: int, depth: int, subset: int, seed: int, least: float) -> Tree:
    """A tree over rows that are all in ``part``."""
    return _alone_each(part, weight, classes, depth, subset, seed, [least])[0]


def _packed_rows(rows: DataFrame, features: int) -> DataFrame:
    """(block, rows): the rows of each task as ``Rows`` in compressed blocks, which passes read instead; written once."""
    ship(rows.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        for i, part in enumerate(_parts(batches, features)):
            block = (TaskContext.get().partitionId() << 32) + i
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([zlib.compress(pickle.dumps(part, 5), 1)], pa.binary())], ["block", "rows"])

    return materialize(rows.mapInArrow(pack, "block bigint, rows binary"), "packed")


def _unpacked_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[Rows]:
    for batch in batches:
        for held in batch.column("rows"):
            yield pickle.loads(zlib.decompress(held.as_buffer()))


def over_one_part(table: "Binned", columns: list[str], lots: int, use, kind: str) -> DataFrame:
    """``use(rows, lot)`` gives batches; each lot is a task of its own that holds the whole table."""
    spark = table.rows.sparkSession
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot, blocks = None, {}
        for batch in batches:
            for of, block, rows in zip(*(batch.column(c).to_pylist() for c in ("_lot", "block", "rows"))):
                lot, blocks[block] = of, rows
        if blocks:
            yield from use(_joined([pickle.loads(zlib.decompress(blocks.pop(block))) for block in sorted(blocks)]), lot)

    each = spark.range(0, lots, 1, lots).withColumnRenamed("id", "_lot")
    return each.crossJoin(F.broadcast(table.packed(columns))).mapInArrow(run, kind)


def best_cuts(table: "Binned", columns: list[str], trees: list[Tree], open_: list[OpenNode], weights: Weights, least: float) -> dict[int, tuple]:
    """Best cut of each open node by Gini impurity: {number: (gain, feature, cut, left sums, all sums)}; one pass over the rows."""
    spark, classes = table.rows.sparkSession, table.classes
    ship(spark)
    by_model: dict[int, list[int]] = {}
    for slot, n in enumerate(open_):
        by_model.setdefault(n.model, []).append(slot)
    told = spark.sparkContext.broadcast(({m: trees[m] for m in by_model}, open_, by_model, weights))
    sums = [f"w{c}" for c in range(classes)]
    needed = table.packed(columns)
    lots = max(1, min(len(by_model), TASKS_AT_ONCE // max(1, needed.rdd.getNumPartitions())))

    def counter(lot: int):
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trees, open_, by_model, weights = told.value
            for part in _unpacked_rows(batches):
                held, size, top = [], 0, int(part.bins.max()) + 1
                for model in list(by_model)[lot::lots]:
                    slots, weight, tree = by_model[model], weights.of(part, model), trees[model]
                    local = np.full(len(tree.feature), -1)
                    local[[open_[s].node for s in slots]] = np.arange(len(slots))
                    at = local[tree.nodes_of(part.bins)] if len(local) > 1 else np.full(len(weight), local[0])
                    use = np.flatnonzero((at >= 0) & (weight > 0))
                    if not len(use):
                        continue
                    asked = np.stack([open_[s].features for s in slots])
                    node, place, bin_, total = _cells(part.columns, top, use, part.label[use], weight[use], at[use], asked, classes)
                    held.append((np.array(slots)[node], asked[node, place], bin_, total))
                    size += len(node)
                    if size > 200_000:
                        yield cells(held)
                        held, size = [], 0
                if held:
                    yield cells(held)

        return count

    def cells(held: list) -> pa.RecordBatch:
        slot, feature, bin_, total = (np.concatenate(x) for x in zip(*held))
        return pa.RecordBatch.from_arrays(
            [pa.array(slot, pa.int32()), pa.array(feature, pa.int32()), pa.array(bin_, pa.int32()), *[pa.array(total[:, c]) for c in range(classes)]],
            ["slot", "feature", "bin", *sums])

    kind = "slot int, feature int, bin int, " + ", ".join(f"{s} double" for s in sums)
    counted = reduce(DataFrame.unionAll, [needed.mapInArrow(counter(lot), kind) for lot in range(lots)])
    counted = counted.groupBy("slot", "feature", "bin").agg(*[F.sum(s).alias(s) for s in sums])
    found = _best_by_slot(counted.repartition("slot"), least)
    told.destroy()
    return found


def _best_by_slot(cells: DataFrame, least: float) -> dict[int, tuple]:
    """Best cut of each slot from its cells (slot, feature, bin, class sums), which are in one partition."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:  # sorted by node; the last node of a batch may go on in the next
            slots = batch.column(0).to_numpy()
            start = int(np.searchsorted(slots, slots[-1])) if len(slots) else 0
            if start or (rest and len(slots) and rest[-1].column(0)[-1].as_py() != slots[0]):
                yield _best_of([*rest, batch.slice(0, start)], least)
                rest = []
            rest.append(batch.slice(start))
        if rest:
            yield _best_of(rest, least)

    # All cells of a node are at most its features times the bins.
    sorted_ = cells.sortWithinPartitions("slot", "feature", "bin")
    best = sorted_.mapInArrow(choose, "slot int, gain double, feature int, bin int, left array<double>, whole array<double>").toArrow().to_pylist()
    return {r["slot"]: (r["gain"], r["feature"], r["bin"], np.array(r["left"]), np.array(r["whole"])) for r in best}


def _best_of(batches: list[pa.RecordBatch], least: float) -> pa.RecordBatch:
    """Best cut of each node from its sorted cells (slot, feature, bin, class sums): largest gain, then first feature and bin."""
    cells = pa.Table.from_batches(batches)
    slot, feature, bin_ = (cells.column(c).to_numpy() for c in range(3))
    sums = np.stack([c.to_numpy() for c in cells.columns[3:]], axis=1)
    classes = sums.shape[1]
    kept: list[tuple] = []
    if len(slot):
        run = np.r_[0, np.cumsum((slot[1:] != slot[:-1]) | (feature[1:] != feature[:-1]))]
        first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        dense = np.zeros((len(first), int(bin_.max()) + 1, classes))
        dense[run, bin_] = sums
        last = np.maximum.reduceat(bin_, first)
        left = dense.cumsum(1)
        whole = left[:, -1:, :]
        right = np.maximum(whole - left, 0.0)
        on_left, on_right, everything = left.sum(2), right.sum(2), whole.sum(2)
        allowed = (dense.sum(2) > 0) & (np.arange(dense.shape[1]) < last[:, None]) & (on_left >= least) & (on_right >= least) & (on_right > 0)
        pure = lambda w, n: (w * w).sum(2) / np.where(n > 0, n, 1.0)
        gain = np.where(allowed, pure(left, on_left) + pure(right, on_right) - pure(whole, everything), -np.inf)
        cut = gain.argmax(1)
        top = gain[np.arange(len(first)), cut]
        order = np.lexsort((feature[first], -top, slot[first]))
        best = order[np.r_[True, slot[first][order][1:] != slot[first][order][:-1]]]
        kept = [(int(slot[first[r]]), float(top[r]), int(feature[first[r]]), int(cut[r]), left[r, cut[r]].tolist(), whole[r, 0].tolist())
                for r in best if np.isfinite(top[r])]
    names, kinds = ["slot", "gain", "feature", "bin", "left", "whole"], [pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64())]
    columns = list(zip(*kept)) if kept else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def grown(table: "Binned", weights: Weights, models: int, depth: int, subset: int | None = None, seeds: list[int] | None = None, least: float = 1.0, columns: list[str] | None = None) -> list[Tree]:
    """``models`` trees of at most ``depth``, all grown together, one aggregate a level.

    A node looks at ``subset`` features (all without it) chosen by its tree's seed and its place.
    """
    features = len(table.edges)
    subset, seeds = subset or features, seeds or [0] * models
    needed = ["bins", "label", "row", "fold", *(columns or [])]
    if table.one_part:
        return _unpacked(_tree_rows(table, weights, models, depth, subset, seeds, least, needed), models, table.classes)
    trees = [Tree() for _ in range(models)]
    open_ = [OpenNode(m, 0, chosen_features(features, subset, seeds[m], 1)) for m in range(models)]
    for _ in range(depth):
        if not open_:
            break
        cuts = best_cuts(table, needed, trees, open_, weights, least)
        after = []
        for slot, (gain, feature, cut, left, whole) in cuts.items():
            model, node = open_[slot].model, open_[slot].node
            tree = trees[model]
            tree.sums[node] = whole
            if gain <= LEAST_GAIN * whole.sum():
                continue
            for child in tree.split(node, feature, cut, left, np.maximum(whole - left, 0.0), gain):
                sums = tree.sums[child]
                if (sums > 0).sum() > 1 and sums.sum() >= 2 * least:
                    after.append(OpenNode(model, child, chosen_features(features, subset, seeds[model], tree.path[child])))
        open_ = after
    _fill_roots(table, trees, weights, columns or [])
    return trees


def _tree_rows(table: "Binned", weights: Weights, models: int, depth: int, subset: int, seeds: list[int], least: float, columns: list[str]) -> DataFrame:
    """(m, tree): ``models`` trees, packed, from one job in which each task grows some of them over the whole table."""
    told = table.rows.sparkSession.sparkContext.broadcast((weights, seeds))
    lots, classes = min(models, TASKS_AT_ONCE), table.classes

    def grow(part: Rows, lot: int) -> Iterator[pa.RecordBatch]:
        weights, seeds = told.value
        for m in range(lot, models, lots):
            tree = _alone(part, weights.of(part, m), classes, depth, subset, seeds[m], least)
            yield pa.RecordBatch.from_arrays([pa.array([m]), pa.array([zlib.compress(pickle.dumps(tree), 1)])], ["m", "tree"])

    return over_one_part(table, columns, lots, grow, "m bigint, tree binary")


def _unpacked(rows: DataFrame, models: int, classes: int) -> list[Tree]:
    found = {r["m"]: pickle.loads(zlib.decompress(r["tree"])) for r in rows.collect()}
    return [found.get(m) or Tree(sums=[np.zeros(classes)]) for m in range(models)]


def _fill_roots(table: "Binned", trees: list[Tree], weights: Weights, columns: list[str]) -> None:
    """Class sums of trees without any cut: they answer with the shares of all their rows."""
    bare = [m for m, t in enumerate(trees) if t.sums[0] is None]
    if not bare:
        return
    told = table.rows.sparkSession.sparkContext.broadcast(weights)
    features, classes = len(table.edges), table.classes

    def count(batches):
        for part in _parts(batches, features):
            sums = np.stack([np.bincount(part.label, told.value.of(part, m), classes) for m in bare])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(bare, classes)), pa.array(np.tile(np.arange(classes), len(bare))), pa.array(sums.ravel())], ["m", "c", "w"])

    needed = table.rows.select(*[c for c in ["bins", "label", "row", "fold", *columns] if c in table.rows.columns])
    for m in bare:
        trees[m].sums[0] = np.zeros(classes)
    for r in needed.mapInArrow(count, "m bigint, c bigint, w double").groupBy("m", "c").agg(F.sum("w").alias("w")).collect():
        trees[r["m"]].sums[0][r["c"]] = r["w"]
    told.destroy()


# --- models of one or more trees ---


@dataclass
class Ensemble(Predictor):
    """Trees on bins. Scores are the mean of the leaves' class shares, or with ``hard`` the weight of the trees that pick a class."""

    trees: list[Tree]
    edges: list[np.ndarray]
    classes: int
    weights: list[float] | None = None
    hard: bool = False

    def scores_of(self, bins: np.ndarray) -> np.ndarray:
        out = np.zeros((len(bins), self.classes))
        weights = self.weights or [1.0] * len(self.trees)
        for tree, weight in zip(self.trees, weights):
            shares = tree.leaf_shares()
            if self.hard:
                shares = np.eye(self.classes)[shares.argmax(1)]
            out += weight * shares[tree.nodes_of(bins)]
        return out / max(sum(weights), 1e-300)

    def scores(self, df: DataFrame, name: str) -> DataFrame:
        return with_scores(with_bins(df, self.edges), {name: [self]}).drop("bins")

    def importances(self) -> np.ndarray:
        """Share of the impurity that cuts of each feature took away, each tree counting alike."""
        total = np.zeros(len(self.edges))
        for tree in self.trees:
            own = np.zeros(len(self.edges))
            np.add.at(own, [f for f in tree.feature if f >= 0], [g for f, g in zip(tree.feature, tree.gain) if f >= 0])
            total += own / own.sum() if own.sum() > 0 else own
        return total / total.sum() if total.sum() > 0 else total


@dataclass
class StoredForest(Predictor):
    """An ``Ensemble`` whose trees are a table, read by the driver only when it is asked to predict."""

    rows: DataFrame
    size: int
    edges: list[np.ndarray]
    classes: int

    @property
    def trees(self) -> list[Tree]:
        return _unpacked(self.rows, self.size, self.classes)

    def scores(self, df: DataFrame, name: str) -> DataFrame:
        return Ensemble(self.trees, self.edges, self.classes).scores(df, name)


def with_scores(df: DataFrame, named: dict[str, list[Ensemble]]) -> DataFrame:
    """Adds each name's class scores to rows with ``bins``; of several ensembles a row takes the one of its ``fold``."""
    ship(df.sparkSession)
    told = df.sparkSession.sparkContext.broadcast(named)
    by_fold = any(len(models) > 1 for models in named.values())
    kind = "struct<" + ",".join(f"`{n}`:array<double>" for n in named) + ">"

    @F.pandas_udf(kind)
    def judge(bins, fold):
        import pandas as pd

        features = len(next(iter(told.value.values()))[0].edges)
        matrix = np.frombuffer(b"".join(bins), np.uint8).reshape(len(bins), features)
        out = {}
        for name, models in told.value.items():
            found = np.zeros((len(matrix), models[0].classes))
            if len(models) == 1:
                found = models[0].scores_of(matrix)
            else:
                for number, model in enumerate(models):
                    mine = np.flatnonzero(fold.to_numpy() == number)
                    found[mine] = model.scores_of(matrix[mine])
            out[name] = list(found)
        return pd.DataFrame(out)

    fold = F.col("fold") if by_fold else F.lit(0)
    return df.withColumn("_judged", judge("bins", fold)).select(*df.columns, *[F.col(f"_judged.{n}").alias(n) for n in named])


@dataclass
class Binned:
    """Rows with ``bins``, ``label``, ``row`` (a number that tells rows apart) and maybe ``fold``, written once.

    ``one_part``: so few rows that one task counts them all. ``alone``: so few that any task may hold all of them, to grow deep trees.
    """

    rows: DataFrame
    edges: list[np.ndarray]
    classes: int
    one_part: bool = False
    alone: bool = False
    _packed: dict[tuple, DataFrame] = field(default_factory=dict, repr=False)
    _lock: object = field(default_factory=Lock, repr=False)  # fits run side by side

    def packed(self, columns: list[str]) -> DataFrame:
        """The rows' ``columns``, those they have, packed for any number of passes."""
        some = tuple(c for c in self.rows.columns if c in columns)
        with self._lock:
            if some not in self._packed:
                self._packed[some] = _packed_rows(self.rows.select(*some), len(self.edges))
            return self._packed[some]


def binned(train: DataFrame, classes: int, keys: list[str] | None = None, max_bins: int = MAX_BINS, edges: list[np.ndarray] | None = None) -> Binned:
    """``train`` in the bins of ``edges``, or of its own."""
    edges = bin_edges(train, max_bins) if edges is None else edges
    number = F.xxhash64(*keys) if keys else F.xxhash64("features", "label")
    size = train.count()
    tasks = max(1, ceil(size / ROWS_PER_TASK))  # each task hands on one number per bin, however few its rows
    rows = materialize(with_bins(train, edges).withColumn("row", number).repartition(tasks), "binned")
    return Binned(rows, edges, classes, tasks == 1, size <= ROWS_ALONE)


@dataclass
class HistogramTree:
    """One decision tree by Gini impurity."""

    classes: int
    depth: int = 5
    least: float = 1.0

    def fit_folds(self, table: Binned, folds: int) -> list[Ensemble]:
        """One model without each fold, and last one of all rows."""
        left_out = [*range(folds), -1]
        trees = grown(table, Weights(left_out), len(left_out), self.depth, least=self.least)
        return [Ensemble([t], table.edges, self.classes) for t in trees]

    def fit(self, train: DataFrame) -> Ensemble:
        return self.fit_folds(binned(train, self.classes), 0)[-1]


@dataclass
class HistogramForest:
    """Bootstrapped trees; each node looks at a ``subset`` of the features: ``sqrt`` of their number, or ``all`` (bagging)."""

    classes: int
    trees: int = 100
    depth: int = 5
    subset: str = "sqrt"
    least: float = 1.0
    bootstrap: bool = True
    seed: int = 42
    first: int = 0  # number of the first tree, so that a forest can be grown in parts

    def _seed(self, model: int, i: int) -> int:
        return self.seed * 100_003 + model * 10_007 + self.first + i

    def _width(self, features: int) -> int:
        return features if self.subset == "all" else ceil(sqrt(features))

    def trees_of(self, part: Rows, base: Weights, model: int, leasts: list[float]) -> list[Tree]:
        """The first tree of ``fit_weighted`` for one model, with each of ``leasts``, where ``part`` holds all rows."""
        seed = self._seed(model, 0)
        weights = Bootstrap(base, list(range(model + 1)), [seed if self.bootstrap else -1] * (model + 1))
        return _alone_each(part, weights.of(part, model), self.classes, self.depth, self._width(part.bins.shape[1]), seed, leasts)

    def fit_stored(self, table: Binned) -> "StoredForest":
        """The forest of all rows of a table that is ``alone``; its trees stay in the shared folder."""
        seeds = [self._seed(0, i) for i in range(self.trees)]
        weights = Bootstrap(Weights([-1]), [0] * self.trees, seeds if self.bootstrap else [-1] * self.trees)
        rows = _tree_rows(table, weights, self.trees, self.depth, self._width(len(table.edges)), seeds, self.least, ["bins", "label", "row"])
        return StoredForest(materialize(rows, "forest"), self.trees, table.edges, self.classes)

    def fit_weighted(self, table: Binned, base: Weights, models: int, columns: list[str] | None = None) -> list[Ensemble]:
        """A forest for each of ``models`` weights. Tree ``i`` of a forest is the same whatever the number of trees."""
        owner = [m for m in range(models) for _ in range(self.trees)]
        seeds = [self._seed(m, i) for m in range(models) for i in range(self.trees)]
        width = self._width(len(table.edges))
        weights = Bootstrap(base, owner, seeds if self.bootstrap else [-1] * len(seeds))
        trees = grown(table, weights, len(owner), self.depth, width, seeds, self.least, columns)
        return [Ensemble(trees[m * self.trees : (m + 1) * self.trees], table.edges, self.classes) for m in range(models)]

    def fit_folds(self, table: Binned, folds: int) -> list[Ensemble]:
        left_out = [*range(folds), -1]
        return self.fit_weighted(table, Weights(left_out), len(left_out))

    def fit(self, train: DataFrame) -> Ensemble:
        return self.fit_folds(binned(train, self.classes), 0)[-1]


class ShrinkingForest:
    """Forests over fewer and fewer features of one table, from one store of cuts.

    A tree's sample does not depend on the features left, and a node chooses among them in an order of its own
    (``chosen_among``). So a feature that goes changes a node only where it was chosen, and what hangs below. The best cuts of a node
    by ``AHEAD`` times as many features as it looks at, the next in its order, are found when a tree first comes to the node, and again
    when these are used up: rows are read for such nodes alone, once a level for those of all trees. The driver keeps
    the cuts of the last forest's nodes; so this is for trees of bounded depth.
    """

    AHEAD = 3

    def __init__(self, table: Binned, forest: HistogramForest):
        self.table, self.forest = table, forest
        self.left = np.arange(len(table.edges))
        self.seeds = [forest._seed(0, i) for i in range(forest.trees)]
        self.weights = Bootstrap(Weights([-1]), [0] * forest.trees, self.seeds if forest.bootstrap else [-1] * forest.trees)
        self.known: dict[tuple, tuple[set, list[tuple]]] = {}  # (tree, cuts on the way) -> features asked for, best cuts by them
        self.roots: dict[int, np.ndarray] = {}
        self.passes = 0
        self.blocks = materialize(self._packed(), "blocks")

    def _packed(self) -> DataFrame:
        """A row for each block of rows: bins feature by feature, labels, and how often each tree draws each row."""
        weights, trees, features = self.weights, len(self.seeds), len(self.table.edges)
        ship(self.table.rows.sparkSession)

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in _parts(batches, features):
                drawn = np.stack([weights.of(part, m) for m in range(trees)]).astype(np.uint8)  # whole numbers of 18 at most
                columns = [np.ascontiguousarray(part.bins.T), part.label.astype(np.int32), drawn]
                yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], ["bins", "label", "drawn"])

        return self.table.rows.select("bins", "label", "row").mapInArrow(pack, "bins binary, label binary, drawn binary")

    def fit(self, left: list[int]) -> Ensemble:
        """The forest over the features ``left``, which are among those of the fit before."""
        if not set(left) <= set(self.left.tolist()):
            raise ValueError("a feature is back that had gone")
        self.left = np.sort(np.asarray(left, np.int64))
        forest, features, used = self.forest, len(self.table.edges), {}
        width = forest._width(len(self.left))
        trees = [Tree() for _ in self.seeds]
        open_: list[tuple[int, int, tuple]] = [(m, 0, ()) for m in range(len(trees))]
        for _ in range(forest.depth):
            looked = [chosen_among(self.left, features, width, self.seeds[m], trees[m].path[node]).tolist() for m, node, _ in open_]
            asked = [self.known.get((m, way), (set(), []))[0] for m, _, way in open_]
            self._ask(trees, [at for at, new, old in zip(open_, looked, asked) if not old.issuperset(new)], self.AHEAD * width)
            after = []
            for (m, node, way), among in zip(open_, map(set, looked)):
                tree, (_, cuts) = trees[m], self.known[m, way]
                used[m, way] = self.known[m, way]
                best = max((c for c in cuts if c[1] in among), key=lambda c: (c[0], -c[1]), default=None)
                if best is None or best[0] <= LEAST_GAIN * best[4].sum():
                    continue
                gain, feature, cut, on_left, whole = best
                tree.sums[node] = whole
                for side, child in enumerate(tree.split(node, feature, cut, on_left, np.maximum(whole - on_left, 0.0), gain)):
                    sums = tree.sums[child]
                    if (sums > 0).sum() > 1 and sums.sum() >= 2 * forest.least:
                        after.append((m, child, (*way, (feature, cut, side))))
            open_ = after
        self.known = used
        for m, sums in self.roots.items():
            trees[m].sums[0] = sums
        _fill_roots(self.table, trees, self.weights, [])
        self.roots = {m: tree.sums[0] for m, tree in enumerate(trees)}
        return Ensemble(trees, self.table.edges, forest.classes)

    def _ask(self, trees: list[Tree], fresh: list[tuple[int, int, tuple]], width: int) -> None:
        if not fresh:
            return
        self.passes += 1
        features, classes, total = len(self.table.edges), self.table.classes, len(trees)
        nodes = [OpenNode(m, node, chosen_among(self.left, features, width, self.seeds[m], trees[m].path[node])) for m, node, _ in fresh]
        told = self.table.rows.sparkSession.sparkContext.broadcast([(m, way, node.features) for (m, _, way), node in zip(fresh, nodes)])
        sums = [f"w{c}" for c in range(classes)]

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in range(len(batch)):
                    plain = lambda name, kind: np.frombuffer(batch.column(name)[block].as_buffer(), kind)
                    label = plain("label", np.int32)
                    yield cells(plain("bins", np.uint8).reshape(features, len(label)), label, plain("drawn", np.uint8).reshape(total, len(label)))

        def cells(bins: np.ndarray, label: np.ndarray, drawn: np.ndarray) -> pa.RecordBatch:
            places: dict[tuple, np.ndarray] = {}

            def rows_of(m: int, way: tuple) -> np.ndarray:
                if (m, way) not in places:
                    if way:
                        rows, (feature, cut, side) = rows_of(m, way[:-1]), way[-1]
                        places[m, way] = rows[(bins[feature][rows] > cut) == side]
                    else:
                        places[m, way] = np.flatnonzero(drawn[m])
                return places[m, way]

            held = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, classes)))]
            for slot, (m, way, asked) in enumerate(told.value):
                rows = rows_of(m, way)
                own, weight = label[rows].astype(np.int64), drawn[m][rows].astype(float)
                for feature in asked.tolist() if len(rows) else []:
                    found = np.bincount(bins[feature][rows].astype(np.int64) * classes + own, weight, 256 * classes).reshape(256, classes)
                    filled = np.flatnonzero(found.any(1))
                    held.append((np.full(len(filled), slot * features + feature), filled, found[filled]))
            slots, filled, found = (np.concatenate(x) for x in zip(*held))
            return pa.RecordBatch.from_arrays(
                [pa.array(slots, pa.int32()), pa.array(slots % features, pa.int32()), pa.array(filled, pa.int32()), *[pa.array(found[:, c]) for c in range(classes)]],
                ["slot", "feature", "bin", *sums])

        # A slot is a node and a feature: the best cut by each feature is wanted.
        kind = "slot int, feature int, bin int, " + ", ".join(f"{s} double" for s in sums)
        added = self.blocks.mapInArrow(count, kind).repartition("slot").groupBy("slot", "feature", "bin").agg(*[F.sum(s).alias(s) for s in sums])
        found = _best_by_slot(added, self.forest.least)
        told.destroy()
        for (m, _, way), node in zip(fresh, nodes):
            self.known[m, way] = (set(node.features.tolist()), [])
        for number, cut in found.items():
            m, _, way = fresh[number // features]
            self.known[m, way][1].append(cut)


class Raised(Weights):
    """Boosting weights: what each stump of a model so far missed is heavier by its amount."""

    def __init__(self, base: Weights, stumps: list[list[Tree]], amounts: list[list[float]], scales: list[float]):
        self.base, self.stumps, self.amounts, self.scales = base, stumps, amounts, scales

    def of(self, rows: Rows, m: int) -> np.ndarray:
        raised, labels = np.full(len(rows.label), self.scales[m]), np.arange(int(rows.label.max(initial=0)) + 1)
        beyond = rows.label + len(labels)
        for stump, amount in zip(self.stumps[m], self.amounts[m]):
            picks = stump.leaf_shares().argmax(1)[[stump.child[0], stump.child[0] + 1]]
            missed = np.where(picks[:, None] != labels, amount, 0.0)  # by side of the cut and label
            right = rows.columns[stump.feature[0]] > stump.cut[0]
            raised += missed.ravel().take(np.where(right, beyond, rows.label))
        return self.base.of(rows, m) * np.exp(raised)


@dataclass
class AdaptiveBoosting:
    """Multi-class adaptive boosting over depth-one trees.

    A round is one aggregate for all folds: the best cut's class sums give the stump, its error and its amount. A row's weight
    follows from the stumps so far, so no round writes anything.
    """

    classes: int
    rounds: int = 50
    seed: int = 42

    def fit_folds(self, table: Binned, folds: int) -> list[Ensemble]:
        base = Weights([*range(folds), -1])
        models = folds + 1
        stumps: list[list[Tree]] = [[] for _ in range(models)]
        amounts: list[list[float]] = [[] for _ in range(models)]
        scales, running = [0.0] * models, list(range(models))
        every = np.arange(len(table.edges))
        columns = ["bins", "label", "row", "fold"]
        for _ in range(self.rounds):
            weights = Raised(base, stumps, amounts, scales)
            open_ = [OpenNode(m, 0, every) for m in running]
            cuts = best_cuts(table, columns, [Tree()] * models, open_, weights, 0.0)
            still = []
            for slot, model in enumerate(running):
                if slot not in cuts:
                    continue
                gain, feature, cut, left, whole = cuts[slot]
                right, total = np.maximum(whole - left, 0.0), whole.sum()
                error = (left.sum() - left.max() + right.sum() - right.max()) / total
                if error >= 1 - 1 / self.classes or gain <= LEAST_GAIN * total:
                    continue  # no better than guessing
                stump = Tree()
                stump.sums[0] = whole
                stump.split(0, feature, cut, left, right, gain)
                stumps[model].append(stump)
                if error <= 1e-12:
                    amounts[model].append(1.0)
                    continue
                amount = log((1 - error) / error) + log(self.classes - 1)
                amounts[model].append(amount)
                # Weights keep their mean.
                scales[model] -= log((1 - error) + error * np.exp(amount))
                still.append(model)
            running = still
            if not running:
                break
        if not all(stumps):
            raise ValueError("the first tree is no better than guessing")
        return [Ensemble(s, table.edges, self.classes, a, hard=True) for s, a in zip(stumps, amounts)]

    def fit(self, train: DataFrame) -> Ensemble:
        return self.fit_folds(binned(train, self.classes), 0)[-1]
