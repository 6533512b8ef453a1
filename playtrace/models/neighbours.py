"""Exact nearest-neighbour vote without comparing every pair of rows.

Training rows go to the cell of their nearest pivot, and cells that lie together go to one block of rows; queries are dealt
into blocks likewise. A query first meets the block of its own cell. What it finds there and the pivots give an upper bound on
the distance of its k-th neighbour, and the triangle inequality rules out every cell that lies beyond it. A query only goes to
blocks with other cells, so its vector is copied once a block, not once a cell. Large cells are cut into blocks, so a task
compares at most one block of queries with one of rows. It multiplies matrices to see which rows may be near enough, with
room for rounding, and takes the true distances of those alone. Equal vectors are compared once: of equal training rows only
the k smallest ids can be neighbours, and equal queries share their answer. All bounds are exact.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from playtrace.models.learners import Predictor
from playtrace.runtime import materialize, ship

BLOCK_BYTES = 16 << 20  # vectors of a block, unless the caller gives its rows
LEAST_BLOCK, BLOCKS = 4000, 8  # smaller tables are cut into some blocks, too, so that several tasks work
QUERIES_AT_ONCE, PAIRS_AT_ONCE, TRUE_AT_ONCE = 1024, 1 << 21, 1 << 16
FEWEST_PIVOTS, MOST_PIVOTS = 16, 1024
NO_GROUP = -1
SLACK = 1 + 1e-9  # keeps rounding in the bounds from ruling out a true neighbour


def _distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Euclidean distances, one row of ``left`` at a time to keep memory at one block."""
    return np.stack([np.sqrt(((right - row) ** 2).sum(axis=1)) for row in left])


def nearest_pivot(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add ``cell`` and ``to_pivot``, the nearest pivot and the distance to it."""

    @F.pandas_udf("cell int, to_pivot double")
    def place(vectors: pd.Series) -> pd.DataFrame:
        d = _distances(np.stack(vectors.to_numpy()), pivots)
        return pd.DataFrame({"cell": d.argmin(axis=1).astype("int32"), "to_pivot": d.min(axis=1)})

    return df.withColumn("_p", place("v")).select(*df.columns, "_p.cell", "_p.to_pivot")


def _products(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(squared distances by matrix product, what they may be wrong by for each row of ``left``)."""
    own, other = (left**2).sum(1), (right**2).sum(1)
    squares = left @ right.T
    squares *= -2
    squares += own[:, None]
    squares += other
    return squares, 1e-12 * (own + other.max())


def visited_blocks(queries: DataFrame, pivots: np.ndarray, radius: np.ndarray, near: dict[int, np.ndarray], k: int, spans: np.ndarray) -> DataFrame:
    """Replace ``bound`` by the best known, and add ``blocks``: those with a cell that may hold one of the k nearest rows.

    ``near[g][c]`` are the k smallest distances to its pivot of cell c's rows outside group g (infinite where there are
    fewer): a query of the group is at most its own distance to the pivot further away from those rows. ``spans[c]`` are
    the first block of cell c and the number of its blocks.
    """

    @F.pandas_udf("bound double, blocks array<int>")
    def visits(vectors: pd.Series, groups: pd.Series, found: pd.Series) -> pd.DataFrame:
        bounds, out = [], []
        for vector, group, known in zip(vectors, groups, found):
            row = np.sqrt(((pivots - vector) ** 2).sum(axis=1))
            reach = (row[:, None] + near.get(group, near[NO_GROUP])).ravel()
            bounds.append(min(known, np.partition(reach, k - 1)[k - 1]))
            cells = np.flatnonzero(row - radius <= bounds[-1] * SLACK)
            wide = cells[spans[cells, 1] > 1]
            more = [np.arange(first, first + count) for first, count in spans[wide]]
            out.append(np.unique(np.concatenate([spans[cells, 0], *more])).astype("int32"))
        return pd.DataFrame({"bound": bounds, "blocks": out})

    judged = queries.withColumn("_b", visits("v", "grp", "bound"))
    return judged.select(*[c for c in queries.columns if c != "bound"], "_b.bound", "_b.blocks")


class NeighbourIndex:
    """Training rows laid out in cells for any number of ``find`` calls.

    ``train`` has ``id``, ``v`` (array of doubles) and ``label``. With ``group`` (a few numbers from 0, such as folds) a query
    finds neighbours outside its own group only, so one index answers the queries of every fold.
    """

    def __init__(self, train: DataFrame, k: int, block_rows: int | None = None, pivots: int | None = None, group: str | None = None):
        ship(train.sparkSession)
        self.k, self.group = k, group
        same = Window.partitionBy("v", "grp").orderBy("id")
        grouped = train.select("id", "v", "label", (F.col(group).cast("int") if group else F.lit(0)).alias("grp"))
        first = grouped.withColumn("_n", F.row_number().over(same)).filter(F.col("_n") <= k)
        rows = materialize(first.drop("_n"), "train")
        # About the root of the number of rows, so that rows per cell grow as slowly as cells per query.
        size = rows.count()
        pivots = pivots or int(min(MOST_PIVOTS, max(FEWEST_PIVOTS, size**0.5)))
        # Any rows serve as pivots; the ones of smallest hash are a fixed, spread-out choice.
        chosen = rows.orderBy(F.xxhash64("id"), "id").limit(pivots).select("v").collect()
        if not chosen:
            raise ValueError("no training rows")
        self.centres = np.array([r["v"] for r in chosen])
        widest = max(1, BLOCK_BYTES // (8 * self.centres.shape[1]))
        self.block_rows = block_rows or min(widest, max(LEAST_BLOCK, ceil(size / BLOCKS)))
        self.placed = materialize(nearest_pivot(rows, self.centres), "cells")

        shape = self.placed.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), F.max("to_pivot").alias("radius"))
        self.rows_in, self.radius = {}, np.full(len(chosen), -np.inf)
        for r in shape.collect():  # one row per pivot
            self.rows_in[r["cell"]], self.radius[r["cell"]] = r["rows"], r["radius"]
        by_distance = Window.partitionBy("cell", "grp").orderBy("to_pivot")
        closest = self.placed.select("cell", "grp", "to_pivot", F.row_number().over(by_distance).alias("n")).filter(F.col("n") <= k).collect()
        self.near = {g: self._nearest_outside(closest, g) for g in {NO_GROUP, *(r["grp"] for r in closest if group)}}

    def _nearest_outside(self, closest: list, group: int) -> np.ndarray:
        """The k smallest distances to its pivot of each cell's rows outside ``group``, from at most k rows per pivot and group."""
        found = {}
        for r in closest:
            if r["grp"] != group:
                found.setdefault(r["cell"], []).append(r["to_pivot"])
        near = np.full((len(self.centres), self.k), np.inf)
        for cell, distances in found.items():
            best = sorted(distances)[: self.k]
            near[cell, : len(best)] = best
        return near

    def _walk(self) -> list[int]:
        """Cells in an order in which each is followed by the nearest of the rest: neighbours share blocks."""
        order, left = [0], np.ones(len(self.centres), bool)
        left[0] = False
        while left.any():
            distance = ((self.centres - self.centres[order[-1]]) ** 2).sum(axis=1)
            order.append(int(np.where(left, distance, np.inf).argmin()) if np.isfinite(distance[left]).any() else int(left.argmax()))
            left[order[-1]] = False
        return order

    def _spans(self, sizes: dict[int, int]) -> np.ndarray:
        """First block and number of blocks of each cell: small neighbours share one, a large cell has several of its own."""
        spans, block, filled = np.zeros((len(self.centres), 2), np.int64), 0, 0
        for cell in self._walk():
            size = sizes.get(cell, 0)
            if filled and filled + size > self.block_rows:
                block, filled = block + 1, 0
            count = max(1, ceil(size / self.block_rows))
            spans[cell] = block, count
            block, filled = (block + count, 0) if count > 1 else (block, filled + size)
        return spans

    @staticmethod
    def _block(spans: np.ndarray, cell: str, key: str) -> Column:
        of = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col(cell) + 1)
        return (of(spans[:, 0]) + F.pmod(F.xxhash64(key), of(spans[:, 1]))).cast("int")

    def _meet(self, asked: DataFrame, rows: DataFrame) -> DataFrame:
        """(query, id, distance, label): the k nearest of each block ``rb`` for each query that goes there; ``qb`` is the query's own block."""
        k, centres, radius = self.k, self.centres, self.radius

        def block_neighbours(_, asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
            if not len(asked) or not len(known):
                return pd.DataFrame(columns=["query", "id", "distance", "label"], dtype=object)
            known = known.sort_values("id", kind="stable").reset_index(drop=True)
            order = np.argsort(known["cell"].to_numpy(), kind="stable")  # rows of a cell together, in order of id
            cells, starts = np.unique(known["cell"].to_numpy()[order], return_index=True)
            matrix, groups = np.stack(known["v"].to_numpy())[order], known["grp"].to_numpy()[order]
            picks = []
            for first in range(0, len(asked), QUERIES_AT_ONCE):
                own = asked.iloc[first : first + QUERIES_AT_ONCE]
                picks.append((first, *_nearest_rows(
                    np.stack(own["v"].to_numpy()), own["grp"].to_numpy(), own["bound"].to_numpy(), matrix, groups, order,
                    starts, centres[cells], radius[cells], k)))
            query, row, distance = (np.concatenate(x) for x in zip(*[(first + q, r, d) for first, q, r, d in picks]))
            return pd.DataFrame({"query": asked["query"].to_numpy()[query], "id": known["id"].to_numpy()[row],
                                 "distance": distance, "label": known["label"].to_numpy()[row]})

        types = {c: self.placed.schema[c].dataType.simpleString() for c in ("id", "label")}
        pairs = asked.select(F.col("qb").alias("_qb"), F.col("rb").alias("_rb")).distinct()
        right = rows.withColumnRenamed("rb", "_rb").join(pairs, "_rb")
        return asked.groupBy("qb", "rb").cogroup(right.groupBy("_qb", "_rb")).applyInPandas(
            block_neighbours, f"query bigint, id {types['id']}, distance double, label {types['label']}")

    def find(self, queries: DataFrame) -> DataFrame:
        """(query vector ``v``, ``id``, ``distance``, ``label``) of the k nearest training rows of each distinct query.

        ``queries`` has ``v``, and the group's column to leave out its rows. Equally distant rows are taken in order of id.
        """
        k = self.k
        apart = self.group is not None and self.group in queries.columns
        asked_group = F.col(self.group).cast("int") if apart else F.lit(NO_GROUP)
        asked = nearest_pivot(queries.select("v", asked_group.alias("grp")).distinct(), self.centres)
        distinct = materialize(asked.drop("to_pivot").withColumn("query", F.monotonically_increasing_id()), "queries")
        askers = {r["cell"]: r["count"] for r in distinct.groupBy("cell").count().collect()}  # one row per pivot
        spans = self._spans(self.rows_in)
        rows = self.placed.select("id", "v", "label", "grp", "cell", self._block(spans, "cell", "id").alias("rb"))
        placed = distinct.withColumn("qb", self._block(self._spans(askers), "cell", "query")).withColumn("rb", self._block(spans, "cell", "query"))
        columns = ["query", "v", "grp", "bound", "qb", "rb"]
        own = materialize(self._meet(placed.withColumn("bound", F.lit(float("inf"))).select(*columns), rows), "near")
        bound = own.groupBy("query").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("bound"))
        known = placed.join(bound, "query", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
        visits = materialize(visited_blocks(known, self.centres, self.radius, self.near, k, spans), "visits")
        others = visits.withColumn("_own", F.col("rb")).withColumn("rb", F.explode("blocks")).filter("rb != _own")
        partial = own.unionByName(self._meet(others.select(*columns), rows))
        ranked = Window.partitionBy("query").orderBy("distance", "id")
        top = partial.withColumn("_n", F.row_number().over(ranked)).filter(F.col("_n") <= k).drop("_n")
        found = distinct.drop("cell").join(top, "query").drop("query")
        return found.withColumnRenamed("grp", self.group) if apart else found.drop("grp")


def _nearest_rows(
    asked: np.ndarray, asked_groups: np.ndarray, bound: np.ndarray, rows: np.ndarray, groups: np.ndarray, rank: np.ndarray,
    starts: np.ndarray, centres: np.ndarray, radius: np.ndarray, k: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, ``rank`` of a row, distance) of the k nearest rows outside the query's group; equal distances in order of rank.

    ``rows`` are sorted by cell, cells begin at ``starts``. Rows beyond ``bound`` may be left out.
    """
    bound = bound.copy()
    squares, wrong = _products(asked, centres)
    to_cell = np.sqrt(np.maximum(squares - wrong[:, None], 0.0)) - radius
    found = []
    for cell, (start, end) in enumerate(zip(starts, [*starts[1:], len(rows)])):
        near = np.flatnonzero(to_cell[:, cell] <= bound * SLACK)
        step = max(1, PAIRS_AT_ONCE // (end - start))
        for some in (near[i : i + step] for i in range(0, len(near), step)):
            squares, wrong = _products(asked[some], rows[start:end])
            squares[asked_groups[some][:, None] == groups[start:end]] = np.inf
            limit = (bound[some] * SLACK) ** 2 + wrong
            hit = squares <= limit[:, None]
            if end - start > k and hit.sum() > 2 * k * len(some):
                limit = np.minimum(limit, np.partition(squares, k - 1, axis=1)[:, k - 1] + 2 * wrong)
                hit = squares <= limit[:, None]
                bound[some] = np.minimum(bound[some], np.sqrt(limit))
            hit &= squares < np.inf
            query, row = np.nonzero(hit)
            for i in range(0, len(query), TRUE_AT_ONCE):
                q, r = some[query[i : i + TRUE_AT_ONCE]], start + row[i : i + TRUE_AT_ONCE]
                found.append((q, rank[r], np.sqrt(((rows[r] - asked[q]) ** 2).sum(axis=1))))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    query, row, distance = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((row, distance, query))
    query, row, distance = query[order], row[order], distance[order]
    fresh = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
    place = np.arange(len(query)) - fresh[np.cumsum(np.r_[True, query[1:] != query[:-1]]) - 1]
    return query[place < k], row[place < k], distance[place < k]


def nearest(
    train: DataFrame, queries: DataFrame, k: int, block_rows: int | None = None, pivots: int | None = None
) -> DataFrame:
    """The k nearest training rows of each distinct query; see ``NeighbourIndex``."""
    return NeighbourIndex(train, k, block_rows, pivots).find(queries)


def neighbour_votes(found: DataFrame) -> DataFrame:
    """Most frequent label among the neighbours of each query; ties go to the smallest label."""
    counts = found.groupBy("v", "label").agg(F.count(F.lit(1)).alias("n"))
    best = F.max(F.struct("n", (-F.col("label")).alias("minus"))).alias("best")
    return counts.groupBy("v").agg(best).select("v", (-F.col("best.minus")).alias("vote"))


@dataclass
class NeighbourModel(Predictor):
    index: NeighbourIndex
    classes: int

    def scores(self, df: DataFrame, name: str) -> DataFrame:
        """Share of each class among the neighbours."""
        asked = df.withColumn("v", vector_to_array("features"))
        share = lambda c: F.avg((F.col("label") == c).cast("double"))
        group = [self.index.group] if self.index.group in df.columns else []
        shares = self.index.find(asked).groupBy("v", *group).agg(F.array(*[share(c) for c in range(self.classes)]).alias(name))
        return asked.join(shares, ["v", *group], "left").drop("v")


@dataclass
class NeighbourLearner:
    """k nearest neighbours; ``id`` names a column that orders equally distant rows."""

    classes: int
    id: str
    k: int = 5

    def fit(self, train: DataFrame, group: str | None = None) -> NeighbourModel:
        """With ``group`` the model leaves out a row's own group wherever scored rows have that column."""
        rows = train.select(F.col(self.id).alias("id"), vector_to_array("features").alias("v"), "label", *([group] if group else []))
        return NeighbourModel(NeighbourIndex(rows, self.k, group=group), self.classes)
