"""Merkle manifest of a data set, and proofs by descent through a content-addressed graph.

Each row is a leaf: the sha256 of its fields, each with its length. Leaves of one tree (a language) stand in order of
their id; runs of eight become their joint digest, level by level, up to one subroot; the subroots become the root in the
same way. What is stored is a set of records *digest -> digests of the children*, without place or parent: equal subtrees
are one record. A leaf's proof is asked from the top. The request starts at the root and follows the digits (base eight)
of the subroot's rank and then of the leaf's rank; at every node the record of the node's digest gives the next node, and
the children that were not chosen are one segment of the path. At the leaf the segments are reversed. Requests that still
share their digits travel as one row, so a level costs as many rows as it has nodes on the way, not as many as there are leaves.

Ranks are numbered over range partitions of all leaves, so a tree that holds most rows is no single task.

Nulls: each field may be null and is then ``-``; rows with a null lang are a tree of their own, which comes first; a null id
comes first in its tree. Empty texts are ``0:``; texts of any length are one digest. Ties: rows with one id stand in order of
their leaf digest, and wholly equal rows are equal leaves side by side. An empty table has no root and gives no rows. Further
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playtrace.llm.common import ascii_lower, broadcast_if_small, settle

FANOUT = 8
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
PATH = "array<struct<left:string,right:string>>"
RESULT = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def framed(value: Column) -> Column:
    """``-`` for null, else byte count, colon and value: no two rows of fields give the same bytes."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(fields: dict[str, Column]) -> Column:
    return digest(*[framed(fields[name]) for name in FIELDS])


def case_folded(docs: DataFrame) -> Column:
    """The text as a tampered copy has it: lower case where 3 divides the id's checksum, else unchanged."""
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return F.when(changed, ascii_lower(F.col("text"))).otherwise(F.col("text"))


def leaves(docs: DataFrame, claimed: Column | None = None) -> DataFrame:
    """(tree, doc_id, leaf, claimed): the digest of each row, and the digest of the row with ``claimed`` as its text."""
    fields = {name: F.col(name) for name in FIELDS}
    other = leaf_of({**fields, "text": claimed}) if claimed is not None else leaf_of(fields)
    return docs.select(F.col("lang").alias("tree"), "doc_id", leaf_of(fields).alias("leaf"), other.alias("claimed"))


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (settled) with ``place`` from 0 within their tree and ``n``, the tree's size.

    Rows are range-partitioned by tree and order and numbered in their partition; what earlier partitions hold of the same
    tree is added from a table with one row per tree and partition. Copies are told apart by their position in the table,
    so a crowd of equal rows can be cut, too.
    """
    keys = ["tree", *order, "_copy"]
    apart = rows.withColumn("_copy", F.monotonically_increasing_id())
    sorted_ = apart.repartitionByRange(*keys).sortWithinPartitions(*keys)
    at = settle(sorted_.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)).drop("_copy"), "ranked")
    runs = settle(at.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows")), "runs")
    before = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = settle(runs.select(
        F.col("tree").alias("_tree"), F.col("_part").alias("_of"), "_first",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
        F.sum("_rows").over(Window.partitionBy("tree")).alias("n")), "runs")
    same = F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("_part") == F.col("_of"))
    place = (F.col("_at") - F.col("_first") + F.col("_before")).alias("place")
    return at.join(broadcast_if_small(runs), same).select(*rows.columns, place, "n")


@dataclass
class Grown:
    """All trees over one table of nodes: the records of each level, and (tree, subroot, height)."""

    records: list[DataFrame]
    tops: DataFrame


def grow(nodes: DataFrame) -> Grown:
    """Levels above ``nodes`` (tree, place, n, digest), until every tree has one node."""
    left, height = nodes.agg(F.max("n")).first()[0] or 0, 0
    records, tops = [], [nodes.filter("n = 1").select("tree", F.col("digest").alias("subroot"), F.lit(0).alias("height"))]
    while left > 1:
        run = F.expr(f"place div {FANOUT}")
        children = F.transform(F.array_sort(F.collect_list(F.struct("place", "digest"))), lambda c: c["digest"])
        above = nodes.filter("n > 1").groupBy("tree", run.alias("place"), F.expr(f"(n + {FANOUT - 1}) div {FANOUT}").alias("n")).agg(children.alias("children"))
        level = settle(above.withColumn("digest", digest(F.array_join("children", ""))), "level")
        left, height = -(-left // FANOUT), height + 1
        records.append(level.select("digest", "children"))
        nodes = level.select("tree", "place", "n", "digest")
        tops.append(nodes.filter("n = 1").select("tree", F.col("digest").alias("subroot"), F.lit(height).alias("height")))
    return Grown(records, settle(reduce(DataFrame.unionByName, tops), "tops"))


@dataclass
class Manifest:
    """Root, content-addressed records, and where each leaf and each tree stands."""

    root: str
    records: DataFrame  # digest, children
    places: DataFrame  # the leaves' columns, place, n
    trees: DataFrame  # tree, subroot, height, place and n among the subroots
    tree_height: int


def manifest(rows: DataFrame) -> Manifest | None:
    """Manifest of ``rows`` (tree, doc_id, leaf, further columns); none of an empty table."""
    rows = settle(rows, "leaves")
    places = settle(ranked(rows, ["doc_id", "leaf"]), "places")
    low = grow(places.select("tree", "place", "n", F.col("leaf").alias("digest")))
    subroots = settle(low.tops.select(F.lit(None).cast("string").alias("tree"), F.col("tree").alias("of"), "subroot", "height"), "subroots")
    trees = settle(ranked(subroots, ["of"]), "trees")
    high = grow(trees.select("tree", "place", "n", F.col("subroot").alias("digest")))
    top = high.tops.first()
    if top is None:
        return None
    levels = low.records + high.records
    nothing = places.sparkSession.createDataFrame([], "digest string, children array<string>")
    records = settle(reduce(DataFrame.unionByName, levels, nothing).dropDuplicates(["digest"]), "records")
    return Manifest(top["subroot"], records, places, trees, top["height"])



def _opened(frontier: DataFrame, records: DataFrame) -> DataFrame:
    """Frontier nodes with the children that their digest's record names."""
    return frontier.join(records, "digest").select(F.col("tree").alias("_tree"), F.col("place").alias("_run"), "children", "path")


def _followed(wanted: DataFrame, opened: DataFrame) -> DataFrame:
    """Each wanted place below an opened node: the chosen child's digest, and its siblings as one more path segment."""
    digit = (F.col("place") % FANOUT).cast("int")
    met = (F.expr(f"place div {FANOUT}") == F.col("_run")) & F.col("tree").eqNullSafe(F.col("_tree"))
    siblings = F.struct(
        F.array_join(F.slice("children", F.lit(1), digit), "").alias("left"),
        F.array_join(F.slice("children", digit + 2, F.lit(FANOUT)), "").alias("right"))
    return wanted.join(opened, met).select(
        *wanted.columns, F.get("children", digit).alias("digest"), F.concat("path", F.array(siblings)).alias("path"))


def _prefixes(wanted: DataFrame, height: int) -> list[DataFrame]:
    """Wanted places of every level up to ``height``: places that share their leading digits are one row."""
    levels = [wanted]
    for _ in range(height):
        levels.append(settle(levels[-1].select("tree", F.expr(f"place div {FANOUT}").alias("place")).distinct(), "wanted"))
    return levels


def requested_paths(stored: Manifest, requests: DataFrame) -> DataFrame:
    """``requests`` (tree, place, further columns) with the ``digest`` they arrive at and their ``path``, leaf first.

    A path has a segment for each level: what stands left and what stands right of the chosen node in its run.
    """
    wanted_trees = stored.trees.join(
        broadcast_if_small(settle(requests.select(F.col("tree").alias("_wanted")).distinct(), "trees")),
        F.col("of").eqNullSafe(F.col("_wanted")), "left_semi")
    seeds = requests.sparkSession.createDataFrame([(None, 0, stored.root, [])], f"tree string, place bigint, digest string, path {PATH}")
    upper = _prefixes(wanted_trees.select("tree", "place", "of", "height"), stored.tree_height)
    for level in range(stored.tree_height - 1, -1, -1):
        seeds = _followed(upper[level], _opened(seeds, stored.records))
    if stored.tree_height == 0:
        seeds = _lone(wanted_trees, stored.root)
    starts = settle(seeds.select(F.col("of").alias("tree"), "height", "digest", "path"), "starts")
    tallest = starts.agg(F.max("height")).first()[0] or 0
    lower = _prefixes(requests.select("tree", "place"), tallest)
    lower[0] = requests
    start_at = lambda k: starts.filter(F.col("height") == k).select("tree", F.lit(0).cast("bigint").alias("place"), "digest", "path")
    frontier = start_at(tallest)
    for level in range(tallest - 1, -1, -1):
        followed = _followed(lower[level], _opened(frontier, stored.records))
        frontier = settle(followed.unionByName(start_at(level)), "frontier") if level else followed
    lone = start_at(0).select(F.col("tree").alias("_tree"), "digest", "path")
    alone = requests.join(lone, F.col("tree").eqNullSafe(F.col("_tree"))).select(*requests.columns, "digest", "path")
    arrived = frontier.unionByName(alone) if tallest else alone
    return arrived.withColumn("path", F.reverse("path"))


def _lone(trees: DataFrame, root: str) -> DataFrame:
    """The only tree's subroot is the root itself, reached without a step."""
    return trees.withColumn("digest", F.lit(root)).withColumn("path", F.array().cast(PATH))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path lead to."""
    return F.aggregate(path, leaf, lambda node, s: digest(s["left"], node, s["right"]))


def proof_digest(path: Column) -> Column:
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def verified(docs: DataFrame) -> DataFrame:
    """Each row's leaf, tree, root and proof, and whether its claimed copy (``case_folded``) leads to the root."""
    stored = manifest(leaves(docs, case_folded(docs)))
    if stored is None:
        return docs.sparkSession.createDataFrame([], RESULT)
    asked = stored.places.select("tree", "place", "doc_id", "leaf", "claimed")
    found = requested_paths(stored, asked)
    subroots = stored.trees.select(F.col("of").alias("_of"), "subroot")
    rows = found.select("tree", "doc_id", "leaf", proof_digest(F.col("path")).alias("proof_sha256"), folded(F.col("claimed"), F.col("path")).alias("folded_root"))
    rows = rows.join(broadcast_if_small(subroots), F.col("tree").eqNullSafe(F.col("_of")))
    root = F.lit(stored.root)
    return rows.select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))

