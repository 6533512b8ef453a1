"""Near-duplicates by banded MinHash with sequential Bayesian verification.

1. Every text becomes the set of its word shingles (64-bit hashes) and a signature of ``PERMUTATIONS`` minima. Texts of
   equal words fall together here, by a 128-bit digest: what follows sees each of them once, however many copies there are.
2. Signatures are cut into bands; texts that agree on a band share a bucket. ``ROWS`` is small, so that a pair at the
   threshold misses every bucket with a chance of a few in 10**8.
3. Within a bucket pairs are never listed. Each bucket names a centre, the member that meets most others over all its
   buckets, and members are compared with it. Links give components. A bucket whose members are then still in several
   components has its members outside the largest one compared with all of the other components, in blocks: two blocks
   meet in one task, which reports for each text one link to each component of the other block; a pair that shares several
   buckets is looked at in the first. So a group of n copies
   costs n comparisons when all are like the centre, and only the rest costs more; no pair of a bucket is left out.
4. A comparison looks at the signatures in batches: after each, the posterior chance (flat prior, so a beta
   distribution) that the similarity reaches the threshold decides; below ``MISS`` the pair is dropped. Survivors are
   verified on the full sets.

Defined results: words are runs other than white space, A-Z taken as a-z; a text of fewer words than a shingle is one shingle;
texts without words, empty or null, have an empty set and are linked with nothing; repeated rows are linked, as equal texts; ties of
doc_id and a null doc_id are handled by text: a component's id is its smallest doc_id, null only if it has none; other columns
are ignored by ``near_duplicates`` and stay as they are in ``one_of_each``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtrace.llm.common import settle
from playtrace.llm.components import components
from playtrace.llm.lexing import run_hashes, word_hashes

PERMUTATIONS = 128
ROWS = 4
BATCH = 16
MISS = 1e-6
BLOCK = 256

_DRAWN = np.random.default_rng(20240229).integers(0, 1 << 32, (2, PERMUTATIONS), dtype=np.uint64).astype(np.uint32)
FACTORS, OFFSETS = _DRAWN[0] | np.uint32(1), _DRAWN[1]


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text's word hashes."""
    if not len(words):
        return np.empty(0, np.uint64)
    return np.unique(run_hashes(words, min(width, len(words)), seed=width))


def signature(hashes: np.ndarray) -> np.ndarray:
    """Minima of the set under each permutation; a long set is taken in pieces."""
    least = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 2048):
        piece = short[at : at + 2048]
        np.minimum(least, (piece[None, :] * FACTORS[:, None] + OFFSETS[:, None]).min(axis=1), out=least)
    return least


@cache
def least_matches(percent: int) -> tuple[int, ...]:
    """For each number of compared minima: the fewest matches that leave a chance of ``MISS`` for the threshold.

    With a flat prior and m of n matches the similarity is Beta(m + 1, n - m + 1); that it is at least t has the
    chance that a binomial of n + 1 trials at t gives at most m.
    """
    t, bounds = percent / 100, []
    for n in range(PERMUTATIONS + 1):
        chance, m = 0.0, -1
        while chance < MISS and m < n:
            m += 1
            chance += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        bounds.append(m)
    return tuple(bounds)


def sketched(docs: DataFrame, width: int) -> DataFrame:
    """Per row: doc_id, copy (hash of the text), node (digest of the words), n_shingles, signature."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            nodes, counts, signatures = [], [], []
            for text in frame["text"]:
                words = word_hashes(text, lower=True)
                found = shingles(words, width)
                nodes.append(hashlib.blake2b(words.tobytes() + len(words).to_bytes(8, "little"), digest_size=16).digest())
                counts.append(len(found))
                signatures.append(signature(found).tobytes() if len(found) else None)
            yield frame[["doc_id", "copy"]].assign(node=nodes, n_shingles=counts, signature=signatures)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("copy")).mapInPandas(
        run, f"doc_id {kind}, copy bigint, node binary, n_shingles bigint, signature binary")


def buckets(distinct: DataFrame) -> DataFrame:
    """(bucket, band, node, size) of the buckets that two or more texts share."""
    bands = F.transform(F.sequence(F.lit(0), F.lit(PERMUTATIONS // ROWS - 1)), lambda b: F.xxhash64(
        b, F.substring(F.col("signature"), b * (4 * ROWS) + 1, F.lit(4 * ROWS))))
    each = distinct.select("node", F.posexplode(bands).alias("band", "bucket"))
    sizes = each.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    return each.join(sizes, "bucket")


def similar(probe: np.ndarray, block: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the block that survive all batches against one signature, and their matches."""
    bounds = least_matches(percent)
    alive, matches = np.arange(len(block)), np.zeros(len(block), np.int32)
    for at in range(0, PERMUTATIONS, BATCH):
        matches = matches + (block[alive, at : at + BATCH] == probe[at : at + BATCH]).sum(axis=1, dtype=np.int32)
        going = matches >= bounds[at + BATCH]
        alive, matches = alive[going], matches[going]
    return alive, matches


def first_band(probe: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The first band on which each row agrees with a signature; a pair is compared in that band's bucket only."""
    return (rows.reshape(len(rows), PERMUTATIONS // ROWS, ROWS) == probe.reshape(1, -1, ROWS)).all(axis=2).argmax(axis=1)


def _links_of(frame: pd.DataFrame, width: int, percent: int) -> list[tuple[bytes, bytes]]:
    """Verified links between the probes and the members of one block, the likeliest first."""
    probes, members = frame[frame["probe"]].reset_index(drop=True), frame[~frame["probe"]].reset_index(drop=True)
    if not len(probes) or not len(members):
        return []
    rows = lambda f: np.frombuffer(b"".join(f["signature"]), np.uint32).reshape(len(f), -1)
    one, other, sizes = rows(probes), rows(members), members["n_shingles"].to_numpy()
    sets: dict[bytes, np.ndarray] = {}

    def full(node: bytes, text: str) -> np.ndarray:
        if node not in sets:
            sets[node] = shingles(word_hashes(text, lower=True), width)
        return sets[node]

    found, nodes, texts, groups = [], members["node"].tolist(), members["text"].tolist(), members["root"].tolist()
    for at, probe in enumerate(probes.itertuples(index=False)):
        hits, matches = similar(one[at], other, percent)
        fits = (100 * np.minimum(sizes[hits], probe.n_shingles) >= percent * np.maximum(sizes[hits], probe.n_shingles))
        if probe.band >= 0:
            fits &= first_band(one[at], other[hits]) == probe.band
        hits, matches = hits[fits], matches[fits]
        linked = set()
        for k in hits[np.argsort(-matches, kind="stable")].tolist():
            if nodes[k] == probe.node or groups[k] is not None and (groups[k] in linked or groups[k] == probe.root):
                continue
            a, b = full(probe.node, probe.text), full(nodes[k], texts[k])
            both = len(np.intersect1d(a, b, assume_unique=True))
            if 100 * both >= percent * (len(a) + len(b) - both):
                found.append((probe.node, nodes[k]))
                linked.add(groups[k])
    return found


def compared(places: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) found in blocks; ``places`` has (block, band, node, probe, root), ``texts`` what a node says."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_links_of(frame, width, percent), columns=["a", "b"])

    full = places.join(texts, "node").select("block", "band", "node", "probe", "root", "text", "signature", "n_shingles")
    return full.groupBy("block").applyInPandas(run, "a binary, b binary")


def _star_places(members: DataFrame) -> DataFrame:
    """Blocks of a bucket centre and up to about ``BLOCK`` texts that share a bucket with it."""
    meets = members.groupBy("node").agg(F.sum("size").alias("meets"))
    centres = members.join(meets, "node").groupBy("bucket").agg(F.max(F.struct("meets", "node")).alias("centre"))
    edges = members.join(centres, "bucket").select(F.col("centre.node").alias("centre"), "node").where("centre != node").distinct()
    counts = edges.groupBy("centre").agg(F.count("*").alias("n"))
    placed = edges.join(counts, "centre").withColumn("part", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / BLOCK)))
    blocks = placed.select(F.xxhash64("centre", "part").alias("block"), "node", F.lit(False).alias("probe"))
    probes = placed.select("centre", "part").distinct().select(F.xxhash64("centre", "part").alias("block"), F.col("centre").alias("node"), F.lit(True).alias("probe"))
    return blocks.union(probes).withColumns({"root": F.lit(None).cast("binary"), "band": F.lit(-1)})


def _rest_places(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Blocks of members outside their bucket's largest component, each met with all members of the bucket."""
    named = members.where("size > 2").join(roots.select("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    tally = named.groupBy("bucket", "band", "root").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("who"))
    split = tally.groupBy("bucket", "band").agg(F.max(F.struct("n", "root")).alias("main"), F.count("*").alias("n_roots"), F.sum("n").alias("n"),
                                        F.bit_xor("who").alias("who")).where("n_roots > 1")
    split = split.groupBy("who", "n", "main").agg(F.min(F.struct("band", "bucket"))["bucket"].alias("bucket"))  # of equal buckets the first
    open_ = named.join(split.select("bucket", F.col("main.root").alias("main"), F.col("main.n").alias("n_main"), "n"), "bucket")
    part = lambda count: F.pmod(F.xxhash64("node"), F.greatest(F.lit(1), F.ceil(count / BLOCK)))
    sides = F.greatest(F.lit(1), F.ceil((F.col("n") - F.col("n_main")) / BLOCK)), F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK))
    upto = lambda count: F.sequence(F.lit(0).cast("bigint"), count.cast("bigint") - 1)
    probes = open_.where("root != main").select("bucket", "band", "node", "root", part(F.col("n") - F.col("n_main")).alias("i"), F.explode(upto(sides[1])).alias("j"), F.lit(True).alias("probe"))
    others = open_.select("bucket", "band", "node", "root", F.explode(upto(sides[0])).alias("i"), part(F.col("n")).alias("j"), F.lit(False).alias("probe"))
    return probes.union(others.select(probes.columns)).select(
        F.xxhash64("bucket", "i", "j").alias("block"), "node", "probe", "root", "band")


def _texts_of(active: DataFrame, rows: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text, signature, n_shingles): one text for each node; a hash of the text tells rows with one doc_id apart."""
    own = rows.select(F.col("node").alias("n"), F.col("doc_id").alias("d"), "copy").distinct()
    named = active.join(own, (F.col("node") == F.col("n")) & F.col("doc_id").eqNullSafe(F.col("d"))).select("node", "signature", "n_shingles", "d", "copy")
    known = docs.select(F.col("doc_id").alias("k"), F.xxhash64("text").alias("c"), "text")
    return named.join(known, (F.col("copy") == F.col("c")) & F.col("d").eqNullSafe(F.col("k"))).select("node", "text", "signature", "n_shingles").dropDuplicates(["node"])


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id and kept, true for the smallest doc_id of its component."""
    rows = settle(sketched(docs, width), "sketches")
    first = rows.where("n_shingles > 0").groupBy("node", "signature", "n_shingles").agg(F.min("doc_id").alias("doc_id"))
    distinct = settle(first, "distinct")
    members = settle(buckets(distinct), "buckets")
    texts = settle(_texts_of(members.select("node").distinct().join(distinct, "node"), rows, docs), "texts")
    links = settle(compared(_star_places(members), texts, width, percent), "links")
    roots = settle(components(links), "roots")
    more = settle(compared(_rest_places(members, roots), texts, width, percent), "links")
    if not more.isEmpty():
        roots = components(links.union(more))
    named = rows.groupBy("node").agg(F.min("doc_id").alias("least")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = named.join(least, "root").select("node", "component_id")
    return rows.join(ids, "node").select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without near-duplicates: of each component the row with the smallest doc_id stays, as it is.

    A row repeated under one doc_id stays once; rows without doc_id stay.
    """
    found = near_duplicates(docs, width, percent)
    gone = settle(found.where(~F.col("kept")).select("doc_id").distinct(), "gone")
    left = docs.join(gone, "doc_id", "left_anti")
    twice = settle(docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if twice.isEmpty():
        return left
    return left.join(twice, "doc_id", "left_anti").union(left.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
