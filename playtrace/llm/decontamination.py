"""Benchmark items inside documents: a MinHash containment search by item size, then exact containment, in DataFrame expressions.

A signature of a long document says nothing of a short item in it: 30 of 20,000 shingles are a similarity of 0.0015, which
no affordable number of hashes sees. Containment of an item only needs the item's own smallest hashes: each of them is a
random shingle of the item, so the share of them found in a document estimates how much of the item it contains. Items
are put into size classes; a class of items with up to ``SKETCH`` shingles keeps all of them, larger classes keep the
``SKETCH`` smallest hashes. A document is a candidate if it holds at least as many sketch hashes as an item contained at the
threshold would show but for a chance of ``MISS``. Candidates are then verified on all shingles, as strings.

Sketches go to the tasks if the written table is small; otherwise the join shuffles hashes. Texts of candidates only are
read again.

Words are those of ``common.words_of``, A-Z taken as a-z; shingles are five words. Defined results: null or empty texts
and items, and items of fewer than five words, have no shingles and match nothing; repeated documents are found alike, one
row for each (doc_id, item_id); documents or items without an id, and empty tables, give no rows; items repeated
under one id are joined into one set; other columns are ignored.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtrace.llm.common import ascii_lower, broadcast_if_small, settle, words_of

WIDTH = 5
SKETCH = 32
MISS = 1e-9


def shingle_hashes(text: Column, width: int = WIDTH) -> Column:
    codes = F.transform(words_of(ascii_lower(F.coalesce(text, F.lit("")))), lambda w: F.xxhash64(w))
    return _runs(codes, width, lambda run: F.xxhash64(run))


def shingle_texts(text: Column, width: int = WIDTH) -> Column:
    return _runs(words_of(ascii_lower(F.coalesce(text, F.lit("")))), width, lambda run: F.array_join(run, " "))


def _runs(items: Column, width: int, of) -> Column:
    """``of`` each run of ``width`` neighbours; the array is bound once, by a one-element transform."""
    each = lambda a: F.transform(
        F.filter(F.sequence(F.lit(1), F.greatest(F.size(a) - (width - 1), F.lit(1))), lambda i: i <= F.size(a) - (width - 1)),
        lambda i: of(F.slice(a, i, width)))
    return F.flatten(F.transform(F.array(items), each))


def needed_hits(sketch: int, size: int, threshold_percent: int) -> int:
    """Fewest sketch hashes that a document containing the item at the threshold shows, but for a chance of ``MISS``.

    A sketch of the whole item needs exactly the threshold; a sample of it follows the binomial (the true one is
    hypergeometric, which is narrower).
    """
    if size <= sketch:
        return max(1, -(-threshold_percent * size // 100))
    p, chance = threshold_percent / 100, 0.0
    for k in range(sketch + 1):
        chance += comb(sketch, k) * p**k * (1 - p) ** (sketch - k)
        if chance > MISS:
            return max(1, k)
    return sketch


def item_sketches(items: DataFrame, threshold_percent: int = 80) -> DataFrame:
    """item_id, n_item, hash, needed: one row for each sketch hash."""
    each = items.where(F.col("item_id").isNotNull()).select("item_id", F.explode(shingle_hashes(F.col("text"))).alias("hash")).distinct()
    sets = each.groupBy("item_id").agg(F.array_sort(F.collect_list("hash")).alias("hashes"))  # one item's shingles
    sets = sets.select("item_id", F.size("hashes").alias("n_item"), F.slice("hashes", 1, SKETCH).alias("sketch"))
    sampled = needed_hits(SKETCH, SKETCH + 1, threshold_percent)
    exact = F.ceil(F.col("n_item") * threshold_percent / 100).cast("int")
    needed = F.when(F.col("n_item") <= SKETCH, F.greatest(exact, F.lit(1))).otherwise(F.lit(sampled))
    return sets.select("item_id", "n_item", needed.alias("needed"), F.explode("sketch").alias("hash"))


def leaks(docs: DataFrame, items: DataFrame, threshold_percent: int = 80) -> DataFrame:
    """doc_id, item_id, n_item_shingles, n_shared: items of whose shingles at least the threshold lies in a document."""
    sketches = broadcast_if_small(settle(item_sketches(items, threshold_percent), "sketches"))
    known = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    hashes = known.select("doc_id", F.explode(shingle_hashes(F.col("text"))).alias("hash"))
    hits = hashes.join(sketches, "hash").groupBy("doc_id", "item_id").agg(
        F.count_distinct("hash").alias("hits"), F.first("needed").alias("needed"))
    candidates = settle(hits.where("hits >= needed").select("doc_id", "item_id"), "candidates")
    item_sets = items.where(F.col("item_id").isNotNull()).select("item_id", F.explode(shingle_texts(F.col("text"))).alias("shingle")).distinct()
    sizes = item_sets.groupBy("item_id").agg(F.count("*").alias("n_item_shingles"))
    wanted = candidates.select("doc_id").distinct()
    texts = known.join(wanted, "doc_id").select("doc_id", F.explode(shingle_texts(F.col("text"))).alias("shingle"))
    shared = (texts.join(item_sets, "shingle").join(candidates, ["doc_id", "item_id"])
              .groupBy("doc_id", "item_id").agg(F.count_distinct("shingle").alias("n_shared")))
    return shared.join(sizes, "item_id").where(100 * F.col("n_shared") >= threshold_percent * F.col("n_item_shingles")).select(
        "doc_id", "item_id", F.col("n_item_shingles").cast("bigint").alias("n_item_shingles"), F.col("n_shared").cast("bigint").alias("n_shared"))


def without_leaks(docs: DataFrame, items: DataFrame, threshold_percent: int = 80) -> DataFrame:
    """Documents that contain no item; columns as they are, rows without doc_id stay."""
    found = settle(leaks(docs, items, threshold_percent).select("doc_id").distinct(), "leaks")
    return docs.join(found, "doc_id", "left_anti")
