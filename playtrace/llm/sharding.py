"""Shards of nearly equal bytes by sampled splitters.

A sample is drawn in which a record's chance is in proportion to its size; quantiles of the sample's keys cut the key
space into many ranges, and records are dealt to ranges. The key is a hash of the text, then doc_id, and first only the
hash is cut, so equal texts lie in one range. Ranges that come out overfull are subdivided by a second sample along the
whole key: only there, where one text or a few hold more than a range should, equal texts may part. Ranges, whose
sizes are then counted exactly, go to shards in order, so that a shard's size is off by a part of one range.

Tasks see hashes, ids and sizes; texts are not moved. The driver sees the two samples (``SAMPLES`` keys expected,
whatever the table's size) and one count for each range.

Defined results: a null text is empty and has size 1, its bytes plus 1; a null doc_id sorts before all others;
repeated rows have equal keys and thus share a range; an empty table gives no rows; other columns stay as they are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playtrace.llm.common import settle

RANGES = 128  # a shard
SAMPLES = 40_000
LOWEST = -(1 << 63)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the key: hash of the text, place of the document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("hash"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LOWEST)).alias("place"))


def sample(keys: DataFrame, total: int, draws: int, columns: list[str]) -> pd.DataFrame:
    """Keys and weights of a size-weighted sample of about ``draws`` records; the draw hangs on the record alone."""
    chance = F.least(F.lit(1.0), F.col("size") * (draws / max(total, 1)))
    lot = F.pmod(F.xxhash64("hash", "place", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    weight = F.greatest(F.col("size").cast("double"), F.lit(max(total, 1) / draws))
    return keys.where(lot < chance).select(*columns, weight.alias("weight")).toPandas()


def quantiles(drawn: pd.DataFrame, columns: list[str], ranges: int) -> list[tuple]:
    """Keys at which the sample's weight passes each multiple of one range's share; ranges start at these keys."""
    drawn = drawn.sort_values(columns, kind="stable")
    sums = drawn["weight"].cumsum().to_numpy()
    if not len(sums):
        return []
    at = np.searchsorted(sums, sums[-1] * np.arange(1, ranges) / ranges)
    keys = drawn[columns].to_numpy(np.int64)[np.minimum(at, len(drawn) - 1)]  # without the weights: whole numbers stay exact
    return sorted({tuple(row) for row in keys.tolist()})


def range_of(splitters: list[tuple[int, int]]):
    """Column function of (hash, place): how many splitters are at or below the key."""
    heads = np.array([h for h, _ in splitters], np.int64)
    tails = np.array([p for _, p in splitters], np.int64)

    @F.pandas_udf("int")
    def place_in(hashes: pd.Series, places: pd.Series) -> pd.Series:
        h, p = hashes.to_numpy(), places.to_numpy()
        low, high = np.searchsorted(heads, h, "left"), np.searchsorted(heads, h, "right")
        found = low.copy()
        for first in np.unique(low[high > low]):  # keys with a splitter's own hash: their documents decide
            mine = (low == first) & (high > low)
            upto = high[mine][0]
            found[mine] = first + np.searchsorted(tails[first:upto], p[mine], "right")
        return pd.Series(found.astype(np.int32))

    return place_in


def filled(keys: DataFrame, splitters: list[tuple[int, int]]) -> tuple[DataFrame, pd.DataFrame]:
    """Keys with their range; bytes and rows of each range, one row a range."""
    dealt = keys.withColumn("range", range_of(splitters)("hash", "place"))
    return dealt, dealt.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).orderBy("range").toPandas()


def assigned(docs: DataFrame, shards: int = 16, ranges: int = RANGES, samples: int = SAMPLES) -> DataFrame:
    """Per record: doc_id, size, text_crc32, shard and slot, gapless from 0 within the shard."""
    keys = settle(keyed(docs), "keys")
    total = int(keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
    parts = shards * ranges
    splitters = [(h, LOWEST) for (h,) in quantiles(sample(keys, total, samples, ["hash"]), ["hash"], parts)]
    dealt, sizes = filled(keys, splitters)
    share = max(1.0, total / parts)
    over = sizes[sizes["bytes"] > 2 * share]
    if len(over):
        inside = dealt.where(F.col("range").isin(over["range"].tolist()))
        held = int(over["bytes"].sum())
        drawn = sample(inside, held, samples, ["range", "hash", "place"])
        for number, bytes_ in zip(over["range"], over["bytes"]):
            mine = drawn[drawn["range"] == number]
            splitters += quantiles(mine, ["hash", "place"], int(np.ceil(bytes_ / share)))
        dealt, sizes = filled(keys, sorted(set(splitters)))
    middle = sizes["bytes"].cumsum() - sizes["bytes"] / 2
    sizes["shard"] = np.minimum(shards - 1, (middle * shards / max(total, 1)).astype(int)) if len(sizes) else []
    sizes["first"] = sizes.groupby("shard")["rows"].cumsum() - sizes["rows"]
    plan = {int(r): (int(s), int(f)) for r, s, f in zip(sizes["range"], sizes["shard"], sizes["first"])}
    plan_rows = [(r, *v) for r, v in plan.items()] or [(0, 0, 0)]
    found = F.broadcast(docs.sparkSession.createDataFrame(plan_rows, "range int, shard int, first bigint"))  # one row a range
    within = Window.partitionBy("range").orderBy("hash", "place")
    slot = F.col("first") + F.row_number().over(within) - 1
    return dealt.join(found, "range").select("doc_id", "size", "text_crc32", "shard", slot.cast("bigint").alias("slot"))
