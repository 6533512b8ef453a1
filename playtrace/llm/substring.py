"""Repeated passages of ``length`` words, found by anchors at difference-cover positions.

A difference cover of a period holds, for any two positions, a common shift below the period that moves both onto the cover.
So of two equal passages of ``length`` words, some pair of aligned places at most ``PERIOD - 1`` words in lies on the cover in both
texts, and the ``length - PERIOD + 1`` words from there on are equal. Only windows of that many words at cover positions
(anchors, 4 in 13 words) are hashed and counted; a passage none of whose anchors occurs twice has no twin.

Anchors seen twice are then extended: every passage of ``length`` words around one is hashed (128 bits) and the smallest
document of each is found. Aggregation does both, combining before the shuffle, so a passage in a third of all
documents costs a row a task and no list of occurrences is ever built. What goes back to a document is the anchors that
occur once in the corpus and the passages it is the first to say; everything else in reach of a repeated anchor goes.

Defined results: a null or empty text has no words; texts of fewer than ``length`` words lose nothing; within one document
the earliest start stays; rows that share a doc_id count as one document and take nothing from each other; documents without
doc_id come last, together as one document; other columns are ignored by ``marked`` and stay as they are in ``cut``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtrace.llm.common import settle
from playtrace.llm.lexing import run_hashes, word_hashes

LENGTH = 20
PERIOD = 13
COVER = (0, 1, 3, 9)  # every difference modulo 13 occurs among these
LAST = (1 << 63) - 1
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def anchor_places(n_words: int, width: int) -> np.ndarray:
    """Places of a text's anchors: on the cover, with ``width`` words to follow."""
    if n_words < width:
        return np.empty(0, np.int64)
    places = np.arange(n_words - width + 1)
    return places[np.isin(places % PERIOD, COVER)]


def candidate_starts(n_words: int, single: np.ndarray, length: int) -> np.ndarray:
    """Starts of passages that hold an anchor not in ``single``, the places of anchors that occur once."""
    width, n = length - PERIOD + 1, n_words - length + 1
    if n <= 0:
        return np.empty(0, np.int64)
    places, alone = anchor_places(n_words, width), np.zeros(n_words, bool)
    alone[single[single < n_words]] = True
    repeated = places[~alone[places]]
    if not len(repeated):
        return np.empty(0, np.int64)
    begins = np.bincount(np.maximum(repeated - (PERIOD - 1), 0), minlength=n_words + 1)
    ends = np.bincount(repeated + 1, minlength=n_words + 1)
    return np.flatnonzero(np.cumsum((begins - ends)[:n]))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("doc"), "text")


def _anchors(docs: DataFrame, length: int) -> DataFrame:
    width = length - PERIOD + 1

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids, places, hashes, held = [], [], [], 0
            for doc, text in zip(frame["doc"], frame["text"]):
                words = word_hashes(text)
                at = anchor_places(len(words), width)
                ids.append(np.full(len(at), doc, np.int64))
                places.append(at.astype(np.int32))
                hashes.append(run_hashes(words, width)[at].view(np.int64))
                held += len(at)
                if held > 500_000:
                    yield pd.DataFrame({"doc": np.concatenate(ids), "place": np.concatenate(places), "hash": np.concatenate(hashes)})
                    ids, places, hashes, held = [], [], [], 0
            if held:
                yield pd.DataFrame({"doc": np.concatenate(ids), "place": np.concatenate(places), "hash": np.concatenate(hashes)})

    return _keyed(docs).mapInPandas(run, "doc bigint, place int, hash bigint")


def _passages(words: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """128-bit hashes of the passages at ``starts``, as two columns."""
    if not len(starts):
        return np.empty((0, 2), np.int64)
    if 4 * len(starts) < len(words):  # few passages: hash those alone
        at = starts[:, None] + np.arange(length)
        return np.stack([run_hashes(words[at].T, length, seed)[0].view(np.int64) for seed in (1, 2)], axis=1)
    return np.stack([run_hashes(words, length, seed)[starts].view(np.int64) for seed in (1, 2)], axis=1)


def _singles(value) -> np.ndarray:
    return np.sort(np.asarray(value, np.int64)) if value is not None else np.empty(0, np.int64)


def _candidates(joined: DataFrame, length: int) -> DataFrame:
    """Each passage near a repeated anchor once for each document that holds it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids, hashes, held = [], [], 0
            for doc, text, single in zip(frame["doc"], frame["text"], frame["single"]):
                words = word_hashes(text)
                found = _passages(words, candidate_starts(len(words), _singles(single), length), length)
                if len(found):
                    found = found[np.unique(found[:, 0], return_index=True)[1]]  # within one text half the hash tells
                    ids.append(np.full(len(found), doc, np.int64))
                    hashes.append(found)
                    held += len(found)
                if held > 500_000:
                    yield table(ids, hashes)
                    ids, hashes, held = [], [], 0
            if held:
                yield table(ids, hashes)

    def table(ids: list[np.ndarray], hashes: list[np.ndarray]) -> pd.DataFrame:
        both = np.concatenate(hashes)
        return pd.DataFrame({"doc": np.concatenate(ids), "h1": both[:, 0], "h2": both[:, 1]})

    return joined.mapInPandas(run, "doc bigint, h1 bigint, h2 bigint")


def removed_words(text: str | None, single, own, length: int) -> np.ndarray:
    """Which words of a text go: those of repeated passages that an earlier place says first."""
    words = word_hashes(text)
    starts = candidate_starts(len(words), _singles(single), length)
    steps = np.zeros(len(words) + 1, np.int32)
    if len(starts):
        codes = _passages(words, starts, length)
        _, first = np.unique(codes[:, 0], return_index=True)
        stays = np.zeros(len(starts), bool)
        stays[first] = True  # the earliest in this document, and this document the earliest of all
        stays &= np.isin(codes[:, 0], np.asarray([] if own is None else own, np.int64))
        gone = starts[~stays]
        np.add.at(steps, gone, 1)
        np.add.at(steps, gone + length, -1)
    return np.cumsum(steps[:-1]) > 0


def _prepared(docs: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """(doc, single): places of anchors that occur once; (doc, own): passages that the document is the first to say."""
    counted = _anchors(docs, length).groupBy("hash").agg(F.count("*").alias("n"), F.min("doc").alias("doc"), F.min("place").alias("place"))
    alone = counted.where("n = 1").groupBy("doc").agg(F.collect_list("place").alias("single"))
    doubled = settle(_keyed(docs).groupBy("doc").count().where("count > 1").select("doc"), "doubled")
    singles = settle(alone.join(doubled, "doc", "left_anti"), "singles")  # places of two texts under one id would mix
    joined = _keyed(docs).join(singles, "doc", "left")
    firsts = _candidates(joined, length).groupBy("h1", "h2").agg(F.min("doc").alias("doc"))
    return singles, settle(firsts.groupBy("doc").agg(F.collect_list("h1").alias("own")), "firsts")


def marked(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 of the words that stay, joined by single spaces."""
    singles, firsts = _prepared(docs, length)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            counts, gone, digests = [], [], []
            for text, single, own in zip(frame["text"], frame["single"], frame["own"]):
                words = WORD.findall(text or "")
                out = removed_words(text, single, own, length)
                counts.append(len(words))
                gone.append(int(out.sum()))
                kept = [w for w, drop in zip(words, out.tolist()) if not drop] if out.any() else words
                digests.append(hashlib.sha256(" ".join(kept).encode()).hexdigest())
            yield pd.DataFrame({"doc_id": frame["doc_id"], "n_words": counts, "n_removed": gone, "kept_sha256": digests})

    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("doc"))
    joined = keyed.join(singles, "doc", "left").join(firsts, "doc", "left")
    return joined.select("doc_id", "text", "single", "own").mapInPandas(
        run, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string")


def cut(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` whose texts lost their repeated words and the white space before them; all rows and columns stay."""
    singles, firsts = _prepared(docs, length)

    @F.pandas_udf("string")
    def shortened(texts: pd.Series, single: pd.Series, own: pd.Series) -> pd.Series:
        out = []
        for text, s, o in zip(texts, single, own):
            gone = removed_words(text, s, o, length)
            if gone.any():
                spans = [m.span() for m in WORD.finditer(text)]
                ends = [0] + [e for _, e in spans]
                text = "".join(text[ends[i] : ends[i + 1]] for i in np.flatnonzero(~gone)) + text[ends[-1] :]
            out.append(text)
        return pd.Series(out, dtype=object)

    whole = docs.select(F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("__row"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("doc"))
    joined = whole.join(singles, "doc", "left").join(firsts, "doc", "left")
    new = shortened(F.col("__row")["text"], F.col("single"), F.col("own"))
    return joined.select(*[(new if n == "text" else F.col("__row")[n]).alias(n) for n in docs.columns])
