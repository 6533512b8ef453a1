"""Language of a text by multilingual mixture inference.

Training counts hashed character n-grams of labelled texts per language, in Spark: every map task counts its distinct words
and their n-grams, the counts are added by (language, bucket), and the model that is broadcast has a fixed number of
buckets for each language. A word's likelihood in a language is the product of its n-grams' smoothed likelihoods, tempered
by the number of n-gram lengths, as each letter is counted once in each.

A text is a mixture: expectation-maximisation finds the share of words that each language wrote. Languages are then taken
in order of their shares into nested sets; a set is fitted again by itself, and grows while the likelihood gains more than
the penalty of one more share (a multiple of half the logarithm of the number of words). The language with the largest share
of the chosen set is the prediction, its share the score.

Nulls: a text that is null or has no letter is ``und`` with score 0; a null language is not trained on, and a null id counts
as not held out. Empty texts have no letter. Texts of any length are taken whole, as their distinct words. Ties go to the language
that comes first in byte order. Repeated rows count as often as they stand there. An empty table gives no rows; without
any labelled text every prediction is ``und``. The model has ``BUCKETS`` numbers for each language of the labels. Languages seen only in texts without letters are never predicted. Further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LENGTHS = (1, 2, 3)
BUCKETS = 1 << 16
SMOOTHING = 0.5
PENALTY = 4.0
ROUNDS = 12
PART_BYTES = 8 << 20
HELD_LANGUAGES = 64  # counted at a time in one task; the counts of more are handed on earlier
UNKNOWN = "und"


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def checksum_is(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the decimal id leaves this remainder; a null id never does."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


# --- words and their n-grams ---


def _parts(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Runs of texts of about ``PART_BYTES``, with the place of their first; a single longer text is a run of its own."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        done = sizes[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(sizes, done + PART_BYTES, "right")))
        yield at, texts.slice(at, upto - at)
        at = upto


_LETTER = np.ones(256, bool)
_LETTER[:128] = [chr(c).isalpha() for c in range(128)]


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """For each word of the texts its text and its place among the distinct words, and these; ASCII that is no letter parts words."""
    lowered = pc.utf8_lower(pc.fill_null(texts, ""))
    joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(lowered)], pa.int64()), lowered), "\n")[0].as_buffer()
    raw = np.frombuffer(joined, np.uint8)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = _LETTER[raw]
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    text_ends = np.cumsum(pc.binary_length(lowered).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    owner = np.searchsorted(text_ends, starts, "right")
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    letters = raw[inside[1:-1].astype(bool)]
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
    return owner, coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def _gram_buckets(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of every n-gram of the bytes of each word, which stand between two marks."""
    lengths = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(lengths):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    word = np.repeat(np.arange(len(words)), lengths + 1)
    marked = np.full(len(word) + 1, 10, np.uint64)
    marked[np.arange(lengths.sum()) + np.repeat(np.arange(len(words)), lengths) + 1] = np.frombuffer(words.buffers()[2], np.uint8)[: lengths.sum()]
    owners, buckets = [], []
    code = np.zeros(len(marked), np.uint64)
    for n in LENGTHS:
        # A gram of n bytes that starts at i belongs to i's word; marks of both sides count as part of it, longer overhangs do not.
        code = marked if n == 1 else code[:-1] * np.uint64(257) + marked[n - 1:]
        inner = np.ones(len(code), bool)
        for k in range(1, n - 1):
            inner &= marked[k : k + len(code)] != 10
        if n == 1:
            inner &= marked != 10
        at = np.flatnonzero(inner)
        mixed = (code[at] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        buckets.append((mixed >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64))
        owners.append(word[at])
    return np.concatenate(owners), np.concatenate(buckets)


# --- training ---


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, bucket, n) over all rows of ``labelled`` (lang, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).dictionary_encode(), batch.column(1)
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                for _, part in _parts(texts.filter(pc.equal(langs.indices, code))):
                    _, words, distinct = _words(part)
                    owner, bucket = _gram_buckets(distinct)
                    often = np.bincount(words, minlength=len(distinct))
                    found = np.bincount(bucket, weights=often[owner], minlength=BUCKETS).astype(np.int64)
                    totals[lang] = totals[lang] + found if lang in totals else found
            if len(totals) > HELD_LANGUAGES:
                yield from rows_of(totals)
                totals = {}
        yield from rows_of(totals)

    def rows_of(totals: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, found in totals.items():
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(found[at])], ["lang", "bucket", "n"])

    return labelled.select("lang", "text").mapInArrow(count, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


@dataclass
class LanguageModel:
    """Log likelihood of each bucket (rows) in each language (columns)."""

    langs: list[str]
    table: np.ndarray


def fitted(labelled: DataFrame) -> LanguageModel:
    """Model of all rows of ``labelled`` (lang, text); null languages and texts without letters are left out.

    The driver gets ``BUCKETS`` numbers for each language at most.
    """
    usable = labelled.filter(F.col("lang").isNotNull() & has_letter(F.col("text")))
    rows = gram_counts(usable).toArrow()
    names = sorted(set(rows["lang"].to_pylist()), key=lambda s: s.encode())
    counts = np.zeros((BUCKETS, len(names)))
    column = pc.index_in(rows["lang"], pa.array(names, pa.string())).to_numpy()
    counts[rows["bucket"].to_numpy(), column] = rows["n"].to_numpy()
    table = np.log((counts + SMOOTHING) / (counts.sum(0) + SMOOTHING * BUCKETS))
    return LanguageModel(names, table.astype(np.float32))


# --- mixtures ---


def _mixture(text: np.ndarray, often: np.ndarray, like: np.ndarray, texts: int, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shares, log likelihood) of each text's mixture over its ``allowed`` languages.

    ``text``, ``often`` and ``like`` have one row for each distinct word of a text, sorted by text; ``like`` is relative to
    the word's best language, which leaves out the same amount in every set.
    """
    shares = allowed / allowed.sum(1, keepdims=True)
    starts = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    total = np.add.reduceat(often, starts)[:, None]
    for _ in range(ROUNDS):
        weight = shares[text] * like
        weight *= (often / np.maximum(weight.sum(1), 1e-300))[:, None]
        shares = np.add.reduceat(weight, starts, axis=0) / total
    chance = np.maximum((shares[text] * like).sum(1), 1e-300)
    return shares, np.add.reduceat(often * np.log(chance), starts)


def chosen_mixtures(text: np.ndarray, often: np.ndarray, like: np.ndarray, texts: int) -> np.ndarray:
    """Shares of the languages of each text's chosen set; every text 0..texts-1 has at least one word."""
    langs = like.shape[1]
    shares, _ = _mixture(text, often, like, texts, np.ones((texts, langs)))
    order = np.argsort(-shares, axis=1, kind="stable")
    size = np.bincount(text, weights=often, minlength=texts)
    cost = PENALTY * 0.5 * np.log(size + 1)
    result = np.zeros((texts, langs))
    # One language: the best by likelihood, no mixture needed.
    alone = np.zeros((texts, langs))
    starts = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    alone = np.add.reduceat(often[:, None] * np.log(np.maximum(like, 1e-300)), starts, axis=0)
    first = alone.argmax(1)
    result[np.arange(texts), first] = 1.0
    best = alone.max(1)
    open_ = np.arange(texts)
    for members in range(2, langs + 1):
        allowed = np.zeros((len(open_), langs))
        np.put_along_axis(allowed, order[open_, :members], 1.0, axis=1)
        renumbered = np.full(texts, -1)
        renumbered[open_] = np.arange(len(open_))
        rows = np.flatnonzero(renumbered[text] >= 0)
        found, reached = _mixture(renumbered[text[rows]], often[rows], like[rows], len(open_), allowed)
        better = reached > best[open_] + cost[open_]
        result[open_[better]] = found[better]
        best[open_[better]] = reached[better]
        open_ = open_[better]
        if not len(open_):
            break
    return result


def mixtures_of(texts: pa.Array, model: LanguageModel) -> np.ndarray:
    """Shares of each language in each text; all 0 where a text has no word."""
    out = np.zeros((len(texts), len(model.langs)))
    for at, part in _parts(texts):
        owner, words, distinct = _words(part)
        if not len(owner):
            continue
        gram_word, bucket = _gram_buckets(distinct)
        score = np.empty((len(distinct), len(model.langs)))
        for lang in range(len(model.langs)):
            score[:, lang] = np.bincount(gram_word, weights=model.table[bucket, lang], minlength=len(distinct))
        score /= len(LENGTHS)
        like = np.exp(score - score.max(1, keepdims=True))
        pairs, often = np.unique(owner * np.int64(len(distinct)) + words, return_counts=True)
        text, word = pairs // len(distinct), pairs % len(distinct)
        present, text = np.unique(text, return_inverse=True)
        out[at + present] = chosen_mixtures(text, often.astype(float), like[word], len(present))
    return out


def predicted(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` (doc_id, text) with lang_pred, score and the chosen languages' ``shares``."""
    if not model.langs:
        return docs.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.create_map().cast("map<string,double>").alias("shares"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = pa.array(model.langs, pa.string())
        for batch in batches:
            shares = mixtures_of(batch.column(1), model)
            best = shares.argmax(1)
            score = shares[np.arange(len(shares)), best] if len(shares) else np.empty(0)
            known = (score > 0) & batch.column(2).to_numpy(zero_copy_only=False)
            text, lang = np.nonzero(shares * known[:, None])
            offsets = np.searchsorted(text, np.arange(len(shares) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pc.if_else(pa.array(known), names.take(pa.array(best)), UNKNOWN), pa.array(np.where(known, np.clip(score, 0, 1), 0.0)),
                pa.MapArray.from_arrays(pa.array(offsets), names.take(pa.array(lang)), pa.array(shares[text, lang]))],
                ["doc_id", "lang_pred", "score", "shares"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", has_letter(F.col("text")).alias("lettered"))
    return rows.mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double, shares map<string,double>")


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, shares; learned from the labelled rows that are not held out."""
    held_out = checksum_is(F.col("doc_id"), 3, 1)
    model = fitted(docs.filter(~held_out).select("lang", "text"))
    return predicted(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "shares")
