"""Phrases that stand together more often than by chance, by stripes.

A stripe belongs to a prefix (0 to 4 words) and counts which word follows it. Map tasks build partial stripes of their texts in
numpy, Spark adds them element by element. From the stripes of one length come all three figures that the score needs: each
entry is the frequency of an extension, the sum of all entries (with one for *any other word or no word*) is the frequency of the
prefix, and the largest entry tells whether an extension is as frequent as the prefix and so subsumes it. (An extension on the left is
an entry of another prefix; entries are grouped by their last words for it.)

Prefixes grow one word a pass. Only phrases with both parts, all but the last word and all but the first, frequent can be frequent
themselves, so entries whose parts are rare join the entry for *any other*. What is frequent is told to the tasks by a Bloom
filter of a fixed number of bits: its mistakes let rare phrases through to the exact count, never lose any. Words are compared as text, not
as hashes. The partial stripes of a piece of text are dealt over ``PARTS`` by a hash of the prefix, and those of a part travel as one row: each prefix
once, all entries (number of the prefix, next word, count) side by side. Stripes of the empty prefix and of prefixes that occur ``HOT`` times or
more may be fed by every task and hold a large vocabulary; they are dealt over up to ``STRIPE_PARTS`` of the parts by a hash of the next word, and
entries are added as rows before they are put together, so no task holds a whole one.

Everything is per language. Null texts and texts without words add nothing, null languages are ``und``, texts of any length are read
piece by piece, repeated rows count each time, ties are settled by the order of the result. An empty table gives no rows. Further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playtrace.llm.common import settle
from playtrace.llm.lexing import mix

LONGEST = 5
OFTEN = 100
BLOOM_BITS = 1 << 26
BLOOM_HASHES = 3
HOT = 100_000
HOT_BITS = 1 << 22
STRIPE_PARTS = 64
PARTS = 4096
PART_BYTES = 8 << 20
UNKNOWN = "und"
REST = ""  # stands for any other next word and for none; no word is empty

_LOWER = bytes(c + 32 if 65 <= c < 91 else c for c in range(256))
_WORD, _BLANK, _BREAK = 0, 1, 2  # in a word, between words, at the end of a piece
_KIND = bytes(_BREAK if c in b".,;:!?\n\v\f\r" else _BLANK if c in b" \t" else _WORD for c in range(256))

# --- a set of phrases in a fixed number of bits ---


def text_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of distinct words (binary); equal in every task. Clashes only let more through to the exact count."""
    words = words.cast(pa.large_binary())
    _, bounds, data = words.buffers()
    offsets = np.frombuffer(bounds, np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
    sizes = np.diff(offsets)
    letters = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if len(words) and data else np.empty(0, np.uint8)
    place = np.arange(len(letters)) - np.repeat(offsets[:-1] - offsets[0], sizes)
    sums = np.r_[np.zeros(1, np.uint64), np.cumsum(mix((letters.astype(np.uint64) << np.uint64(32)) + place.astype(np.uint64)))]
    ends = offsets - offsets[0]
    return mix(sums[ends[1:]] - sums[ends[:-1]] + sizes.astype(np.uint64))


def extended(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase from its prefix's hash and its last word's."""
    return mix(prefix * np.uint64(0x9E3779B97F4A7C15) + word)


def bit_places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    step = mix(hashes ^ np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
    return [((hashes + np.uint64(k) * step) & np.uint64(bits - 1)).astype(np.int64) for k in range(BLOOM_HASHES)]


def holds(bloom: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bits = len(bloom) * 64
    found = np.ones(len(hashes), bool)
    for at in bit_places(hashes, bits):
        found &= (bloom[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0
    return found


def phrase_hashes(langs: pa.Array, phrases: pa.Array) -> np.ndarray:
    """Hash of each phrase of its language, word by word as the tasks extend it."""
    split = pc.split_pattern(phrases, " ")
    flat = pc.list_flatten(split).dictionary_encode()
    words = text_hashes(flat.dictionary.cast(pa.binary()))[flat.indices.to_numpy(zero_copy_only=False)]
    sizes = pc.list_value_length(split).to_numpy(zero_copy_only=False)
    coded = langs.dictionary_encode()
    hashes = text_hashes(coded.dictionary.cast(pa.binary()))[coded.indices.to_numpy(zero_copy_only=False)]
    first = np.cumsum(sizes) - sizes
    for k in range(int(sizes.max(initial=0))):
        longer = np.flatnonzero(sizes > k)
        hashes[longer] = extended(hashes[longer], words[first[longer] + k])
    return hashes


def bloom_of(phrases: DataFrame, bits: int) -> np.ndarray:
    """Bits of all ``phrases`` (lang, phrase). The driver gets at most ``bits`` / 64 rows, whatever the number of phrases."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate(bit_places(phrase_hashes(batch.column(0), batch.column(1)), bits)))
            block, start = np.unique(at >> 6, return_index=True)
            masks = np.left_shift(np.uint64(1), (at & 63).astype(np.uint64))
            joint = np.bitwise_or.reduceat(masks, start) if len(at) else masks
            yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(joint.view(np.int64))], ["block", "mask"])

    rows = phrases.select("lang", "phrase").mapInArrow(places, "block bigint, mask bigint").groupBy("block").agg(F.bit_or("mask").alias("mask")).toArrow()
    bloom = np.zeros(bits // 64, np.uint64)
    bloom[rows["block"].to_numpy()] = rows["mask"].to_numpy().view(np.uint64)
    return bloom


# --- partial stripes of some texts ---


def _breaks(raw: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.frombuffer(raw.tobytes().translate(_KIND), np.uint8) == _BREAK)


def _joined(texts: pa.Array) -> Iterator[np.ndarray]:
    """Bytes of the texts, a line break between two, about ``PART_BYTES`` at a time and cut only where a piece ends."""
    held, size = [], 0
    for text in texts:
        raw = np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid else np.empty(0, np.uint8)
        at = 0
        while len(raw) - at > PART_BYTES:
            ends = _breaks(raw[at : at + PART_BYTES])
            if not len(ends):  # no end of a piece so far: up to the next one, however far
                later = _breaks(raw[at + PART_BYTES :])
                ends = later[:1] + PART_BYTES if len(later) else np.array([len(raw) - at - 1])
            yield raw[at : at + ends[-1] + 1]
            at += int(ends[-1]) + 1
        held += [raw[at:], np.array([10], np.uint8)]
        size += len(raw) - at + 1
        if size >= PART_BYTES:
            yield np.concatenate(held)
            held, size = [], 0
    if held:
        yield np.concatenate(held)


def _pieces(raw: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(distinct-word number of each word, distinct words, words left in its piece from each word on)."""
    plain = raw.tobytes()
    kind = np.frombuffer(plain.translate(_KIND), np.uint8)
    inside = np.zeros(len(raw) + 2, bool)
    np.equal(kind, _WORD, out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    letters = np.frombuffer(plain.translate(_LOWER), np.uint8)[inside[1:-1]]
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
    piece = np.cumsum(kind == _BREAK, dtype=np.int32)[starts]
    last = np.flatnonzero(np.r_[piece[1:] != piece[:-1], True]) if len(piece) else np.empty(0, np.int64)
    left = np.repeat(last, np.diff(last, prepend=-1)) - np.arange(len(starts)) + 1
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, left


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each value among the distinct ones, and these in order of appearance."""
    coded = pa.array(values).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_numpy(zero_copy_only=False)


def partial_stripes(lang: str, texts: pa.Array, words: int, known: list[np.ndarray], hot: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Stripes of the prefixes of ``words`` words in ``texts``, a row for each part: (lang, part, prefixes, owners, nexts, counts).

    Entry k of a row counts ``counts[k]`` times the next word ``nexts[k]`` after prefix ``prefixes[owners[k]]``. ``known`` holds the frequent words and the frequent phrases of ``words`` words, ``hot`` the prefixes whose stripes are dealt
    over parts (without it all are).
    """
    seed = text_hashes(pa.array([lang.encode()], pa.binary()))[0]
    for raw in _joined(texts):
        word, distinct, left = _pieces(raw)
        if not len(word):
            continue
        hashed = text_hashes(distinct)
        if words == 0:
            at, following, prefix = np.arange(len(word)), word, None
        else:
            at, following, prefix = _frequent_prefixes(word, left, hashed, seed, words, known)
        # Exact numbers for prefixes: each word in turn makes the number of the prefix so far one of a smaller range.
        number = word[at] if words else np.zeros(len(at), np.int64)
        for k in range(1, words):
            number, _ = _numbered(number * len(distinct) + word[at + k])
        code, pair = _numbered(number * np.int64(len(distinct) + 1) + following + 1)
        often = np.bincount(code, minlength=len(pair))
        sample = np.empty(len(pair), np.int64)
        sample[code] = at
        owner, then = pair // (len(distinct) + 1), pair % (len(distinct) + 1) - 1
        lead = np.full(len(pair), seed, np.uint64)
        if words:
            lead[code] = prefix
        share = np.where(then >= 0, hashed[then] % np.uint64(STRIPE_PARTS), np.uint64(0))
        if hot is not None:
            share *= holds(hot, lead)
        part = (extended(lead, share) % np.uint64(PARTS)).astype(np.int64)
        span = owner.max(initial=0) + 1
        order = np.argsort(part * span + owner, kind="stable")
        often, sample, owner, then, part = often[order], sample[order], owner[order], then[order], part[order]
        rows = _begins(part)
        stems = _begins(part * span + owner)
        first = np.searchsorted(stems, rows)  # first prefix of each row
        place = np.repeat(np.arange(len(stems)), np.diff(stems, append=len(part))) - np.repeat(first, np.diff(rows, append=len(part)))
        bounds = pa.array(np.r_[rows, len(part)].astype(np.int32))
        nexts = distinct.take(pa.array(np.maximum(then, 0))).cast(pa.binary())
        nexts = pc.if_else(pa.array(then >= 0), nexts, pa.scalar(REST.encode(), pa.binary())).cast(pa.string())
        places = sample[stems]
        if words:
            parts = [distinct.take(pa.array(word[places + k])).cast(pa.binary()).cast(pa.string()) for k in range(words)]
            prefixes = pc.binary_join_element_wise(*parts, " ")
        else:
            prefixes = pa.array([""] * len(places), pa.string())
        yield pa.RecordBatch.from_arrays([
            pa.array([lang] * len(rows), pa.string()), pa.array(part[rows].astype(np.int32)),
            pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[first, len(stems)].astype(np.int32)), prefixes), "\n"),
            pa.ListArray.from_arrays(bounds, pa.array(place.astype(np.int32))),
            pc.binary_join(pa.ListArray.from_arrays(bounds, nexts), " "), pa.ListArray.from_arrays(bounds, pa.array(often.astype(np.int32)))],
            ["lang", "part", "prefixes", "owners", "nexts", "counts"])


def _begins(groups: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    return np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if len(groups) else np.empty(0, np.int64)


def _frequent_prefixes(word, left, hashed, seed, words: int, known: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of prefixes that are frequent, the word after each (-1 where the longer phrase ends or cannot be frequent), and their hashes."""
    first = extended(np.full(len(hashed), seed, np.uint64), hashed)
    common = holds(known[0], first)[word]
    at = np.flatnonzero(common & (left >= words))
    for k in range(1, words):
        at = at[common[at + k]]
    prefix = first[word[at]]
    for k in range(1, words):
        prefix = extended(prefix, hashed[word[at + k]])
    if words > 1:
        frequent = holds(known[1], prefix)
        at, prefix = at[frequent], prefix[frequent]
    following = np.full(len(at), -1)
    rows = np.flatnonzero(left[at] > words)
    rows = rows[common[at[rows] + words]]
    if words > 1:  # all but the first word must be frequent, too
        suffix = first[word[at[rows] + 1]]
        for k in range(2, words + 1):
            suffix = extended(suffix, hashed[word[at[rows] + k]])
        rows = rows[holds(known[1], suffix)]
    following[rows] = word[at[rows] + words]
    return at, following, prefix


# --- stripes of a corpus ---


def stripes_of(docs: DataFrame, words: int, known: list[np.ndarray], hot: np.ndarray | None) -> DataFrame:
    """(lang, prefix, part, next -> n, total, top): stripes of all prefixes of ``words`` words, in parts by next word.

    ``total`` and ``top`` are of the part; entries below ``OFTEN`` count in ``total`` and are left out of the map.
    """
    told = [known[0], known[-1]] if known else []
    spread = docs.sparkSession.sparkContext.broadcast((told, hot))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                yield from partial_stripes(lang, batch.column(1).filter(pc.equal(langs.indices, code)), words, *spread.value)

    rows = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text").filter(F.col("text").isNotNull())
    tasks = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a task holds its entries twice, as they come and as they are added
    partial = rows.mapInArrow(build, "lang string, part int, prefixes string, owners array<int>, nexts string, counts array<int>").repartition(tasks, "lang", "part")
    entry = F.arrays_zip(F.col("owners").alias("owner"), F.split("nexts", " ").alias("next"), F.col("counts").alias("n"))
    # Prefixes are split in a step of their own: beside the generator it would be done again for every entry.
    single = partial.withColumn("prefixes", F.split("prefixes", "\n")).select("lang", "part", "prefixes", F.inline(entry).alias("owner", "next", "n"))
    added = single.select("lang", F.col("prefixes")[F.col("owner")].alias("prefix"), "part", "next", "n").groupBy("lang", "prefix", "part", "next").agg(F.sum("n").alias("n"))
    named = (F.col("next") != REST) & (F.col("n") >= OFTEN)
    entries = F.map_from_entries(F.collect_list(F.when(named, F.struct("next", "n"))))
    return added.groupBy("lang", "prefix", "part").agg(entries.alias("next"), F.sum("n").alias("total"), F.max(F.when(named, F.col("n"))).alias("top"))


def stripes(docs: DataFrame, bits: int = BLOOM_BITS) -> DataFrame:
    """Stripes of the prefixes of 0 to ``LONGEST - 1`` words; one pass over the texts for each, written as it ends."""
    known, levels, hot = [], [], None
    for words in range(LONGEST):
        level = settle(stripes_of(docs, words, known, hot), "stripes")
        levels.append(level.withColumn("words", F.lit(words)))
        if words < LONGEST - 1:
            frequent = extensions(levels[-1])
            known.append(bloom_of(frequent, bits))
            hot = bloom_of(frequent.filter(F.col("n") >= HOT), HOT_BITS)
    joint = levels[0]
    for level in levels[1:]:
        joint = joint.unionByName(level)
    return joint


def extensions(level: DataFrame) -> DataFrame:
    """(lang, prefix, phrase, words, n): the frequent phrases that the entries of stripes are."""
    rows = level.select("lang", "prefix", "words", F.explode("next").alias("next", "n"))
    phrase = F.when(F.col("prefix") == "", F.col("next")).otherwise(F.concat_ws(" ", "prefix", "next"))
    return rows.select("lang", "prefix", phrase.alias("phrase"), (F.col("words") + 1).alias("words"), "n")


def collocations(docs: DataFrame, best: int = 2000, bits: int = BLOOM_BITS) -> DataFrame:
    """Each language's ``best`` phrases: lang, rank, phrase, a, l, r, n, score."""
    table = stripes(docs, bits)
    phrases = settle(extensions(table), "phrases")
    # Prefix totals: how often a phrase of up to four words occurs; the empty prefix's is the number of words.
    totals = settle(table.groupBy("lang", F.col("prefix").alias("phrase")).agg(F.sum("total").alias("f"), F.max("top").alias("top")), "totals")
    words_in = totals.filter(F.col("phrase") == "").select("lang", F.col("f").alias("n"))
    parts = F.split("phrase", " ")
    candidates = phrases.filter("words >= 2").select("lang", "phrase", "words", F.col("n").alias("a"))
    # Subsumed: an extension by one word, right (largest entry of the own stripe) or left (largest entry that ends so), is as frequent.
    # A longer phrase that is as frequent has such an extension between, so one step is enough.
    left = candidates.filter("words > 2").select("lang", F.expr("substring(phrase, locate(' ', phrase) + 1)").alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("before"))
    after = totals.select("lang", "phrase", F.col("top").alias("after"))
    free = candidates.join(left, ["lang", "phrase"], "left").join(after, ["lang", "phrase"], "left").filter(
        F.coalesce(F.greatest("before", "after"), F.lit(0)) < F.col("a")).select("lang", "phrase", "words", "a")
    cuts = free.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    side = lambda start, size: F.array_join(F.slice(parts, start, size), " ")
    cuts = cuts.select("lang", "phrase", "a", "k", side(F.lit(1), F.col("k")).alias("first"), side(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    cuts = cuts.join(totals.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(totals.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    cuts = cuts.join(words_in, "lang")
    scored = cuts.withColumn("score", F.expr("cast(1000 * cast(a as decimal(15,0)) * cast(n as decimal(18,0)) as decimal(38,0)) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))"))
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    placed = lowest.select("lang", "phrase", "cut.a", "cut.l", "cut.r", "cut.n", "cut.score").withColumn("rank", F.row_number().over(order))
    return placed.filter(F.col("rank") <= best).select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
