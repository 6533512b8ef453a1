"""Repeated passages of several lines: chunks cut where the lines themselves say so, or every pair of neighbouring lines.

``deduplicated`` takes its pieces from ``chunks_of``, from ``pairs_of`` or, for all that either finds, from ``chunks_and_pairs_of``.

A rolling polynomial hash runs over the hashes of each ``WINDOW`` neighbouring lines; where it is a multiple of ``SPACING`` a
chunk ends. A boundary thus hangs on the lines next to it alone: lines put in or left out elsewhere shift no other
boundary, and a passage repeated in another document falls into the same chunks but for its two ends. Of chunks of two or
more lines with at least one word, the first occurrence (smallest doc_id, then place) stays and all others go.

Chunks are what the SQL of ``op1_line_dedup`` asks for. They miss the ends of a passage and most passages of two or three lines.
Pairs miss nothing: each line of a run of two or more lines that came before (in an earlier document, or further up) goes, if the
pair has a word. The first occurrence of a line never goes; a pair that stays may lose a line to another pair that came before.

Occurrences are first matched by a 64-bit hash, without texts; then the texts of those that would go are compared byte by
byte with the text of the one that stays; on a clash of hashes nothing goes. The first of a hash is found by aggregation,
which combines before the shuffle, so a chunk in a third of all documents costs a row a task.

Defined results: of one line many times in a row the first two lines stay; null texts stay null, empty texts empty; a document all of whose chunks went has an empty text and stays as a
row; rows without doc_id are left as they are and take no part; rows that share a doc_id are one document, told apart by a
hash of their text: exact repeats of a row are each cut alike; other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtrace.llm.common import bound, settle

WINDOW = 2
SPACING = 3
BASE = 1_000_003
PRIME = (1 << 31) - 1
MEET = 1000  # occurrences of one chunk compared in one place


def line_codes(lines: Column) -> Column:
    """32 bits of each line's MD5: any engine can compute them."""
    return F.transform(lines, lambda line: F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("bigint"))


def chunk_ends(codes: Column, window: int, spacing: int) -> Column:
    """Numbers of the lines, from 1, after which a chunk ends."""

    def cut(i: Column, c: Column) -> Column:
        rolled = F.lit(0).cast("bigint")
        for k in range(window):  # polynomial over the last lines
            rolled = F.pmod(rolled * BASE + F.get(c, i - (window - k)), F.lit(PRIME))
        return (i == F.size(c)) | ((i >= window) & (F.pmod(rolled, F.lit(spacing)) == 0))

    return bound(codes, lambda c: F.filter(F.sequence(F.lit(1), F.size(c)), lambda i: cut(i, c)))


def chunks_of(text: Column, window: int = WINDOW, spacing: int = SPACING) -> Column:
    """Array of (place, start, n_lines, body): the chunks of a text, lines counted from 0."""

    def parts(lines: Column, ends: Column) -> Column:
        start = lambda place: F.when(place == 0, F.lit(0)).otherwise(F.get(ends, place - 1))
        return F.transform(ends, lambda e, place: F.struct(
            place.alias("place"), start(place).alias("start"), (e - start(place)).alias("n_lines"),
            F.array_join(F.slice(lines, start(place) + 1, e - start(place)), "\n").alias("body")))

    return bound(F.split(text, "\n"), lambda lines: bound(chunk_ends(line_codes(lines), window, spacing), lambda ends: parts(lines, ends)))


def pairs_of(text: Column) -> Column:
    """Array of (place, start, n_lines, body): every two neighbouring lines; pieces overlap by one line."""

    def pair(lines: Column, i: Column) -> Column:
        body = F.concat_ws("\n", F.get(lines, i), F.get(lines, i + 1))
        return F.struct(i.alias("place"), i.alias("start"), F.lit(2).alias("n_lines"), body.alias("body"))

    starts = lambda lines: F.slice(F.sequence(F.lit(0), F.size(lines) - 1), F.lit(1), F.size(lines) - 1)
    return bound(F.split(text, "\n"), lambda lines: F.transform(starts(lines), lambda i: pair(lines, i)))


def chunks_and_pairs_of(text: Column) -> Column:
    """Chunks of three or more lines, and every pair of neighbouring lines, which also finds what chunks cut off at a passage's ends."""
    piece = lambda c: F.struct(
        c["start"].cast("int").alias("place"), c["start"].cast("int").alias("start"), c["n_lines"].cast("int").alias("n_lines"), c["body"].alias("body"))
    longer = F.filter(chunks_of(text), lambda c: c["n_lines"] >= 3)
    return F.concat(F.transform(longer, piece), F.transform(pairs_of(text), piece))


def repeated_chunks(docs: DataFrame, pieces: Callable[[Column], Column] = chunks_of) -> DataFrame:
    """__doc, __copy, gone: (start, n_lines) of the pieces that an earlier, equal piece makes superfluous."""
    known = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("__doc"), "text", F.xxhash64("text").alias("__copy"))
    usable = F.filter(pieces(F.col("text")), lambda c: (c["n_lines"] >= 2) & c["body"].rlike(r"[^\x20\x09-\x0D]"))
    brief = F.transform(usable, lambda c: F.struct(F.xxhash64(c["body"]).alias("code"), c["place"], c["start"], c["n_lines"]))
    seen = known.select("__doc", "__copy", F.explode(brief).alias("c")).select("__doc", "__copy", "c.*").distinct()  # repeats of a row count once
    seen = settle(seen, "chunks")
    totals = seen.groupBy("code").agg(F.count("*").alias("n"), F.min("__doc").alias("first_doc")).where("n > 1")
    inside = seen.join(totals, "code")
    firsts = inside.where("__doc = first_doc").groupBy("code").agg(F.min(F.struct("place", "__copy")).alias("first"))
    stays = (F.col("__doc") == F.col("first_doc")) & (F.struct("place", "__copy") == F.col("first"))
    marked = settle(inside.join(firsts, "code").select("__doc", "__copy", "code", "start", "n_lines", "n", stays.alias("stays")), "marked")
    # Byte comparison: the texts of marked chunks only, each with the one that stays.
    mark = F.struct("start", "n_lines", "code", "n", "stays")
    wanted = marked.groupBy("__doc", "__copy").agg(F.collect_list(mark).alias("wanted"))
    own = known.join(wanted.hint("merge"), ["__doc", "__copy"])
    named = own.select("__doc", "__copy", F.explode(bound(F.split("text", "\n"), lambda lines: F.transform("wanted", lambda w: F.struct(
        w["start"], w["n_lines"], w["code"], w["n"], w["stays"], F.array_join(F.slice(lines, w["start"] + 1, w["n_lines"]), "\n").alias("body"))))).alias("w"))
    named = named.select("__doc", "__copy", "w.*", F.ceil(F.col("w.n") / MEET).alias("parts"))  # a hot chunk is compared in several places
    kept = F.struct("__doc", "__copy", "start").alias("kept")
    stay = named.where("stays").select("code", F.col("body").alias("kept_body"), kept, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))
    go = named.where("not stays").withColumn("part", F.pmod(F.xxhash64("__doc", "start"), F.col("parts")))
    equal = go.join(stay.distinct(), ["code", "part"]).where(F.col("body") == F.col("kept_body"))
    # A piece that overlaps the one that stays leaves the lines of that one.
    beside = (F.col("__doc") == F.col("kept.__doc")) & (F.col("__copy") == F.col("kept.__copy"))
    first = F.when(beside, F.greatest("start", F.col("kept.start") + F.col("n_lines"))).otherwise(F.col("start"))
    lines = F.struct(first.alias("start"), (F.col("start") + F.col("n_lines") - first).alias("n_lines"))
    return settle(equal.groupBy("__doc", "__copy").agg(F.collect_set(lines).alias("gone")), "gone")


def deduplicated(docs: DataFrame, pieces: Callable[[Column], Column] = chunks_of) -> DataFrame:
    """``docs`` with repeated pieces cut out of ``text``; all rows and columns stay."""
    gone = repeated_chunks(docs, pieces)
    whole = F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("__row")
    own = docs.select(whole, F.col("doc_id").alias("__doc"), F.xxhash64("text").alias("__copy"))
    hit = own.join(gone.hint("merge"), ["__doc", "__copy"], "left")
    places = F.flatten(F.transform("gone", lambda g: F.sequence(g["start"], g["start"] + g["n_lines"] - 1)))
    kept = bound(F.split(F.col("__row")["text"], "\n"), lambda lines: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), places), lambda i: F.get(lines, i)), "\n"))
    text = F.when(F.col("gone").isNull(), F.col("__row")["text"]).otherwise(kept)
    return hit.select(*[text.alias(n) if n == "text" else F.col("__row")[n].alias(n) for n in docs.columns])
