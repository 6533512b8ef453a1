"""Quality rules and a likelihood-ratio filter between trusted texts and the whole corpus, in DataFrame expressions.

Hashed n-grams (single tokens and pairs of tokens) of the trusted documents and of all documents give two smoothed
multinomials. A document's score is the mean, over its n-grams, of the log ratio of the two; a document passes if the
score reaches a threshold. The threshold is fixed by all labelled documents: the cut with the best balanced accuracy
between trusted and rejected ones, looked for among ``STEPS`` evenly spaced values of the scores' range. Nothing is
drawn at random, so every document gets the same verdict each time. Counts cover all documents; what reaches the driver is one number a
bucket, whatever the corpus, and goes to tasks as one row.

Defined results: null or empty texts have no words, fail the base rule of 20 words and score 0; repeated rows are judged
alike and each counts in the corpus; without labels of one kind the threshold is 0 (as likely under either model);
rows whose label is null or whose document is missing train nothing; a document labelled twice counts as trusted if
any label says so. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtrace.llm.common import bound, settle, words_of

BUCKETS = 1 << 14
SMOOTHING = 1.0
STEPS = 400
SYMBOLS = r"[#*$%&|<>]"
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\x20\x09-\x0D]+"




def base_measures(text: Column, window: int = 8) -> list[tuple[str, Column]]:
    """Word and line measures of a text, in the order to add them; later ones use earlier ones."""
    text = F.coalesce(text, F.lit(""))
    return [
        ("words", words_of(text)),
        ("n_symbols", (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("bigint")),
        ("lines", F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))),
        ("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint")),
        ("n_words", F.size("words").cast("bigint")),
        ("word_chars", F.length(F.concat_ws("", "words")).cast("bigint")),
        ("codes", F.transform("words", lambda w: F.xxhash64(w))),
        ("runs", F.when(F.size("codes") >= window, run_codes(F.col("codes"), window)).otherwise(F.array().cast("array<bigint>"))),
        ("n_repeat_words", F.when(F.size(F.array_distinct("runs")) == F.size("runs"), F.lit(0))
         .otherwise(_covered("runs", window)).cast("bigint")),
    ]


def run_codes(codes: Column, window: int) -> Column:
    """Hash of each run of ``window`` codes of an array of at least as many: of two runs half as long, and so on down to codes."""
    if window == 1:
        return codes
    half = (window + 1) // 2
    joint = lambda h: F.zip_with(F.slice(h, 1, F.size(h) - (window - half)), F.slice(h, window - half + 1, F.size(h)),
                                 lambda a, b: F.xxhash64(a, b))
    return bound(run_codes(codes, half), joint)


def _covered(runs: str, window: int) -> Column:
    """Words in runs that occur twice: sorted by hash, equal runs are neighbours; their starts, sorted, give the union."""
    placed = F.sort_array(F.transform(runs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twin(all_: Column, at: Column) -> Column:
        same = lambda other: F.coalesce(F.get(all_, other)["h"] == F.get(all_, at)["h"], F.lit(False))
        return same(at - 1) | same(at + 1)

    places = lambda p: F.filter(F.transform(p, lambda x, at: F.when(twin(p, at), x["i"])), lambda i: i.isNotNull())
    spans = lambda s: F.aggregate(F.transform(s, lambda i, at: F.least(  # noqa: E731  up to the next start, if that is near
        F.lit(window), F.coalesce(F.get(s, at + 1) - i, F.lit(window)))), F.lit(0), lambda acc, n: acc + n)
    return bound(placed, lambda p: bound(F.sort_array(places(p)), spans))


def ngram_buckets(text: Column, buckets: int = BUCKETS) -> Column:
    """Hash buckets of the tokens and of the pairs of neighbouring tokens of a text."""
    tokens = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), lambda t: F.xxhash64(t))
    of = lambda code: F.pmod(code, F.lit(buckets)).cast("int")
    pairs = lambda t: F.transform(F.sequence(F.lit(1), F.size(t) - 1), lambda i: of(F.xxhash64(F.get(t, i - 1), F.get(t, i))))
    return bound(tokens, lambda t: F.concat(F.transform(t, of), F.when(F.size(t) > 1, pairs(t)).otherwise(F.array().cast("array<int>"))))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """One row for each labelled document: doc_id, trusted."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    return known.groupBy("doc_id").agg((F.max("quality") == 1).alias("trusted"))


def ratio_model(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row: ``ratios``, the log ratio of every bucket."""
    trusted = trusted_ids(labels).where("trusted").select("doc_id", F.lit(1).alias("is_target"))
    # One plan at any size: texts are dealt by doc_id once and never sorted; a task holds the trusted ids of its share.
    grams = docs.select("doc_id", "text").join(trusted.hint("shuffle_hash"), "doc_id", "left").select(
        "is_target", F.explode(ngram_buckets(F.col("text"), buckets)).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("is_target").alias("target"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    full = every.join(counts, "bucket", "left").fillna(0, ["raw", "target"])
    listed = full.agg(F.array_sort(F.collect_list(F.struct("bucket", "target", "raw"))).alias("all"),
                      F.sum("target").alias("targets"), F.sum("raw").alias("raws"))
    share = lambda n, total: (n + SMOOTHING) / (F.col(total) + SMOOTHING * buckets)
    ratio = F.transform("all", lambda x: F.log(share(x["target"], "targets")) - F.log(share(x["raw"], "raws")))
    return listed.select(F.when(F.col("targets") > 0, ratio).otherwise(F.transform("all", lambda x: F.lit(0.0))).alias("ratios"))


def scored(docs: DataFrame, model: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``docs`` with ``score``: the mean log ratio of a text's n-grams."""
    ratios = F.lit(np.array(model.first()["ratios"]))
    grams = docs.withColumn("grams", ngram_buckets(F.col("text"), buckets))
    total = F.aggregate("grams", F.lit(0.0), lambda acc, b: acc + F.get(ratios, b))
    return grams.withColumn("score", F.when(F.size("grams") > 0, total / F.size("grams")).otherwise(F.lit(0.0))).drop("grams")


def threshold(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: ``cut``, the score that best tells trusted documents from rejected ones among those that pass the base rules."""
    known = measured.where(~F.col("base_failed")).select("doc_id", "score").join(trusted_ids(labels), "doc_id")
    bounds = known.agg(F.min("score").alias("low"), F.max("score").alias("high"))
    low, high = bounds.select("low").scalar(), bounds.select("high").scalar()
    step = F.when(high > low, F.floor((F.col("score") - low) / (high - low) * STEPS)).otherwise(F.lit(0)).cast("int")
    bins = known.groupBy(step.alias("step")).agg(
        F.count(F.when(F.col("trusted"), 1)).alias("good"), F.count(F.when(~F.col("trusted"), 1)).alias("bad"))
    listed = bins.agg(F.array_sort(F.collect_list(F.struct("step", "good", "bad"))).alias("bins"))  # STEPS + 1 rows at most
    listed = listed.select("bins", low.alias("low"), high.alias("high"))
    low, high = F.col("low"), F.col("high")
    upto = lambda kind, step: F.aggregate(
        F.filter("bins", lambda b: b["step"] < step), F.lit(0).cast("bigint"), lambda acc, b: acc + b[kind])
    all_of = lambda kind: F.aggregate("bins", F.lit(0).cast("bigint"), lambda acc, b: acc + b[kind])
    gain = F.transform("bins", lambda b: F.struct(
        (upto("bad", b["step"]) / F.greatest(all_of("bad"), F.lit(1)) - upto("good", b["step"]) / F.greatest(all_of("good"), F.lit(1)))
        .alias("gain"), (-b["step"]).alias("less")))
    both = (all_of("good") > 0) & (all_of("bad") > 0)
    best = F.array_max(gain)
    return listed.select(F.when(both, low + (high - low) * (-best["less"]) / STEPS).otherwise(F.lit(0.0)).alias("cut"))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: the base measures, base_failed, score and kept."""
    measured = scored(docs.select("doc_id", "text"), settle(ratio_model(docs, labels), "ratios"))
    for name, column in base_measures(F.col("text")):
        measured = measured.withColumn(name, column)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    measured = settle(measured.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                      failed.alias("base_failed"), "score"), "measures")
    cut = threshold(measured, labels).first()["cut"]
    return measured.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= (cut or 0.0)))
