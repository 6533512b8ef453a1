"""Licence notices in documents: a trained paragraph classifier, a calibrated unknown class, and templates that confirm.

Paragraphs are the lines of a text, and neighbouring lines that hold a wrapped notice together: of all joins of lines whose inner
lines are no longer than the longest template, those that share ``ALIKE`` of a template's word pairs, of overlapping ones the one
that shares ``CONFIRMED``, then most pairs, then fewest lines. A join stands for its lines, under the number of its first one; lines
without words neither count nor part. Joins less like every template are judged line by line. A multinomial logistic regression with an elastic-net penalty over hashed words and word pairs tells
licence families and ``none``. It is trained on variants of the templates below (each word left out in turn, the notice
before or after a line of the corpus) and on lines of a bounded sample of ``SAMPLE`` documents, the first by a hash of
doc_id, without those that share ``ALIKE`` of a template's word pairs.

A fifth of the variants is held out: the probability that all but one in a hundred of them reach is the bar for naming a
family. A paragraph that is rather a notice than none, but stays below the bar, is ``unknown``; so is one whose named family
has no template of whose word pairs it holds at least ``CONFIRMED``. Every paragraph of every document is classified.

Defined results: null, empty and wordless texts have no notices; repeated rows give repeated notices; rows without doc_id are
scanned like others; without documents the model rests on templates alone and nothing is found; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playtrace.llm.common import bound, settle

SAMPLE = 400
FEATURES = 1 << 14
ALIKE = 0.3
CONFIRMED = 0.6

# Notices as licensors word them.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work and dedicated it to the public domain."),
]
FAMILIES = ["none", *dict.fromkeys(f for f, _ in TEMPLATES)]


def tokens_of(paragraph: Column) -> Column:
    return F.regexp_extract_all(F.lower(paragraph), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def pairs_of(tokens: Column) -> Column:
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.zip_with(F.slice(tokens, F.lit(1), n), F.slice(tokens, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))


def known_pairs(tokens: Column, known: list[str]) -> Column:
    """The distinct word pairs that some template has."""
    return F.array_distinct(F.filter(pairs_of(tokens), lambda p: p.isin(known)))


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph (number of its first line, from 0), tokens of every line or join of lines that has one."""
    held = templates(docs.sparkSession).collect()  # as many rows as there are templates
    patterns, longest = [r["template_pairs"] for r in held], max(len(r["template"]) for r in held)
    known = sorted({p for pattern in patterns for p in pattern})
    # No join of a text's lines is more like a template than the whole text is; few texts are like one.
    like = bound(known_pairs(tokens_of(F.col("text")), known), lambda pairs: alike(pairs, patterns, ALIKE) > 0)
    lines = F.filter(F.transform(F.split("text", "\n"), lambda line, n: F.struct(n.alias("paragraph"), tokens_of(line).alias("tokens"))),
                     lambda line: F.size(line["tokens"]) > 0)
    found = F.when(like, bound(lines, lambda ls: joined(ls, patterns, known, longest))).otherwise(lines)
    return docs.select("doc_id", F.explode(found).alias("p")).select("doc_id", "p.paragraph", "p.tokens")


def alike(pairs: Column, patterns: list[list[str]], bar: float) -> Column:
    """Most pairs shared with a template of whose pairs at least ``bar`` are shared; 0 without one."""
    same = [(F.size(F.array_intersect(pairs, F.array(*map(F.lit, p)))), len(p)) for p in patterns]
    return F.greatest(*[F.when(n / size >= bar, n).otherwise(0) for n, size in same])


def joined(lines: Column, patterns: list[list[str]], known: list[str], longest: int) -> Column:
    """Array of (paragraph, tokens): ``lines``, where those that hold a wrapped notice together are one."""

    def tokens(start: Column, n: Column) -> Column:
        return F.flatten(F.transform(F.slice(lines, start + 1, n), lambda line: line["tokens"]))

    def judged(start: Column, n: Column) -> Column:
        return bound(known_pairs(tokens(start, n), known), lambda pairs: F.struct(
            alike(pairs, patterns, CONFIRMED).alias("sure"), alike(pairs, patterns, ALIKE).alias("like"), (-n).alias("less"), (-start).alias("before")))

    def joins(start: Column) -> Column:
        inner = lambda n: F.aggregate(F.slice(lines, start + 2, F.greatest(n - 2, F.lit(0))), F.lit(0), lambda s, line: s + F.size(line["tokens"]))
        sizes = F.filter(F.sequence(F.lit(1), F.least(F.lit(longest), F.size(lines) - start)), lambda n: inner(n) <= longest - 2)
        return F.filter(F.transform(sizes, lambda n: judged(start, n)), lambda j: j["like"] > 0)

    def meets(a: Column, b: Column) -> Column:
        return (-a["before"] < -b["before"] - b["less"]) & (-b["before"] < -a["before"] - a["less"])

    def chosen(ranked: Column) -> Column:
        return F.aggregate(ranked, F.filter(ranked, lambda _: F.lit(False)), lambda taken, j: F.when(
            F.exists(taken, lambda t: meets(t, j)), taken).otherwise(F.concat(taken, F.array(j))))

    def merged(whole: Column) -> Column:
        first = F.filter(F.transform(lines, lambda _, k: k), lambda k: ~F.exists(whole, lambda j: (k > -j["before"]) & (k < -j["before"] - j["less"])))
        n = lambda k: F.coalesce(-F.get(F.filter(whole, lambda j: -j["before"] == k), F.lit(0))["less"], F.lit(1))
        return F.transform(first, lambda k: F.struct(F.get(lines, k)["paragraph"].alias("paragraph"), tokens(k, n(k)).alias("tokens")))

    starts = F.transform(lines, lambda _, k: k)
    ranked = F.sort_array(F.flatten(F.transform(starts, joins)), asc=False)
    return bound(bound(ranked, lambda r: F.filter(chosen(r), lambda j: j["less"] < -1)), merged)


def templates(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(TEMPLATES, "family string, template string")
    return rows.select("family", tokens_of(F.col("template")).alias("template")).withColumn("template_pairs", F.array_distinct(pairs_of(F.col("template"))))


def likeness(tokens: Column, template_pairs: Column) -> Column:
    """Share of a template's word pairs that occur in a paragraph."""
    return F.size(F.array_intersect(pairs_of(tokens), template_pairs)) / F.size(template_pairs)


def training_rows(docs: DataFrame) -> DataFrame:
    """tokens, label, held_out: variants of templates and lines of the sample."""
    known = F.broadcast(templates(docs.sparkSession))  # as many rows as there are templates
    some = docs.where(F.col("text").isNotNull()).select("doc_id", "text").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    lines = settle(paragraphs(some).select("tokens"), "lines")
    patterns = [r["template_pairs"] for r in templates(docs.sparkSession).collect()]
    alike = F.greatest(*[likeness(F.col("tokens"), F.array(*map(F.lit, p))) for p in patterns])
    none = lines.where(alike < ALIKE)
    label = F.array_position(F.array(*map(F.lit, FAMILIES)), F.col("family")).cast("double") - 1
    without = F.filter("template", lambda w, i: i != F.col("left_out"))
    variants = known.withColumn("left_out", F.explode(F.sequence(F.lit(-1), F.size("template") - 1))).select(label.alias("label"), without.alias("tokens"))
    few = none.orderBy(F.xxhash64("tokens")).limit(20).select(F.col("tokens").alias("line"))
    beside = few.select("line", F.explode(F.array(*[F.struct(F.lit(f).alias("family"), F.array(*map(F.lit, t)).alias("template")) for f, t in (
        (r["family"], r["template"]) for r in templates(docs.sparkSession).collect())])).alias("t")).select(F.col("t.family").alias("family"), "line", F.col("t.template").alias("template"))
    beside = beside.select(label.alias("label"), F.explode(F.array(F.concat("line", "template"), F.concat("template", "line"))).alias("tokens"))
    rows = variants.union(beside).union(none.select(F.lit(0.0).alias("label"), "tokens"))
    return rows.withColumn("held_out", F.pmod(F.xxhash64("tokens", "label"), F.lit(5)) == 0)


def featured(rows: DataFrame) -> DataFrame:
    hashing = HashingTF(inputCol="terms", outputCol="features", numFeatures=FEATURES, binary=True)
    return hashing.transform(rows.withColumn("terms", F.concat("tokens", pairs_of(F.col("tokens")))))


def fitted(docs: DataFrame) -> tuple[LogisticRegressionModel, float]:
    """The classifier and the bar for naming a family."""
    rows = settle(training_rows(docs), "training")
    learner = LogisticRegression(maxIter=60, regParam=0.002, elasticNetParam=0.1, family="multinomial", standardization=False)
    model = learner.fit(featured(rows.where(~F.col("held_out"))))
    tested = model.transform(featured(rows.where("held_out and label > 0")))
    own = F.get(vector_to_array("probability"), F.col("label").cast("int"))
    bar = tested.agg(F.percentile_approx(own, 0.01, 10_000)).first()[0]
    return model, min(0.9, max(0.5, bar if bar is not None else 0.5))


def notices(docs: DataFrame, model: LogisticRegressionModel | None = None, bar: float | None = None) -> DataFrame:
    """doc_id, paragraph, family (or unknown), probability, similarity, confirmed: every paragraph that is rather a notice."""
    if model is None:
        model, bar = fitted(docs)
    chances = model.transform(featured(paragraphs(docs))).select("doc_id", "paragraph", "tokens", vector_to_array("probability").alias("p"))
    named = F.slice("p", 2, len(FAMILIES) - 1)
    found = chances.where(F.get("p", F.lit(0)) < 0.5).withColumn("probability", F.array_max(named))
    found = found.withColumn("guess", F.element_at(F.array(*map(F.lit, FAMILIES[1:])), F.array_position(named, F.col("probability")).cast("int")))
    held = [(r["family"], r["template_pairs"]) for r in templates(docs.sparkSession).collect()]
    alike = F.greatest(F.lit(0.0), *[F.when(F.col("guess") == f, likeness(F.col("tokens"), F.array(*map(F.lit, p)))) for f, p in held])
    found = found.withColumn("similarity", alike)
    sure = (F.col("probability") >= bar) & (F.col("similarity") >= CONFIRMED)
    return found.select("doc_id", "paragraph", F.when(sure, F.col("guess")).otherwise("unknown").alias("family"),
                        F.round("probability", 6).alias("probability"), F.round("similarity", 6).alias("similarity"), sure.alias("confirmed"))
