"""A training corpus from raw documents: one operator a stage, each on all that its predecessor kept.

``STAGES`` lists (name, function); a function takes (spark, docs, folder) and returns a DataFrame. ``run`` writes each
stage's rows as Parquet to the shared folder and reads them again for the next. All stages but the last return the columns
of documents; the last adds the tokens' number and digests. Rows with nulls, empty and very long texts, repeats and further
columns go through as each operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playtrace.llm import bpe, decontamination, line_dedup, minhash, toxicity
from playtrace.llm.common import settle, table
from playtrace.llm.queries import vocabulary_path
from playtrace.llm.registry import query


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Without documents that the classifier rejects."""
    return toxicity.without_toxic(docs, toxicity.fitted(docs, table(spark, folder, "labels")))


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, without repeated chunks (ended by the rolling hash over line hashes) and without any other run of two or
    more lines that came before; n_chars follows the text."""
    cut = line_dedup.deduplicated(docs, line_dedup.chunks_and_pairs_of)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group: five-word shingles, similarity of 0.8 or more."""
    return minhash.one_of_each(docs, width=5, percent=80)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Without documents that contain a benchmark item."""
    return decontamination.without_leaks(docs, table(spark, folder, "benchmark"))


def tokenized(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Number and digests of each document's tokens, and of the text that they decode to."""
    return bpe.round_trip(docs, vocabulary_path(spark))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", cut_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("bpe", tokenized),
]

ORACLE_SQL = None  # the first stage's classifier has no SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs


@query("pipeline", ORACLE_SQL)
def pipeline(spark, folder):
    return run(spark, folder)
