"""The pipeline keeps the columns of documents until its last stage, and its stages do what they say."""

from conftest import FOLDER

import corpus_pipeline as pipeline
from playtrace.llm.common import table


def test_stages(spark):
    docs = table(spark, FOLDER, "documents")
    names = docs.columns
    seen = docs.count()
    for name, stage in pipeline.STAGES[:-1]:
        docs = pipeline.settle(stage(spark, docs, FOLDER), name)
        assert docs.columns == names, name
        assert 0 < docs.count() <= seen
        seen = docs.count()
    assert docs.select("doc_id").distinct().count() == seen
    last = pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert last.count() == seen and set(last.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}



def test_line_dedup_cuts_chunks_and_pairs(spark):
    from playtrace.llm import line_dedup

    text = "\n".join(line for i in range(40) for line in (f"line {i}", "", "", ""))
    docs = spark.createDataFrame([(1, text, len(text)), (2, text, len(text))], "doc_id long, text string, n_chars long")
    lines = lambda df: len(df.where("doc_id = 2").first()["text"].split("\n"))
    cut, pairs = pipeline.cut_repeated_lines(spark, docs, FOLDER), line_dedup.deduplicated(docs, line_dedup.pairs_of)
    assert lines(cut) < lines(pairs) < 160
    assert cut.where("doc_id = 1").count() == 1 and "line" not in cut.where("doc_id = 2").first()["text"]
