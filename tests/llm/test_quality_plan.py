"""The quality filter: one plan whatever the number of labels, runs of words hashed by halves."""

from pyspark.sql import functions as F

from playtrace.llm import quality


def test_labels_are_joined_alike_at_any_size(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    docs = spark.createDataFrame([(i, "some words of a text") for i in range(4)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, quality int")
    plans = []
    try:
        for limit in ("-1", "10m"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
            plan = quality.ratio_model(docs, labels)._jdf.queryExecution().sparkPlan().toString()
            plans.append("ShuffledHashJoin [doc_id" in plan)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plans == [True, True]


def test_run_codes_are_equal_where_runs_are(spark):
    words = [1, 2, 3, 4, 5, 6, 7, 8, 9, 1, 2, 3, 4, 5, 6, 7, 8, 1, 2, 3]
    df = spark.createDataFrame([(words,)], "codes array<bigint>")
    for window in (1, 2, 3, 5, 8, 20):
        found = df.select(quality.run_codes(F.col("codes"), window).alias("r")).first()["r"]
        runs = [tuple(words[i : i + window]) for i in range(len(words) - window + 1)]
        assert len(found) == len(runs)
        assert all((found[i] == found[k]) == (runs[i] == runs[k]) for i in range(len(runs)) for k in range(len(runs)))
