"""The ordered scan: both ways agree with pandas, and the hot way bounds its chunks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from playtrace.operators import scan as S
from playtrace.runtime import GROUP_ROWS_CONF


def frame(seed, rows=600, hot=0.6):
    rng = np.random.default_rng(seed)
    key = np.where(rng.random(rows) < hot, 0, rng.integers(1, 30, rows))
    return pd.DataFrame({
        "key": key, "at": rng.permutation(rows) // 2, "id": np.arange(rows),
        "x": np.where(rng.random(rows) < 0.2, np.nan, rng.integers(0, 50, rows).astype(float)),
    })


def measures():
    return dict(
        total=S.total(F.col("x")), before=S.total(F.col("x"), before=True), top=S.highest(F.col("x")),
        top_before=S.highest(F.col("x"), before=True), last=S.latest(F.col("x")), last_before=S.latest(F.col("x"), before=True),
        lagged=S.previous(F.col("x")), mean=S.mean(F.col("x")), mean_before=S.mean(F.col("x"), before=True),
        dev=S.deviation(F.col("x")), dev_before=S.deviation(F.col("x"), before=True), place=S.position(),
    )


def expected(pdf, descending):
    pdf = pdf.sort_values(["key", "at", "id"], ascending=[True, not descending, not descending]).copy()
    g = pdf.groupby("key")["x"]
    shifted = g.shift(1)
    by = pdf["key"]
    some = lambda s: s.groupby(by).transform(lambda v: v.notna().cumsum() > 0)
    pdf["total"] = g.transform(lambda v: v.fillna(0).cumsum()).where(some(pdf["x"]))
    pdf["before"] = shifted.groupby(by).transform(lambda v: v.fillna(0).cumsum()).where(some(shifted))
    pdf["top"] = g.transform(lambda v: v.cummax().ffill())
    pdf["top_before"] = pdf.groupby("key")["top"].shift(1)
    pdf["last"] = g.ffill()
    pdf["last_before"] = pdf.groupby("key")["last"].shift(1)
    pdf["lagged"] = shifted
    pdf["mean"] = g.transform(lambda v: v.expanding().mean())
    pdf["mean_before"] = pdf.groupby("key")["mean"].shift(1)
    pdf["dev"] = g.transform(lambda v: v.expanding().std())
    pdf["dev_before"] = pdf.groupby("key")["dev"].shift(1)
    pdf["place"] = pdf.groupby("key").cumcount() + 1
    return pdf.set_index("id").sort_index()


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("limit", [None, 25])
def test_measures(spark, limit, descending):
    pdf = frame(7)
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    if limit:
        spark.conf.set(GROUP_ROWS_CONF, str(limit))
    try:
        scan = S.OrderedScan(df, ["key"], ["at", "id"], descending).with_running(**measures())
        assert scan.chunked == bool(limit)
        got = scan.result().toPandas().set_index("id").sort_index()
    finally:
        spark.conf.unset(GROUP_ROWS_CONF)
    want = expected(pdf, descending)
    assert sorted(got.columns) == sorted(c for c in want.columns)
    for name in measures():
        np.testing.assert_allclose(got[name].astype(float), want[name].astype(float), rtol=1e-9, atol=1e-9, err_msg=name)


def test_a_hot_key_is_cut_and_the_carry_stays_small(spark):
    df = spark.range(4000).select(F.when(F.col("id") < 3000, 0).otherwise(F.col("id")).alias("key"), F.col("id").alias("at"))
    spark.conf.set(GROUP_ROWS_CONF, "200")
    try:
        scan = S.OrderedScan(df, ["key"], ["at"])
        sizes = scan.df.groupBy("key", S.CHUNK).count()
        chunks = scan.df.select(S.CHUNK).distinct().count()
        assert sizes.agg(F.max("count")).first()[0] <= 400
        assert sizes.count() - df.select("key").distinct().count() < chunks
    finally:
        spark.conf.unset(GROUP_ROWS_CONF)


def test_copies_of_one_row_are_cut_too(spark):
    df = spark.range(1000).select(F.lit("k").alias("key"), F.lit(1).alias("at"), F.lit(1).alias("x"))
    spark.conf.set(GROUP_ROWS_CONF, "100")
    try:
        scan = S.OrderedScan(df, ["key"], ["at"])
        assert scan.df.groupBy(S.CHUNK).count().agg(F.max("count")).first()[0] <= 200
        got = sorted(r["n"] for r in scan.with_running(n=S.total(F.col("x"))).result().collect())
    finally:
        spark.conf.unset(GROUP_ROWS_CONF)
    assert got == list(range(1, 1001))
