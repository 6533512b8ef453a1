"""Nulls, empty lists, mixed sessions, large bases and strict readers."""

import pytest
from pyspark.sql import functions as F

from playtrace.operators import aggregates as A
from playtrace.operators import metrics as M
from playtrace.operators.scan import OrderedScan, deviation
from playtrace.runtime import GROUP_ROWS_CONF, new_path
from playtrace.sources.tables import LABELS_SCHEMA, read_labels, write_csv


def test_unknown_kappas_do_not_count(spark):
    rows = spark.createDataFrame([(0.5, 1.0), (None, 9.0)], "kappa double, weight double")
    assert M.mean_kappa(rows, "kappa").first()[0] == pytest.approx(0.5)
    assert M.mean_kappa(rows, "kappa", "weight").first()[0] == pytest.approx(0.5)
    assert M.mean_kappa(rows.where("kappa is null"), "kappa").first()[0] is None


def test_half_known_pairs_do_not_count(spark):
    rows = spark.createDataFrame([(0, 0), (1, 1), (1, 0), (None, 1), (0, None)], "a int, b int")
    assert M.cohen_kappa(rows, "a", "b").first()[0] == pytest.approx(0.4)
    full = rows.dropna()
    assert M.quadratic_weighted_kappa_from_grid(rows, "a", "b").first()[0] == pytest.approx(M.quadratic_weighted_kappa(full, "a", "b").first()[0])


def test_empty_list_means_no_feature(spark):
    rows = spark.createDataFrame([(1.0, 2.0, 1), (2.0, 1.0, 0)], "x double, y double, label int")
    assert A.feature_label_correlation(rows, "label", []).count() == 0
    assert A.feature_label_correlation(rows, "label").count() == 2


@pytest.mark.parametrize("base", [1e6, 1e8, 1.6e12])
def test_deviation_of_close_values(spark, base):
    rows = spark.range(2000).select(F.lit(1).alias("k"), "id", (F.lit(base) + F.col("id") % 3).alias("v"))
    spark.conf.set(GROUP_ROWS_CONF, "200")
    try:
        chunked = OrderedScan(rows, ["k"], ["id"]).with_running(d=deviation(F.col("v"))).result().where("id = 1999").first()["d"]
    finally:
        spark.conf.unset(GROUP_ROWS_CONF)
    assert chunked == pytest.approx(0.8168, abs=1e-3)


def test_session_totals_keep_null_keys(spark):
    rows = spark.createDataFrame([("i", None, 1, 5), ("i", "s", 2, 7), ("i", "s", 3, 9)], "installation_id string, game_session string, event_count int, game_time long")
    got = {(r["game_session"], r["event_count"]): r["total_game_session_time"] for r in A.session_totals(rows).collect()}
    assert got == {(None, 1): 5, ("s", 2): 9, ("s", 3): 9}


def test_csv_holds_line_breaks_and_hides_nothing(spark):
    path = new_path(spark, "strict")
    rows = spark.createDataFrame([("a\nb", "s,\"q\"", 1)], LABELS_SCHEMA)
    write_csv(rows, path)
    assert read_labels(spark, path, kind="csv", multi_line=True).collect() == rows.collect()
    with pytest.raises(Exception):  # files are split unless they are said to hold line breaks, and nothing is lost silently
        read_labels(spark, path, kind="csv").collect()
    bad = new_path(spark, "bad")
    write_csv(spark.createDataFrame([("a", "s", "many")], "installation_id string, game_session string, accuracy_group string"), bad)
    with pytest.raises(Exception):
        read_labels(spark, bad, kind="csv").collect()
