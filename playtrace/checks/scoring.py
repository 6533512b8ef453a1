"""Queries over sampling, folds and metrics: L and M rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from playtrace.checks.primitives import RATINGS, pick, ratings_of
from playtrace.checks.registry import query
from playtrace.checks.sql_views import KEYS, on_assessments
from playtrace.config import DEFAULT_LOG as LOG
from playtrace.functions.scalars import is_assessment
from playtrace.operators import metrics as M
from playtrace.operators import sampling as L
from playtrace.operators.sessions import session_frame
from playtrace.sources.activity import game_events


def assessments_of(spark, folder):
    sessions = session_frame(game_events(spark, folder)).filter(is_assessment())
    return pick(sessions, "attempts", "successes", "session_time", "accuracy_group")


def hashed_sql(*parts: str) -> str:
    return f"CAST('0x' || substr(md5({' || chr(58) || '.join(parts)}), 1, 15) AS BIGINT)"


def resample_sql(size: str) -> str:
    number = hashed_sql("'42'", "CAST(g AS VARCHAR)", "CAST(draw AS VARCHAR)")
    return on_assessments(
        f"SELECT {KEYS}, attempts, accuracy_group, draw FROM (SELECT g, draw, {number} % n AS place FROM draws) d "
        "JOIN placed p ON p.accuracy_group = d.g AND p.place = d.place",
        "\nsizes AS (SELECT accuracy_group AS g, count(*) AS n FROM a GROUP BY accuracy_group)",
        f"\ndraws AS (SELECT g, n, unnest(range(1, (SELECT {size}(n) FROM sizes) + 1)) AS draw FROM sizes)",
        f"\nplaced AS (SELECT *, row_number() OVER (PARTITION BY accuracy_group ORDER BY {KEYS}) - 1 AS place FROM a)",
    )


@query("l1_balanced_resample_down", resample_sql("min"))
def _(spark, folder):
    rows = assessments_of(spark, folder).select(*LOG.keys, "attempts", "accuracy_group")
    return L.balanced_resample(rows, "accuracy_group", LOG.keys, "down")


@query("l1_balanced_resample_over", resample_sql("max"))
def _(spark, folder):
    rows = assessments_of(spark, folder).select(*LOG.keys, "attempts", "accuracy_group")
    return L.balanced_resample(rows, "accuracy_group", LOG.keys, "over")


@query("l2_kfold", on_assessments(
    f"SELECT {KEYS}, {hashed_sql(chr(39) + '42' + chr(39), 'installation_id', 'game_session')} % 10 AS fold FROM a"))
def _(spark, folder):
    return pick(L.kfold(assessments_of(spark, folder), 10, 42, LOG.keys), "fold")


def kappa_sql(a: str = "rater_a", b: str = "rater_b") -> str:
    """Grid form, cell by cell."""
    return (f"(SELECT 1 - sum(o * d) / nullif(sum(ea * eb * d) / max(t), 0) FROM (SELECT x, y, CAST((x - y) * (x - y) AS DOUBLE) AS d, "
            f"(SELECT count(*) FROM {{source}} WHERE {a} = x AND {b} = y) AS o, (SELECT count(*) FROM {{source}} WHERE {a} = x) AS ea, "
            f"(SELECT count(*) FROM {{source}} WHERE {b} = y) AS eb, (SELECT count(*) FROM {{source}}) AS t "
            "FROM (SELECT unnest(range(0, 4)) AS x) CROSS JOIN (SELECT unnest(range(0, 4)) AS y)))")


KAPPA = kappa_sql().format(source="ratings")
# Moments per group, from counts rather than from Spark's variance expression.
GROUP_KAPPA = ("1 - avg((rater_a - rater_b) * (rater_a - rater_b)) / nullif(avg(rater_a * rater_a) + avg(rater_b * rater_b) "
               "- 2 * avg(rater_a) * avg(rater_b), 0)")
PER_WORLD = ("\nper AS (SELECT world, " + GROUP_KAPPA
             + " AS kappa, arg_min(weight, game_session) AS weight FROM ratings GROUP BY world)")
FISHER = "0.5 * ln((1 + k) / (1 - k))"


@query("m1_accuracy", on_assessments(
    "SELECT round(avg(CASE WHEN rater_a = rater_b THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM ratings", RATINGS))
def _(spark, folder):
    return M.accuracy(ratings_of(spark, folder), "rater_a", "rater_b")


@query("m2_quadratic_weighted_kappa", on_assessments(f"SELECT round({KAPPA}, 6) AS kappa", RATINGS))
def _(spark, folder):
    return M.quadratic_weighted_kappa(ratings_of(spark, folder), "rater_a", "rater_b")


@query("m2_quadratic_weighted_kappa_grid", on_assessments(f"SELECT round({KAPPA}, 6) AS kappa", RATINGS))
def _(spark, folder):
    return M.quadratic_weighted_kappa_from_grid(ratings_of(spark, folder), "rater_a", "rater_b", 0, 3)


@query("m2_kappa_per_group", on_assessments("SELECT world, round(kappa, 6) AS kappa FROM per", RATINGS, PER_WORLD))
def _(spark, folder):
    return M.quadratic_weighted_kappa(ratings_of(spark, folder), "rater_a", "rater_b", ["world"])


@query("m3_cohen_kappa", on_assessments(
    "SELECT round(1 - (1 - po) / nullif(1 - pe, 0), 6) AS kappa FROM (SELECT "
    "(SELECT avg(CAST(rater_a = rater_b AS DOUBLE)) FROM ratings) AS po, "
    "(SELECT sum(x.n * y.n) / CAST(max(t) * max(t) AS DOUBLE) FROM (SELECT rater_a AS r, count(*) AS n FROM ratings GROUP BY 1) x "
    "JOIN (SELECT rater_b AS r, count(*) AS n FROM ratings GROUP BY 1) y USING (r), (SELECT count(*) AS t FROM ratings)) AS pe)",
    RATINGS))
def _(spark, folder):
    return M.cohen_kappa(ratings_of(spark, folder), "rater_a", "rater_b")


def fisher_mean_sql(weight: str) -> str:
    return on_assessments(
        f"SELECT round((exp(2 * z) - 1) / (exp(2 * z) + 1), 6) AS mean_kappa FROM (SELECT avg({FISHER} * w / mw) AS z FROM "
        f"(SELECT greatest(least(kappa, 0.999), -0.999) AS k, {weight} AS w, avg({weight}) OVER () AS mw FROM per))",
        RATINGS, PER_WORLD)


@query("m4_mean_kappa", fisher_mean_sql("1.0"))
def _(spark, folder):
    per_world = M.quadratic_weighted_kappa(ratings_of(spark, folder), "rater_a", "rater_b", ["world"])
    return M.mean_kappa(per_world, "kappa")


@query("m5_grouped_weighted_kappa", fisher_mean_sql("weight"))
def _(spark, folder):
    return M.grouped_weighted_kappa(ratings_of(spark, folder), "world", "rater_a", "rater_b", "weight", LOG.session)


REPORT = """
cls AS (SELECT unnest(range(0, 4)) AS c),
per_class AS (
  SELECT c, (SELECT count(*) FROM ratings WHERE rater_a = c AND rater_b = c) AS tp,
    (SELECT count(*) FROM ratings WHERE rater_b = c) AS pp, (SELECT count(*) FROM ratings WHERE rater_a = c) AS support FROM cls
),
rep AS (
  SELECT CAST(c AS VARCHAR) AS class, coalesce(tp / CAST(nullif(pp, 0) AS DOUBLE), 0) AS precision,
    coalesce(tp / CAST(nullif(support, 0) AS DOUBLE), 0) AS recall,
    coalesce(2.0 * tp / CAST(nullif(pp + support, 0) AS DOUBLE), 0) AS f1, support FROM per_class
)"""
ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in ("precision", "recall", "f1"))


@query("m6_classification_report", on_assessments(
    f"SELECT class, {ROUNDED}, support FROM rep UNION ALL "
    "SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM rep "
    "UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), "
    "round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM rep", RATINGS, REPORT))
def _(spark, folder):
    return M.classification_report(ratings_of(spark, folder), "rater_a", "rater_b")


@query("m7_improvement_pct", on_assessments(
    f"SELECT round(100.0 * (({KAPPA}) - base) / base, 6) AS improvement FROM "
    "(SELECT avg(CASE WHEN rater_a = rater_b THEN 1.0 ELSE 0.0 END) AS base FROM ratings)", RATINGS))
def _(spark, folder):
    """Gain of the kappa over the plain accuracy of the same ratings."""
    scores = ratings_of(spark, folder).agg(
        M.quadratic_kappa_of("rater_a", "rater_b").alias("score"), M.accuracy_of("rater_a", "rater_b").alias("base"))
    return scores.select(M.improvement_pct(F.col("score"), F.col("base")).alias("improvement"))


LONG = """,
long AS (
  SELECT 'previous' AS model, world AS split, rater_a, rater_b FROM ratings
  UNION ALL SELECT 'weight', world, rater_a, weight FROM ratings
)"""


@query("m8_compare_models", on_assessments(
    f"SELECT model, split, round({GROUP_KAPPA}, 6) AS kappa, "
    "round(avg(CASE WHEN rater_a = rater_b THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM long GROUP BY model, split",
    RATINGS + LONG))
def _(spark, folder):
    """Two rules that guess the label, compared per world."""
    ratings = ratings_of(spark, folder)
    guess = lambda name, column: ratings.select(
        F.lit(name).alias("model"), F.col("world").alias("split"), "rater_a", F.col(column).cast("bigint").alias("rater_b"))
    both = guess("previous", "rater_b").unionByName(guess("weight", "weight"))
    return M.compare_models(both, "rater_a", "rater_b", ["model", "split"])
