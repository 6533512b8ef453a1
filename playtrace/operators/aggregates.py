"""Counts, proportions, histograms, per-title means and correlations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from playtrace.config import DEFAULT_LOG, EventLog
from playtrace.functions.json import json_field
from playtrace.functions.scalars import is_assessment


def join_on_keys(rows: DataFrame, measures: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys that may be null: a null key is a key of its own, as grouping takes it."""
    names = {k: f"_key_{k}" for k in keys}
    right = measures.select(*[F.col(k).alias(n) for k, n in names.items()], *[c for c in measures.columns if c not in keys])
    same = None
    for k, n in names.items():
        equal = F.col(k).eqNullSafe(F.col(n))
        same = equal if same is None else same & equal
    return rows.join(right, same, "left").drop(*names.values())


def session_totals(events: DataFrame, log: EventLog = DEFAULT_LOG, only_assessments: bool = False) -> DataFrame:
    """Largest play time and event counter of the session on each of its events.

    With ``only_assessments`` the totals are null on other rows. Aggregate and join back, see
    ``sessions.with_session_measures``.
    """
    source = events.filter(is_assessment(log)) if only_assessments else events
    totals = source.groupBy(*log.keys).agg(
        F.max(log.elapsed).alias("total_game_session_time"), F.max(log.count).alias("total_game_session_events"))
    if not only_assessments:
        return join_on_keys(events, totals, log.keys)
    names = {"total_game_session_time": "assessment_session_time",
             "total_game_session_events": "assessment_number_of_events"}
    joined = join_on_keys(events, totals, log.keys)
    columns = [F.when(is_assessment(log), F.col(old)).alias(new) for old, new in names.items()]
    return joined.select(*events.columns, *columns)


def session_mean_of_field(events: DataFrame, field: str, log: EventLog = DEFAULT_LOG) -> DataFrame:
    """Mean of a numeric payload field per assessment session; nulls skipped."""
    value = json_field(F.col(log.payload), field, "double")
    return events.filter(is_assessment(log)).groupBy(*log.keys).agg(F.avg(value).alias(f"mean_{field}"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def class_proportions(df: DataFrame, column: str) -> DataFrame:
    """Share of each value, smallest first."""
    counts = value_counts(df, column)
    share = F.col("n") / counts.agg(F.sum("n")).scalar()
    return counts.select(column, "n", share.alias("proportion")).orderBy("proportion", column)


RANGE_BLOCK = 100_000


def _rating_bounds(df: DataFrame, columns: list[str], low: int | None, high: int | None) -> DataFrame:
    """One row (lo, hi): smallest and largest rating found in ``columns``, or the given bounds; none without ratings."""
    low_c = F.min(F.least(*[F.col(c) for c in columns])) if len(columns) > 1 else F.min(columns[0])
    high_c = F.max(F.greatest(*[F.col(c) for c in columns])) if len(columns) > 1 else F.max(columns[0])
    bounds = df.agg(
        (F.lit(low) if low is not None else low_c).cast("int").alias("lo"),
        (F.lit(high) if high is not None else high_c).cast("int").alias("hi"),
    )
    return bounds.filter("lo is not null and hi is not null and lo <= hi")


def rating_grid(df: DataFrame, columns: list[str], low: int | None = None, high: int | None = None) -> DataFrame:
    """Every rating from the smallest to the largest found in ``columns`` (or between the given bounds)."""
    return _every_number(_rating_bounds(df, columns, low, high), "rating").select("rating")


def _every_number(bounds: DataFrame, name: str) -> DataFrame:
    """A row for each number from ``lo`` to ``hi`` of each row; long ranges are dealt over the cluster before they are numbers."""
    blocks = bounds.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(cast(hi as bigint) - lo) div {RANGE_BLOCK}"))).alias("_block"))
    start = F.col("lo").cast("bigint") + F.col("_block") * RANGE_BLOCK
    numbers = F.sequence(start, F.least(start + RANGE_BLOCK - 1, F.col("hi").cast("bigint")))
    return blocks.repartition("_block").select("*", F.explode(numbers).alias(name)).withColumn(name, F.col(name).cast("int")).drop("_block")


def rating_histogram(df: DataFrame, column: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """Count of each rating, zero for the ones that do not occur."""
    counts = value_counts(df.select(F.col(column).cast("int").alias("rating")), "rating")
    return rating_grid(df, [column], low, high).join(counts, "rating", "left").na.fill(0, ["n"])


def confusion_matrix(
    df: DataFrame, a: str, b: str, low: int | None = None, high: int | None = None
) -> DataFrame:
    """Dense counts for every pair of ratings, in long form."""
    counts = df.groupBy(F.col(a).cast("int").alias("a"), F.col(b).cast("int").alias("b")).agg(
        F.count(F.lit(1)).alias("n"))
    bounds = _rating_bounds(df, [a, b], low, high)
    grid = _every_number(_every_number(bounds, "a"), "b").select("a", "b")
    return grid.join(counts, ["a", "b"], "left").na.fill(0, ["n"])


def confusion_matrix_wide(df: DataFrame, a: str, b: str, ratings: list[int]) -> DataFrame:
    """One row per rating of ``a``, one column per rating of ``b``."""
    cells = [F.coalesce(F.sum((F.col(b) == r).cast("bigint")), F.lit(0)).alias(f"b_{r}") for r in ratings]
    return df.filter(F.col(a).isin(ratings)).groupBy(F.col(a).alias("a")).agg(*cells)


def least_frequent(df: DataFrame, column: str) -> DataFrame:
    """The rarest value; of equally rare ones the smallest."""
    return value_counts(df, column).orderBy("n", column).limit(1)


def class_count_range(df: DataFrame, label: str) -> DataFrame:
    return value_counts(df, label).agg(F.min("n").alias("smallest"), F.max("n").alias("largest"))


def modes(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Most frequent value per key; ties go to the smallest."""
    counts = df.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("n"))
    best = F.max(F.struct(F.col("n"), (-F.col(column)).alias("minus"))).alias("best")
    return counts.groupBy(*keys).agg(best).select(*keys, (-F.col("best.minus")).alias(column))


def row_mode(df: DataFrame, columns: list[str], name: str = "mode") -> DataFrame:
    """Most frequent value across the columns of a row, nulls skipped; ties go to the smallest."""
    values = F.array_compact(F.array(*columns))
    scored = F.transform(
        F.array_distinct(values),
        lambda v: F.struct(F.size(F.filter(values, lambda w: w == v)).alias("n"), (-v).alias("minus")),
    )
    return df.withColumn(name, -F.array_max(scored)["minus"])


def paste_collapse(df: DataFrame, keys: list[str], order: str, text: str, collapse: str) -> DataFrame:
    """One string per key from the texts of its rows in ``order``; the value is as long as the key's texts together."""
    pair = F.struct(F.col(order).alias("o"), F.col(text).alias("t"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(pair)), lambda p: p["t"]), collapse)
    return df.groupBy(*keys).agg(joined.alias(text))


def first_by(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Value of the first row of each group."""
    return df.groupBy(*keys).agg(F.min_by(value, order).alias(value))


def numeric_columns(df: DataFrame, skip: set[str] = frozenset()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.NumericType, T.BooleanType)) and f.name not in skip]


def feature_label_correlation(df: DataFrame, label: str, features: list[str] | None = None) -> DataFrame:
    """Pearson correlation of each feature with the label over rows where both are known.

    One pass for all features: each row becomes one (feature, x, y) a feature, and one small aggregate a feature
    combines before the shuffle. Moments around each column's own mean are kept by ``covar_pop``/``var_pop``; a constant
    feature has no correlation (null) instead of a division by zero. ``features`` None means all numeric columns, an empty
    list none.
    """
    features = numeric_columns(df, {label}) if features is None else features
    every = df.sparkSession.createDataFrame([(i, n) for i, n in enumerate(features)], "place int, feature string")
    y = F.col(label).cast("double")
    values = F.array(*[F.nanvl(F.col(f"`{n}`").cast("double"), F.lit(None)) for n in features]) if features else F.array().cast("array<double>")
    long = df.select(y.alias("y"), F.posexplode(values).alias("place", "x"))
    known = F.when(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("y"), True)
    xs, ys = F.when(known, F.col("x")), F.when(known, F.col("y"))
    spread = F.sqrt(F.var_pop(xs)) * F.sqrt(F.var_pop(ys))
    found = long.groupBy("place").agg(F.try_divide(F.covar_pop(xs, ys), spread).alias("correlation"))
    return every.join(found, "place", "left").select("feature", "correlation")


def strong_correlations(
    df: DataFrame, label: str, threshold: float = 0.05, features: list[str] | None = None
) -> DataFrame:
    """Features whose absolute correlation with the label exceeds ``threshold``; null correlations do not."""
    return feature_label_correlation(df, label, features).filter(F.abs("correlation") > threshold)


def correlated_features(df: DataFrame, label: str, threshold: float = 0.05, features: list[str] | None = None) -> list[str]:
    """Names of the strongly correlated features, in column order."""
    kept = strong_correlations(df, label, threshold, features).select("feature").collect()  # one row per column
    names = {r["feature"] for r in kept}
    return [c for c in df.columns if c in names]


def keep_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns of ``df`` that are in ``names``, in their own order."""
    wanted = set(names)
    return df.select(*[c for c in df.columns if c in wanted])
