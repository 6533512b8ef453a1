"""Agreement and classification metrics as single aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def accuracy_of(a: str, b: str) -> Column:
    """Share of rows on which both agree."""
    return F.avg((F.col(a) == F.col(b)).cast("double"))


def quadratic_kappa_of(a: str, b: str) -> Column:
    """Quadratic weighted kappa as one aggregate expression.

    The grid's squared-distance weights share one constant, so it cancels and only moments remain. Null when
    the ratings leave no expected disagreement.
    """
    x, y = F.col(a).cast("int").cast("double"), F.col(b).cast("int").cast("double")
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    observed = F.avg((x - y) * (x - y))
    expected = F.var_pop(x) + F.var_pop(y) + (F.avg(x) - F.avg(y)) * (F.avg(x) - F.avg(y))
    return 1 - F.try_divide(observed, expected)


def quadratic_kappa_of_counts(a: str, b: str, n: str) -> Column:
    """``quadratic_kappa_of`` where a row stands for ``n`` pairs of known ratings."""
    x, y, w = (F.col(c).cast("double") for c in (a, b, n))
    size, apart = F.sum(w), F.sum(w * (x - y) * (x - y))
    return 1 - F.try_divide(apart * size, size * F.sum(w * (x * x + y * y)) - 2 * F.sum(w * x) * F.sum(w * y))


def accuracy(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(accuracy_of(a, b).alias("accuracy"))


def quadratic_weighted_kappa(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(quadratic_kappa_of(a, b).alias("kappa"))


def _cells(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of each pair of known ratings: one pass, ratings x ratings rows, from which the rest is derived."""
    x, y = F.col(a).cast("int"), F.col(b).cast("int")
    return df.where(x.isNotNull() & y.isNotNull()).groupBy(x.alias("a"), y.alias("b")).agg(F.count(F.lit(1)).alias("n"))


def quadratic_weighted_kappa_from_grid(
    df: DataFrame, a: str, b: str, low: int | None = None, high: int | None = None
) -> DataFrame:
    """The same from the sparse counts of rating pairs and the sums of both margins; ratings outside the given bounds do not count."""
    cells = _cells(df, a, b)
    for name in ("a", "b"):
        cells = cells.where((F.lit(True) if low is None else F.col(name) >= low) & (F.lit(True) if high is None else F.col(name) <= high))
    # Squared distances of all pairs of two margins need the margins' sums, sums of squares and sizes only; all exact.
    n, x, y = (F.col(c).cast("decimal(19,0)") for c in ("n", "a", "b"))
    sums = {"all": n, "x": n * x, "y": n * y, "xx": n * (x * x), "yy": n * (y * y), "apart": n * ((x - y) * (x - y))}
    totals = cells.agg(*[F.sum(v.cast("decimal(38,0)")).alias(k) for k, v in sums.items()])
    wide = lambda name: F.col(name).cast("double")
    expected = F.expr("cast(`all` * (xx + yy) as decimal(38,0)) - cast(2 * x * y as decimal(38,0))").cast("double")
    return totals.select((1 - F.try_divide(wide("apart") * wide("all"), expected)).alias("kappa"))


def cohen_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Unweighted kappa: one minus the ratio of observed to chance disagreement, over rows with both ratings."""
    none = F.lit(0).cast("bigint")
    side = lambda rating, of_a, of_b, same: F.struct(F.col(rating).alias("rating"), of_a.alias("of_a"), of_b.alias("of_b"), same.alias("same"))
    n = F.col("n")
    both = F.array(side("a", n, none, F.when(F.col("a") == F.col("b"), n).otherwise(none)), side("b", none, n, none))
    margins = _cells(df, a, b).select(F.inline(both)).groupBy("rating").agg(*[F.sum(c).cast("double").alias(c) for c in ("of_a", "of_b", "same")])
    totals = margins.agg(F.sum("of_a").alias("all"), F.sum("same").alias("agree"), F.sum(F.col("of_a") * F.col("of_b")).alias("chance"))
    total = F.col("all")
    return totals.select((1 - F.try_divide(1 - F.try_divide(F.col("agree"), total), 1 - F.try_divide(F.col("chance"), total * total))).alias("kappa"))


def mean_kappa(df: DataFrame, kappa: str, weight: str | None = None) -> DataFrame:
    """Mean of kappas after Fisher's transform, each clamped to ±0.999; weights are divided by their mean.

    The mean of z·w over rows divided by the mean of w is the ratio of the two sums. Unknown kappas (null) and
    their weights do not count; without any known kappa the mean is null.
    """
    known = F.col(kappa).isNotNull() & ~F.isnan(F.col(kappa).cast("double"))
    k = F.when(known, F.least(F.greatest(F.col(kappa).cast("double"), F.lit(-0.999)), F.lit(0.999)))
    z = 0.5 * F.log((1 + k) / (1 - k))
    w = F.when(known, F.lit(1.0) if weight is None else F.col(weight).cast("double"))
    average = F.try_divide(F.sum(z * w), F.sum(w))
    return df.agg(average.alias("z")).select(F.tanh("z").alias("mean_kappa"))


def grouped_weighted_kappa(df: DataFrame, group: str, a: str, b: str, weight: str, order: str) -> DataFrame:
    """Quadratic kappa per group, then their mean weighted with the first weight of each group."""
    per_group = df.groupBy(group).agg(
        quadratic_kappa_of(a, b).alias("kappa"), F.min_by(weight, order).alias("weight"))
    return mean_kappa(per_group, "kappa", "weight")


def _scores(hits: Column, predicted: Column, support: Column) -> dict[str, Column]:
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    precision = zero(F.try_divide(hits.cast("double"), predicted))
    recall = zero(F.try_divide(hits.cast("double"), support))
    f1 = zero(F.try_divide(2.0 * hits, predicted + support))
    return {"precision": precision, "recall": recall, "f1": f1}


def classification_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall, f1 and support per class, then their plain and support-weighted means."""
    cells = df.groupBy(F.col(truth).cast("int").alias("t"), F.col(predicted).cast("int").alias("p")).agg(
        F.count(F.lit(1)).alias("n"))  # classes × classes rows
    # Each cell counts for its true class and for its predicted class.
    sides = cells.select(F.explode(F.array(
        F.struct(F.col("t").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"),
                 F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hits")),
        F.struct(F.col("p").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"),
                 F.lit(0).cast("bigint").alias("hits")),
    )).alias("s")).select("s.*")
    sums = sides.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])
    per_class = sums.select(
        F.col("class").cast("string").alias("class"),
        *[c.alias(n) for n, c in _scores(F.col("hits"), F.col("predicted"), F.col("support")).items()],
        "support",
    )
    names = ["precision", "recall", "f1"]
    weighted = [F.try_divide(F.sum(F.col(n) * F.col("support")), F.sum("support")).alias(n) for n in names]
    macro = per_class.agg(*[F.avg(n).alias(n) for n in names], F.sum("support").alias("support"))
    weight = per_class.agg(*weighted, F.sum("support").alias("support"))
    return (
        per_class
        .unionByName(macro.select(F.lit("macro avg").alias("class"), *names, "support"))
        .unionByName(weight.select(F.lit("weighted avg").alias("class"), *names, "support"))
    )


def improvement_pct(score: Column, base: Column) -> Column:
    """Gain of ``score`` over ``base`` in percent of ``base``."""
    return F.try_divide(100.0 * (score - base), base)


def compare_models(predictions: DataFrame, truth: str, prediction: str, by: list[str]) -> DataFrame:
    """Kappa and accuracy of every (model, split) from one long table of predictions."""
    return predictions.groupBy(*by).agg(
        quadratic_kappa_of(truth, prediction).alias("kappa"), accuracy_of(truth, prediction).alias("accuracy"))
