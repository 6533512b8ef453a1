"""Learners built from other learners: ordinal, voting, adaptive boosting, resample-and-vote, stacking."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtrace.models.histograms import AdaptiveBoosting, Column as CountColumn, binned, with_bins, with_scores  # noqa: F401
from playtrace.models.learners import Predictor, argmax, logistic
from playtrace.models.neighbours import NeighbourLearner
from playtrace.operators.aggregates import row_mode
from playtrace.operators.sampling import ClassIndex, kfold
from playtrace.runtime import materialize

# --- ordinal ---


def ordinal_scores(above: list[Column]) -> Column:
    """Class scores from the chances of lying above each class but the last.

    First class 1 - p0, then differences of neighbours, last class the last chance. Differences may be negative.
    """
    inner = [above[i - 1] - above[i] for i in range(1, len(above))]
    return F.array(1 - above[0], *inner, above[-1])


@dataclass
class OrdinalModel(Predictor):
    models: list[Predictor]

    def scores(self, df: DataFrame, name: str) -> DataFrame:
        chances = [f"_above_{i}" for i in range(len(self.models))]
        for chance, model in zip(chances, self.models):
            df = model.scores(df, chance)
        return df.withColumn(name, ordinal_scores([F.col(c)[1] for c in chances])).drop(*chances)


@dataclass
class OrdinalLearner:
    """One binary fit per class border; labels must be 0..k-1 with k above 2."""

    base: object
    classes: int

    def fit(self, train: DataFrame) -> OrdinalModel:
        if self.classes < 3:
            raise ValueError("an ordinal classifier needs at least three classes")
        border = lambda c: train.withColumn("label", (F.col("label") > c).cast("double"))
        return OrdinalModel([self.base.fit(border(c)) for c in range(self.classes - 1)])


# --- voting ---


def hard_vote(votes: DataFrame, keys: list[str], choice: str, weight: str | None = None) -> DataFrame:
    """Choice with the largest weight sum per key from long votes; ties go to the smallest choice."""
    amount = F.sum(weight) if weight else F.count(F.lit(1))
    sums = votes.groupBy(*keys, choice).agg(amount.alias("amount"))
    best = F.max(F.struct("amount", (-F.col(choice)).alias("minus"))).alias("best")
    return sums.groupBy(*keys).agg(best).select(*keys, (-F.col("best.minus")).alias(choice))


def weighted_vote(predictions: list[Column], weights: list[float], classes: int) -> Column:
    """Class with the largest weight among the predictions of one row; ties go to the smallest class."""
    if len(predictions) != len(weights):
        raise ValueError(f"{len(predictions)} predictions but {len(weights)} weights")
    share = lambda c: reduce(
        lambda x, y: x + y, [F.when(p == c, F.lit(float(w))).otherwise(0.0) for p, w in zip(predictions, weights)])
    return argmax(F.array(*[share(c) for c in range(classes)]))


@dataclass
class VotingModel:
    """Hard vote of models that are fitted already."""

    models: list[Predictor]
    classes: int
    weights: list[float] | None = None

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        votes = [f"_vote_{i}" for i in range(len(self.models))]
        for vote, model in zip(votes, self.models):
            df = model.predict(df, vote)
        weights = self.weights or [1.0] * len(votes)
        return df.withColumn(name, weighted_vote([F.col(v) for v in votes], weights, self.classes)).drop(*votes)


# --- resample and vote ---


def resample_and_vote(
    train: DataFrame, test: DataFrame, learner, keys: list[str], rounds: int = 40, mode: str = "over",
    seed: int = 42, compound: bool = False,
) -> DataFrame:
    """Fit one model per balanced resample and take the most frequent prediction per test row.

    ``train`` has keys, ``features`` and ``label``. A resample is how often each of its rows is drawn, one number a round in an
    array, so all rounds read one table. Learners with ``fit_weighted`` grow the models of all rounds together; others get
    the number as ``weightCol``, or copies of the rows where they have none. With ``compound`` each round resamples the rows drawn
    in the round before and is written, otherwise every round draws from ``train``. Adds ``pred_0..`` and ``prediction`` to ``test``.
    """
    names = [f"pred_{i}" for i in range(rounds)]
    if compound:
        models = list(_compound_models(train, learner, keys, rounds, mode, seed))
    else:
        counted = ClassIndex(train, "label", keys).draw_counts(mode, [seed + i for i in range(rounds)])
        if hasattr(learner, "fit_weighted"):
            table = binned(counted, learner.classes, keys)
            models = learner.fit_weighted(table, CountColumn("draws"), rounds, ["draws"])
            judged = with_scores(with_bins(test, table.edges), {n: [m] for n, m in zip(names, models)})
            judged = judged.select(*test.columns, *[argmax(F.col(n)).alias(n) for n in names])
            return row_mode(judged, names, "prediction")
        counted = materialize(counted, "drawn")
        models = [_weighted_fit(learner, counted, i) for i in range(rounds)]
    for name, model in zip(names, models):
        test = model.predict(test, name)
    return row_mode(test, names, "prediction")


def _weighted_fit(learner, counted: DataFrame, i: int) -> Predictor:
    """A model of the rows that round ``i`` draws, as often as it draws them."""
    drawn = counted.withColumn("weight", F.col("draws")[i].cast("double")).filter("weight > 0").drop("draws")
    if getattr(learner, "estimator", None) is not None and learner.estimator.hasParam("weightCol"):
        weighted = replace(learner, estimator=learner.estimator.copy({learner.estimator.getParam("weightCol"): "weight"}))
        return weighted.fit(drawn)
    return learner.fit(drawn.withColumn("weight", F.explode(F.array_repeat(F.lit(1.0), F.col("weight").cast("int")))))


def _compound_models(train: DataFrame, learner, keys: list[str], rounds: int, mode: str, seed: int):
    index = ClassIndex(train, "label", keys)
    for i in range(rounds):
        drawn = materialize(index.draw(mode, seed + i).select("features", "label", "draw"), "drawn")
        index = ClassIndex(drawn.withColumnRenamed("draw", "_drawn"), "label", ["_drawn"])
        yield learner.fit(drawn)


# --- stacking ---


@dataclass
class StackedModel(Predictor):
    bases: list[Predictor]
    meta: Predictor

    def base_scores(self, df: DataFrame, names: list[str]) -> DataFrame:
        """Class scores of each base learner, as columns of the given names next to those of ``df``."""
        for name, base in zip(names, self.bases, strict=True):
            df = base.scores(df, name)
        return df

    def scores(self, df: DataFrame, name: str) -> DataFrame:
        bases = [f"_base_{i}" for i in range(len(self.bases))]
        wide = self.base_scores(df, bases).withColumnRenamed("features", "_own").withColumn("features", array_to_vector(F.concat(*bases)))
        return self.meta.scores(wide, name).drop("features", *bases).withColumnRenamed("_own", "features")


@dataclass
class StackedLearner:
    """Out-of-fold scores of the base learners train a logistic one-against-rest learner on top.

    Learners with ``fit_folds`` fit all folds and the final model together over one binned table, neighbours are looked up in one
    index that leaves out a row's own fold; others are fitted once for each fold.
    """

    bases: list
    keys: list[str]
    folds: int = 10
    seed: int = 42
    meta: object = field(default_factory=lambda: logistic(one_vs_rest=True))

    def _fitted(self, train: DataFrame) -> tuple[DataFrame, list[Predictor]]:
        """(keys, fold, label and ``_base_i`` of every row from models that have not seen its fold; models of all rows)."""
        names = [f"_base_{i}" for i in range(len(self.bases))]
        together = {n: b for n, b in zip(names, self.bases) if hasattr(b, "fit_folds")}
        indexed = {n: b for n, b in zip(names, self.bases) if isinstance(b, NeighbourLearner)}
        apart = {n: b for n, b in zip(names, self.bases) if n not in together and n not in indexed}
        folded = kfold(train, self.folds, self.seed, self.keys)
        final = {}
        if together:
            table = binned(folded, next(iter(together.values())).classes, self.keys)
            # Each fit is a chain of small jobs; chains of different learners run side by side.
            with ThreadPoolExecutor(len(together)) as pool:
                fits = list(pool.map(lambda base: base.fit_folds(table, self.folds), together.values()))
            rows, models = table.rows, dict(zip(together, fits))
            final |= {n: fitted[-1] for n, fitted in models.items()}
            rows = with_scores(rows, {n: fitted[:-1] for n, fitted in models.items()})
        else:
            rows = folded
        rows = materialize(rows, "folds")
        if apart:
            parts = []
            for fold in range(self.folds):
                seen, held = rows.filter(F.col("fold") != fold), rows.filter(F.col("fold") == fold)
                for name, base in apart.items():
                    held = base.fit(seen).scores(held, name)
                parts.append(held)
            rows = materialize(reduce(DataFrame.unionByName, parts), "folds")
            final |= {n: b.fit(train) for n, b in apart.items()}
        for name, base in indexed.items():
            final[name] = base.fit(rows, "fold")
            rows = materialize(final[name].scores(rows, name), "folds")
        return rows.select(*self.keys, "fold", "label", *names), [final[n] for n in names]

    def out_of_fold(self, train: DataFrame) -> DataFrame:
        """Class scores ``_base_i`` of every row by each base learner, from models that have not seen its fold."""
        return self._fitted(train)[0]

    def fit(self, train: DataFrame) -> StackedModel:
        rows, models = self._fitted(train)
        joint = array_to_vector(F.concat(*[f"_base_{i}" for i in range(len(self.bases))]))
        return StackedModel(models, self.meta.fit(rows.select(joint.alias("features"), "label")))
