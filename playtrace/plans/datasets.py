"""Training, prediction and hold-out sets from a feature table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtrace.config import DEFAULT_LOG, EventLog
from playtrace.operators.scan import OrderedScan, position
from playtrace.operators.sessions import first_order
from playtrace.runtime import materialize


def join_blocks(blocks: list[DataFrame], log: EventLog = DEFAULT_LOG) -> DataFrame:
    """Inner join of feature blocks; each has at most one row per session, so order does not matter."""
    return reduce(lambda left, right: left.join(right, log.keys, "inner"), blocks)


def ranked_from_last(assessments: DataFrame, log: EventLog = DEFAULT_LOG) -> DataFrame:
    """Assessment sessions with ``from_last``: 1 for the last by first appearance, 2 for the one before."""
    scan = OrderedScan(assessments, [log.entity], first_order(log), descending=True)
    return scan.with_running(from_last=position()).result()


def last_assessment(assessments: DataFrame, log: EventLog = DEFAULT_LOG) -> DataFrame:
    """Last assessment session of each entity; a plain aggregate, so a hot entity needs no ordering."""
    place = F.max(F.struct(*first_order(log))).alias("last")
    return assessments.groupBy(log.entity).agg(place).select(log.entity, F.col(f"last.{log.session}"))


def second_last_assessment(assessments: DataFrame, log: EventLog = DEFAULT_LOG) -> DataFrame:
    """Second-last assessment with its label; entities with a single assessment have none."""
    return ranked_from_last(assessments, log).filter("from_last = 2").select(*log.keys, "accuracy_group")


def all_but_second_last_assessment(
    assessments: DataFrame, drop: str = "second_last", log: EventLog = DEFAULT_LOG
) -> DataFrame:
    """Every assessment with its label except the second-last, or with ``drop='last'`` except the last.

    The original function is named after the last one but leaves out the second-last; that is the default.
    """
    left_out = {"second_last": 2, "last": 1}[drop]
    return ranked_from_last(assessments, log).filter(F.col("from_last") != left_out).select(*log.keys, "accuracy_group")


def training_set(features: DataFrame, labels: DataFrame, log: EventLog = DEFAULT_LOG) -> DataFrame:
    return features.join(labels.select(*log.keys, "accuracy_group"), log.keys, "inner")


def prediction_set(features: DataFrame, targets: DataFrame, log: EventLog = DEFAULT_LOG) -> DataFrame:
    """Every target session, with null features where it has none."""
    return features.join(targets.select(*log.keys), log.keys, "right")


def target_features(targets: DataFrame, features: DataFrame, log: EventLog = DEFAULT_LOG) -> DataFrame:
    """Target sessions on the left, their features where present."""
    return targets.select(*log.keys).join(features, log.keys, "left")


def members_of_both(features: DataFrame, targets: DataFrame, log: EventLog = DEFAULT_LOG) -> DataFrame:
    """Rows whose session is among the targets' sessions and whose entity is among their entities."""
    for key in (log.session, log.entity):
        features = features.join(targets.select(key).distinct(), key, "left_semi")
    return features


def restrict_to(features: DataFrame, ids: DataFrame, log: EventLog = DEFAULT_LOG) -> DataFrame:
    return features.join(ids.select(*log.keys), log.keys, "left_semi")


def at_group_extreme(df: DataFrame, keys: list[str], column: str, largest: bool = True) -> DataFrame:
    """Rows whose value equals the largest (smallest) of their group.

    Aggregate and join back: the group's rows never meet in one task.
    """
    extreme = df.groupBy(*keys).agg((F.max if largest else F.min)(column).alias(column))
    return df.join(extreme, [*keys, column], "left_semi")


def holdout_split(
    features: DataFrame, latest_by: str = "assessments_played", log: EventLog = DEFAULT_LOG
) -> tuple[DataFrame, DataFrame]:
    """(rows before the latest assessment of their entity, the latest ones). The features are written once."""
    features = materialize(features, "features")
    latest = at_group_extreme(features, [log.entity], latest_by)
    ids = latest.select(log.session).distinct()
    return features.join(ids, log.session, "left_anti"), latest
