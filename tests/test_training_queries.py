"""The trained queries ask for the whole of what their operators do; the fits themselves are stood in for."""

import pytest

from playtrace.checks import training as T
from playtrace.checks.registry import QUERIES
from playtrace.models.neighbours import NeighbourLearner


class Asked(Exception):
    """Carries what a query asked for."""


@pytest.fixture
def asked(spark, monkeypatch):
    monkeypatch.setattr(T, "game_sets", lambda *_: ("train", "test", ["feature"]))

    def of(name, owner, attribute):
        def stop(*args, **settings):
            raise Asked(args, settings)

        monkeypatch.setattr(owner, attribute, stop)
        with pytest.raises(Asked) as told:
            QUERIES[name](spark, "")
        return told.value.args

    return of


def test_the_stack_holds_all_base_learners(asked):
    (learner, _), _ = asked("t12_stacking", T.C.StackedLearner, "fit")
    tree, near, boosted, bagged, forest = learner.bases
    assert learner.folds == 10 and isinstance(near, NeighbourLearner) and boosted.rounds == 50
    assert [m.depth for m in (tree, bagged, forest)] == [5, 5, 5]
    assert bagged.trees == forest.trees == 10 and (bagged.subset, forest.subset) == ("all", "sqrt")


def test_sweep_search_and_boosting_use_their_own_defaults(asked):
    assert asked("t16_tree_count_sweep", T.P, "tree_count_sweep") == (("train", "test"), {})
    assert asked("t17_random_search", T.P, "random_search") == (("train",), {"keys": T.LOG.keys})
    (learner, train), _ = asked("t6_adaptive_boosting", T.C.AdaptiveBoosting, "fit")
    assert learner.rounds == 50 and train == "train"
