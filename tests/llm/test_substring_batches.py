"""Passages near repeated anchors: handed on in few tables, at the starts that a plain search finds."""

import numpy as np
import pandas as pd

from playtrace.llm import substring


class Joined:
    """Runs what it is given on one frame of texts."""

    def mapInPandas(self, run, kind):
        text = " ".join(f"w{i}" for i in range(60))
        frame = pd.DataFrame({"doc": range(50), "text": [text] * 50, "single": [None] * 50})
        return list(run(iter([frame])))


def test_candidates_of_many_texts_are_one_table():
    tables = substring._candidates(Joined(), 20)
    assert len(tables) == 1 and len(tables[0]) == 50 * 41
    assert tables[0].groupby("doc").size().eq(41).all() and tables[0].groupby(["h1", "h2"]).size().eq(50).all()


def test_candidate_starts_equal_a_plain_search():
    rng = np.random.default_rng(2)
    for n_words in (0, 7, 8, 19, 20, 21, 90):
        places = substring.anchor_places(n_words, 8)
        for share in (0.0, 0.5, 0.95, 1.0):
            single = places[rng.random(len(places)) < share]
            repeated = set(places.tolist()) - set(single.tolist())
            plain = [s for s in range(n_words - 19) if any(s <= p <= s + substring.PERIOD - 1 for p in repeated)]
            assert substring.candidate_starts(n_words, single, 20).tolist() == plain
