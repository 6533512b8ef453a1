"""Partial stripes: a row for each part of a piece of text, however many prefixes are frequent."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from playtrace.llm import collocations

ALL = np.full(64, ~np.uint64(0))
NONE = np.zeros(64, np.uint64)


def words_of(size):
    return [f"w{k * k % size}" for k in range(5 * size)]


def entries_of(batches):
    found = Counter()
    for batch in batches:
        for r in batch.to_pylist():
            prefixes, nexts = r["prefixes"].split("\n"), r["nexts"].split(" ")
            assert len(r["owners"]) == len(nexts) == len(r["counts"]) and set(r["owners"]) == set(range(len(prefixes)))
            for owner, word, n in zip(r["owners"], nexts, r["counts"]):
                found[prefixes[owner], word] += n
    return found


@pytest.mark.parametrize("words", range(5))
@pytest.mark.parametrize("hot", [None, ALL, NONE])
def test_rows_do_not_grow_with_the_frequent_prefixes(words, hot):
    rows = []
    for size in (3001, 12007):  # so many different words, 1501 and 6004 of them used
        said = words_of(size)
        batches = list(collocations.partial_stripes("x", pa.array([" ".join(said), None, ""]), words, [ALL, ALL], hot))
        rows.append(sum(len(b) for b in batches))
        seen = Counter((" ".join(said[i : i + words]), said[i + words] if i + words < len(said) else collocations.REST) for i in range(len(said) - words + (words > 0)))
        assert entries_of(batches) == seen
    assert max(rows) <= 4096


def test_equal_prefixes_meet_in_one_part_unless_hot():
    def parts(hot, said):
        return {r["part"] for b in collocations.partial_stripes("x", pa.array([said]), 1, [ALL, ALL], hot) for r in b.to_pylist() if "a" in r["prefixes"].split("\n")}

    one, other = " ".join(f"a b{k}" for k in range(300)), " ".join(f"a c{k}" for k in range(300))
    assert parts(NONE, one) == parts(NONE, other) and len(parts(NONE, one)) == 1
    assert 1 < len(parts(ALL, one) | parts(ALL, other)) <= collocations.STRIPE_PARTS
