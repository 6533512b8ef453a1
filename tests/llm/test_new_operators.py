"""Phrases, languages and manifests: brute force, edge cases; words that used to clash."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from playtrace.llm import collocations, language, lexing, merkle, minhash, substring

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHING = ["tree", "leaf", "place", "n", "digest", "path", "prefix", "stripe", "part", "phrase", "words", "bucket", "next", "counts", "score", "lettered"]


@pytest.fixture(scope="module")
def messy_rows():
    rng = random.Random(11)
    say = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    north, south = ["thing", "with", "those", "water", "shall", "north"], ["quella", "zona", "dolce", "altro", "qualche", "zuppa"]
    rows = [(i, say(north if i % 2 else south, 30) + (". " if i % 3 else "\n") + say(north if i % 2 else south, 9), "no" if i % 2 else "so", f"s{i % 4}", i) for i in range(60)]
    rows += [(100, None, "no", None, None), (101, "", None, "s", 0), (102, " \t\n ", "so", "s", 3), (103, "12 34 !!", "no", "s", 8), (None, say(north, 12), None, "s", 1), (None, None, None, None, None)]
    rows += [(104, say(north, 25), None, "s", 5)] * 3 + [(105, "Thing WITH those.", "no", "s", 1)] * 2
    rows += [(106, "\n".join(say(south, 50) for _ in range(2000)), "so", "s", 1), (107, "é ü \U0001f600 One", "é", "s", 2)]
    return rows


@pytest.fixture
def messy(spark, messy_rows):
    schema = SCHEMA + "".join(f", {c} string" for c in CLASHING)
    return spark.createDataFrame([(*r, *CLASHING) for r in messy_rows], schema).repartition(4)


# --- phrases ---


def brute_phrases(rows, often, best):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        for c in ".,;:!?\n\v\f\r":
            text = (text or "").replace(c, "\n")
        for piece in text.translate(table).split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            n[lang or "und"] += len(words)
            for k in range(1, 6):
                f[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        frequent = {p: a for p, a in counts.items() if len(p) > 1 and a >= often}
        within = Counter()
        for p, a in frequent.items():
            for s in range(len(p)):
                for e in range(s + 2, len(p) + 1):
                    if e - s < len(p):
                        within[p[s:e]] = max(within[p[s:e]], a)
        scored = []
        for p, a in frequent.items():
            if within[p] < a:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(scored)[:best])]
    return sorted(out)


@pytest.mark.parametrize("hot, bits", [(100_000, 1 << 20), (150, 1 << 6)])
def test_phrases_match_brute_force(messy, messy_rows, monkeypatch, hot, bits):
    """Also with stripes of many parts and with a filter so small that it lets everything through."""
    monkeypatch.setattr(collocations, "HOT", hot)
    monkeypatch.setattr(collocations, "PART_BYTES", 4000)
    found = sorted(map(tuple, collocations.collocations(messy, 40, bits).collect()))
    assert found == brute_phrases(messy_rows, 100, 40) and len(found) >= 40
    assert collocations.collocations(messy.limit(0)).count() == 0


def test_stripes_hold_prefix_totals(messy, messy_rows):
    table = collocations.stripes(messy, 1 << 20)
    totals = table.filter("words = 1").groupBy("lang", "prefix").agg(F.sum("total").alias("f")).collect()
    entries = {(r["lang"], r["phrase"]): r["n"] for r in collocations.extensions(table.filter("words = 0")).collect()}
    assert totals and all(entries[r["lang"], r["prefix"]] == r["f"] for r in totals)


# --- languages ---


def test_languages_of_single_and_mixed_texts(spark, messy, messy_rows):
    found = {}
    for r in language.languages(messy).collect():
        found.setdefault(r["doc_id"], r)
    assert language.languages(messy).count() == len(messy_rows)
    for doc_id, text, lang, *_ in messy_rows:
        if doc_id is None:
            continue
        r = found[doc_id]
        assert r["held_out"] == (zlib.crc32(str(doc_id).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        if text is None or not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"]) == ("und", 0)
        elif lang in ("no", "so"):
            assert r["lang_pred"] == lang and r["score"] > 0.9
    mixed = "thing with those water shall north " * 12 + "quella zona dolce altro qualche zuppa " * 6
    model = language.fitted(messy.select("lang", "text"))
    shares = language.mixtures_of(pa.array([mixed, "", None]), model)
    by = dict(zip(model.langs, shares[0]))
    assert by["no"] == pytest.approx(2 / 3, abs=0.05) and by["so"] == pytest.approx(1 / 3, abs=0.05) and not shares[1:].any()


def test_languages_without_rows_or_labels(messy):
    assert language.languages(messy.limit(0)).count() == 0
    rows = language.languages(messy.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in rows} == {("und", 0.0)}


def test_language_counts_are_those_of_all_texts(messy, messy_rows):
    usable = messy.filter("lang is not null and doc_id < 60")
    total = usable.select("lang", "text")
    by_lang = {r["lang"]: r["n"] for r in language.gram_counts(total).groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    for lang in ("no", "so"):
        words = [w for r in messy_rows[:60] if r[2] == lang for w in "".join(c.lower() if c.isalpha() else " " for c in r[1]).split()]
        assert by_lang[lang] == sum(len(w) + len(w) + 1 + len(w) for w in words)  # grams of 1, 2 and 3 letters with a mark on each side


# --- manifests ---


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def up(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def climb(levels, place, node):
    proof = ""
    for level in levels[:-1]:
        run = level[place // 8 * 8 : place // 8 * 8 + 8]
        proof += "".join(run[: place % 8] + run[place % 8 + 1 :])
        node, place = sha(*run[: place % 8], node, *run[place % 8 + 1 :]), place // 8
    return node, proof


def brute_manifest(rows):
    frame = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: sha(*map(frame, (r[0], r[3], r[2], r[4], text)))
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    trees = defaultdict(list)
    for r in rows:
        struck = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        trees[r[2]].append((r[0], leaf(r, r[1]), leaf(r, r[1].translate(lower) if struck and r[1] is not None else r[1])))
    order = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    grown = {}
    for t in order:
        trees[t].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        grown[t] = up([x[1] for x in trees[t]])
    top = up([grown[t][-1][0] for t in order])
    out = []
    for i, t in enumerate(order):
        for place, (doc, own, claimed) in enumerate(trees[t]):
            node, proof = climb(grown[t], place, claimed)
            node, rest = climb(top, i, node)
            out.append((doc, own, grown[t][-1][0], top[-1][0], sha(proof + rest), node, node == top[-1][0]))
    return sorted(map(repr, out))


def test_manifest_matches_brute_force(spark, messy, messy_rows):
    assert sorted(repr(tuple(r)) for r in merkle.verified(messy).collect()) == brute_manifest(messy_rows)
    many = messy_rows + [(1000 + i, "X", f"l{i % 19:02}", "s", i) for i in range(190)] + [(5000, "Copy", "no", "s", 1)] * 150
    df = spark.createDataFrame(many, SCHEMA).repartition(3)
    assert sorted(repr(tuple(r)) for r in merkle.verified(df).collect()) == brute_manifest(many)


def test_manifests_of_few_rows(spark, messy):
    assert merkle.verified(messy.limit(0)).count() == 0
    for rows in ([(1, "A", "x", "s", 1)], [(1, "A", None, None, None), (2, "B", "y", "s", 1)]):
        assert sorted(repr(tuple(r)) for r in merkle.verified(spark.createDataFrame(rows, SCHEMA)).collect()) == brute_manifest(rows)


def test_proofs_of_some_leaves_only(messy):
    stored = merkle.manifest(merkle.leaves(messy))
    asked = stored.places.filter("place % 7 = 3").select("tree", "place", "leaf")
    found = merkle.requested_paths(stored, asked)
    rows = found.select("leaf", "digest", merkle.folded(F.col("leaf"), F.col("path")).alias("root")).collect()
    assert len(rows) == asked.count() > 5 and all(r["leaf"] == r["digest"] and r["root"] == stored.root for r in rows)


# --- words whose polynomial hashes are equal for every odd base ---


def twins():
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_regular_long_words_do_not_clash(spark):
    one, other = twins()
    assert lexing.word_hashes(one) != lexing.word_hashes(other)
    assert np.array_equal(lexing.word_hashes("X" * 50, lower=True), lexing.word_hashes("x" * 50))
    around = [f"w{i}" for i in range(24)]
    texts = [" ".join([*around[:12], word, *around[12:]]) for word in (one, other)]
    removed = {r["doc_id"]: r["n_removed"] for r in substring.marked(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert removed == {0: 0, 1: 0}
    pair = [(0, f"one {one} two three four"), (1, f"one {other} two three four")]
    found = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(pair, "doc_id bigint, text string"), width=4, percent=80).collect()}
    assert found == {0: 0, 1: 1}
