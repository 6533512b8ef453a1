"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns; against brute force."""

import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from playtrace.llm import bpe, decontamination, licenses, line_dedup, minhash, quality, sharding, substring, toxicity

def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 6))) for _ in range(n))


CLASHING = ["hash", "node", "doc", "line", "lines", "chunks", "bucket", "gone", "single", "own", "copy", "codes", "words", "score", "range", "n"]


@pytest.fixture(scope="module")
def messy_rows():
    """Nulls, empty and blank texts, repeated rows, copies, one very long text, rows without an id."""
    rng = random.Random(5)
    base = sentence(rng, 120)
    near = base.replace(base.split()[60], "changed", 1)
    passage = "\n".join(sentence(rng, 9) for _ in range(12))
    long = "\n".join(sentence(rng, 30) for _ in range(4000))
    return [
        (1, base), (1, base), (2, None), (3, ""), (4, " \t\n "), (5, base), (6, near), (7, "two words"), (8, "two words"),
        (9, passage + "\n" + sentence(rng, 30)), (10, sentence(rng, 25) + "\n" + passage + "\n" + sentence(rng, 12)),
        (11, long), (None, base), (None, None), (12, sentence(rng, 40)), (13, "One\r\nlineé \U0001f600 " + passage.upper()),
    ]


@pytest.fixture
def messy(spark, messy_rows):
    """The same with further columns whose names operators may use inside."""
    schema = "doc_id bigint, text string, " + ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame([(*r, *CLASHING) for r in messy_rows], schema).repartition(3)


@pytest.fixture
def nothing(messy):
    return messy.limit(0)


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text, lower=False):
    text = text or ""
    if lower:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return WORD.findall(text)


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string")


def test_lines_keep_rows_and_columns(messy, nothing):
    out = line_dedup.deduplicated(messy)
    assert out.columns == messy.columns and out.count() == messy.count()
    assert line_dedup.deduplicated(nothing).count() == 0
    texts = defaultdict(list)
    for r in out.collect():
        assert r["hash"] == "hash" and r["chunks"] == "chunks"
        texts[r["doc_id"]].append(r["text"])
    before = {r["doc_id"]: r["text"] for r in messy.collect()}
    assert texts[2] == [None] and texts[3] == [""] and texts[9] == [before[9]] and texts[11] == [before[11]]
    assert len(texts[10][0]) < len(before[10]) - 100  # the passage's inner chunks went
    assert len(texts[1]) == 2 and texts[1][0] == texts[1][1]


def test_chunks_resist_shifts(spark):
    lines = [f"line number {i} of the text" for i in range(60)]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(["a new first line", *lines]))], "doc_id bigint, text string")
    left = {r["doc_id"]: r["text"] for r in line_dedup.deduplicated(docs).collect()}
    assert left[1] == "\n".join(lines) and left[2].startswith("a new first line") and left[2].count("\n") < 20


def test_the_pipeline_cuts_whole_passages(spark):
    from corpus_pipeline import cut_repeated_lines

    rng = random.Random(9)
    source = [sentence(rng, 6) for _ in range(40)]
    rows = {1: source, 2: source[:20], 40: ["x y", "x y", "x y", "x y"], 41: ["only this", "x y", "x y"], 42: ["", "", ""], 43: ["", "", ""]}
    for n in range(2, 13):
        rows[10 + n] = [f"own head {n}", *source[n : 2 * n], f"own tail {n}", source[0]]
    docs = spark.createDataFrame([(d, "\n".join(lines), 0) for d, lines in rows.items()], "doc_id bigint, text string, n_chars int").repartition(3)
    left = {r["doc_id"]: r["text"] for r in cut_repeated_lines(spark, docs, "").collect()}
    assert left[1] == "\n".join(source) and left[2] == "" and left[42] == left[43] == "\n\n"
    assert left[40] == "x y\nx y" and left[41] == "only this"
    assert [left[10 + n] for n in range(2, 13)] == [f"own head {n}\nown tail {n}\n{source[0]}" for n in range(2, 13)]


def test_leaks_match_brute_force(spark, messy, messy_rows, nothing):
    text = dict(messy_rows)[1]
    items = items_of(spark, [(1, " ".join(text.split()[20:55])), (2, "too short"), (3, None), (None, text), (4, " ".join(text.upper().split()[:90])), (5, "")])
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(messy, items).collect()}
    runs = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    sets = lambda t: runs(words(t, True))
    expected = set()
    for doc, body in messy_rows:
        for item, wanted in [(r["item_id"], sets(r["text"])) for r in items.collect()]:
            if doc is not None and item is not None and wanted and 100 * len(wanted & sets(body)) >= 80 * len(wanted):
                expected.add((doc, item))
    assert found == expected
    assert decontamination.leaks(nothing, items).count() == 0
    left = decontamination.without_leaks(messy, items)
    assert left.columns == messy.columns and {r["doc_id"] for r in left.collect()} == {d for d, _ in messy_rows} - {d for d, _ in expected}


def test_needed_hits_lose_little():
    assert decontamination.needed_hits(32, 10, 80) == 8
    assert 1 <= decontamination.needed_hits(32, 100, 80) <= 14


def brute_components(rows, width, percent):
    sets = []
    for _, text in rows:
        w = words(text, True)
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    ids = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            ids[top(i)].append(doc)
    return Counter((doc, len(sets[i]), min(ids[top(i)]) if sets[i] and ids[top(i)] else doc) for i, (doc, _) in enumerate(rows))


def test_near_duplicates_match_brute_force(spark, messy, messy_rows, nothing):
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(messy, 4, 80).collect())
    assert got == brute_components(messy_rows, 4, 80)
    assert minhash.near_duplicates(nothing, 4, 80).count() == 0
    left = minhash.one_of_each(messy, 4, 80)
    assert left.columns == messy.columns
    assert Counter(r["doc_id"] for r in left.collect()) == Counter([1, 2, 3, 4, 7, 9, 10, 11, 12, 13, None, None])


def test_a_group_around_a_centre_falls_together(spark):
    """Copies that differ from a centre by a few words, and from each other by twice as many; some far from all."""
    import random

    rng = random.Random(3)
    base = [f"w{i}" for i in range(70)]
    rows = []
    for d in range(330):
        w = list(base)
        for _ in range(rng.choice([1, 1, 2, 2, 3, 4])):
            w[rng.randrange(len(w))] = f"x{d}{rng.random()}"
        rows.append((d, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs, 4, 80).collect())
    assert got == brute_components(rows, 4, 80)


def test_pruning_bounds_follow_the_posterior():
    bounds = minhash.least_matches(80)
    assert bounds[0] == 0 and list(bounds) == sorted(bounds) and 70 < bounds[128] < 95


def test_blocks_without_survivors():
    import numpy as np

    probe = np.arange(minhash.PERMUTATIONS, dtype=np.uint32)
    assert minhash.first_band(probe, np.empty((0, minhash.PERMUTATIONS), np.uint32)).tolist() == []
    assert minhash.first_band(probe, np.stack([probe, np.where(np.arange(len(probe)) < 4, 0, probe)])).tolist() == [0, 1]


def brute_removed(rows, length):
    first, out = {}, {}
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    for i in order:
        w = words(rows[i][1])
        gone = [False] * len(w)
        for s in range(len(w) - length + 1):
            key = tuple(w[s : s + length])
            if key in first and (first[key][0] != rows[i][0] or first[key][1] != s):
                if first[key][0] != rows[i][0] or s > first[key][1]:
                    gone[s : s + length] = [True] * length
            else:
                first[key] = (rows[i][0], s)
        out.setdefault(rows[i][0], []).append((len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return out


def test_passages_match_brute_force(messy, messy_rows, nothing):
    got = defaultdict(list)
    for r in substring.marked(messy).collect():
        got[r["doc_id"]].append((r["n_words"], r["n_removed"], r["kept_sha256"]))
    expected = brute_removed(messy_rows, 20)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in expected.items()}
    assert substring.marked(nothing).count() == 0
    cut = substring.cut(messy)
    assert cut.columns == messy.columns and cut.count() == messy.count()
    for r in cut.collect():
        kept = hashlib.sha256(" ".join(words(r["text"])).encode()).hexdigest()
        assert kept in {h for _, _, h in got[r["doc_id"]]}


def test_every_difference_is_on_the_cover():
    cover = set(substring.COVER)
    for d in range(substring.PERIOD):
        assert any((c + d) % substring.PERIOD in cover for c in cover)


def brute_base(text):
    w, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
    runs = defaultdict(list)
    for i in range(len(w) - 7):
        runs[tuple(w[i : i + 8])].append(i)
    covered = {i + k for at in runs.values() if len(at) > 1 for i in at for k in range(8)}
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def test_base_rules_match_brute_force(spark, messy_rows, messy, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (9, 1, 0), (12, 0, 0), (10, None, 0), (None, 1, 0), (99, 1, 1)], "doc_id bigint, quality int, toxic int")
    extra = [(20, "one two three four five six seven eight nine " * 5), (21, "a # b * c $ d % e & f | g < h >" * 3), (22, "x\nx\n\nx\ny y")]
    docs = messy.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id bigint, text string"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = Counter((r["doc_id"], *[r[n] for n in names]) for r in quality.judged(docs, labels).collect())
    assert got == Counter((d, *brute_base(t)) for d, t in [*messy_rows, *extra])
    assert quality.judged(nothing, labels).count() == 0
    assert quality.judged(docs, labels.limit(0)).where("score != 0").count() == 0


def test_ratio_scores_match_brute_force(spark):
    import math

    import xxhash

    signed = lambda n: n - (1 << 64) if n >> 63 else n
    code = lambda t: signed(xxhash.xxh64(t.encode(), seed=42).intdigest())
    pair = lambda a, b: signed(xxhash.xxh64(b.to_bytes(8, "little", signed=True), seed=xxhash.xxh64(a.to_bytes(8, "little", signed=True), seed=42).intdigest()).intdigest())
    texts = {1: "good words here, and more", 2: "bad *** words %%%", 3: "good and more"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, quality int")
    grams = {}
    for d, t in texts.items():
        c = [code(x) for x in re.findall(r"[a-z]+|[^a-z\s]+", t)]
        grams[d] = [x % quality.BUCKETS for x in c] + [pair(a, b) % quality.BUCKETS for a, b in zip(c, c[1:])]
    raw, target = Counter(g for v in grams.values() for g in v), Counter(grams[1])
    share = lambda c, g: (c[g] + quality.SMOOTHING) / (sum(c.values()) + quality.SMOOTHING * quality.BUCKETS)
    for r in quality.scored(docs, quality.ratio_model(docs, labels)).collect():
        mean = sum(math.log(share(target, g)) - math.log(share(raw, g)) for g in grams[r["doc_id"]]) / len(grams[r["doc_id"]])
        assert r["score"] == pytest.approx(mean, abs=1e-12)


def test_shards_are_gapless_and_even(spark, messy, nothing, messy_rows):
    rows = sharding.assigned(messy).collect()
    assert len(rows) == len(messy_rows) and sharding.assigned(nothing).count() == 0
    docs = spark.range(4000).selectExpr("id as doc_id", "case when id % 3 = 0 then repeat('same ', 40) else repeat(cast(id as string), 10 + id % 70) end as text")
    rows = sharding.assigned(docs).collect()
    size, slots, together = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        if r["doc_id"] % 3:
            together[r["text_crc32"]].add(r["shard"])
    assert sorted(size) == list(range(16)) and max(size.values()) < 1.1 * min(size.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and all(len(v) == 1 for v in together.values())


def test_tokens_match_the_library(spark, messy, messy_rows, nothing):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    model = Tokenizer.from_file(path)
    model.no_padding()
    model.no_truncation()
    odd = "<|endoftext|>a<|startoftext|> it's ΑΣ Î İ ﬁ ​ x  123½ " + "thing" * 400
    docs = messy.select("doc_id", "text").union(spark.createDataFrame([(50, odd)], "doc_id bigint, text string"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = Counter()
    for d, t in [*messy_rows, (50, odd)]:
        ids = model.encode(t or "", add_special_tokens=False).ids
        expected[d, len(ids), sha(" ".join(map(str, ids))), sha(model.decode(ids, skip_special_tokens=False))] += 1
    assert Counter(map(tuple, bpe.round_trip(docs, path).collect())) == expected
    both = bpe.decoded(bpe.encoded(docs, path), path).where("doc_id = 50").first()
    assert both["decoded"] == model.decode(both["token_ids"], skip_special_tokens=False)
    assert bpe.round_trip(nothing, path).count() == 0


def test_toxicity_on_held_out_texts(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fitted(docs, labels)
    rows = toxicity.scored(docs, model).join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic").collect()
    right = sum(r["predicted"] == r["toxic"] for r in rows) / len(rows)
    assert right > 0.85 and all(0 <= r["score"] <= 1 for r in rows)


def test_toxicity_edges(spark, messy, messy_rows, nothing):
    labels = spark.createDataFrame([(1, 0), (9, 1), (2, 1), (None, 1), (12, None)], "doc_id bigint, toxic int")
    model = toxicity.fitted(messy, labels)
    rows = toxicity.scored(messy, model).collect()
    assert len(rows) == len(messy_rows) and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.scored(nothing, model).count() == 0
    assert {r["predicted"] for r in toxicity.scored(messy, toxicity.fitted(messy, labels.limit(0))).collect()} == {0}
    whole = "word " * 200_000
    assert model.score(whole) == pytest.approx(model.score("word"), abs=1e-9)
    assert toxicity.without_toxic(messy, model).columns == messy.columns


def test_toxicity_trains_in_a_task(spark, monkeypatch, tmp_path):
    train, noted = toxicity.trained, tmp_path / "process"

    def watched(texts, kinds):
        noted.write_text(str(os.getpid()))
        return train(texts, kinds)

    monkeypatch.setattr(toxicity, "trained", watched)
    rows = [(i, f"{'vile' if i % 2 else 'kind'} words of number{i}" if i != 8 else None, i % 2) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = toxicity.fitted(docs.drop("toxic"), docs.drop("text"))
    assert int(noted.read_text()) != os.getpid()
    learned = docs.where(~toxicity.is_held_out(F.col("doc_id"))).orderBy("doc_id").collect()
    same = train([r["text"] for r in learned], [r["toxic"] for r in learned])
    assert np.array_equal(model.logits, same.logits) and np.array_equal(model.weights, same.weights) and model.bias == same.bias
    assert model.logits.any()


def test_licences(spark, messy, nothing):
    lines = ["Plain words of no interest", "Licensed under the Apache License, Version 2.0.", "more words", "Released under the MIT License."]
    docs = messy.select("doc_id", "text").union(spark.createDataFrame([(60, "\n".join(lines)), (61, None), (62, lines[1].upper())], "doc_id bigint, text string"))
    model, bar = licenses.fitted(docs)
    found = {(r["doc_id"], r["paragraph"], r["family"]) for r in licenses.notices(docs, model, bar).where("confirmed").collect()}
    assert found == {(60, 1, "Apache-2.0"), (60, 3, "MIT"), (62, 0, "Apache-2.0")}
    assert licenses.notices(nothing, model, bar).count() == 0


@pytest.mark.parametrize("width", [24, 60])
def test_wrapped_licences(spark, messy, width):
    import textwrap

    rng = random.Random(3)
    own, rows, expected = lambda: [sentence(rng, 7), sentence(rng, 9)], [], {}
    for n, (family, notice) in enumerate(licenses.TEMPLATES):
        lines = [f" * {line}" for line in textwrap.wrap(notice, width)]
        rows.append((100 + n, "\n".join([*own(), "", *lines, *own()])))
        expected[100 + n] = (3, family)
    plain = messy.select("doc_id", "text")
    docs = plain.union(spark.createDataFrame(rows, plain.schema))
    model, bar = licenses.fitted(docs)
    found = licenses.notices(docs, model, bar).where("doc_id >= 100").collect()
    assert {r["doc_id"]: (r["paragraph"], r["family"]) for r in found if r["confirmed"]} == expected
    assert len(found) == len(rows) and min(r["similarity"] for r in found) == 1.0


def test_messy_documents_go_through_the_pipeline(spark, messy):
    import corpus_pipeline

    docs = messy
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.settle(stage(spark, docs, "/root/testdata/sf0.001"), name)
    assert docs.count() > 5
