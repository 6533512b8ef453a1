"""Toxicity of whole texts: subword bags averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams and itself, each hashed to a row of an embedding table; a word's vector is
their mean, a text's vector the mean of its words' vectors, and a linear softmax tells the two classes. Embeddings and
softmax are trained together, by Adam over batches of texts. A misspelt word shares most n-grams with the right one and so
most of its vector. Words that many texts of the sample hold count less in the mean (their weight falls with that share).

Training takes a bounded sample of labelled texts, at most ``SAMPLE`` of each class, the first by a hash of doc_id; it
learns in a task from those alone, so the driver never holds texts. Since all layers are linear, the trained model comes
down to one number an n-gram bucket and the weight of a word, which is what the driver gets and sends to the tasks: its
size is fixed by ``BUCKETS``.

Defined results: a null, empty or wordless text scores the model's bias alone; repeated rows score alike; labels without a
document or of null value train nothing, of several labels of a document the largest counts; with labels of one class only
every text gets that class's share, and without labels 0; other columns are ignored by ``scored`` and stay in ``rated``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtrace.llm.lexing import mix

SAMPLE = 3000
BUCKETS = 1 << 18
DIMENSIONS = 8
EPOCHS = 25
BATCH = 256
RATE = 0.05
SHRINK = 1e-4
SMALLEST, LARGEST = 3, 7
SEEN = 3
TELLING = 10.8  # a chance of one in a thousand
PIECE = 1 << 18
COMMON = 0.02

_INSIDE = np.ones(256, bool)
_INSIDE[[c for c in range(128) if not chr(c).isalnum()]] = False


def grams_of(text: str | None, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the n-grams of a text's distinct words, for each the number of its word, and the bucket of each word.

    Words are runs of ASCII letters and digits and of other letters' bytes, in lower case; n-grams are of ``SMALLEST`` to
    ``LARGEST`` bytes, the marks at both ends of a word among them.
    """
    raw = np.frombuffer(f" {(text or '').lower()} ".encode(), np.uint8)
    inside = _INSIDE[raw]
    codes = np.where(inside, raw, 0).astype(np.uint64)
    starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    word_at = np.cumsum(np.concatenate([[False], inside[1:] & ~inside[:-1]])) - 1
    gaps = np.concatenate([[0], np.cumsum(~inside)])
    step, found, owner = np.uint64(0x100000001B3), [], []
    rolled = np.zeros(len(codes), np.uint64)
    for n in range(1, LARGEST + 1):
        rolled = rolled[: len(codes) - n + 1] * step + codes[n - 1 :] + np.uint64(1)
        if n < SMALLEST or not len(rolled):
            continue
        within = gaps[n - 1 : len(codes)][: len(rolled)] - gaps[1 : len(rolled) + 1] == 0  # no gap but at the ends
        at = np.flatnonzero(within)
        found.append((mix(rolled[at] + np.uint64(n)) % np.uint64(buckets)).astype(np.int64))
        owner.append(word_at[at + 1])
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(codes * np.uint64(1_000_003) + (np.arange(len(codes)) - starts[np.maximum(word_at, 0)]).astype(np.uint64)))])
    whole, first, same = np.unique(mix(sums[ends] - sums[starts]), return_index=True, return_inverse=True)
    grams, owner = np.concatenate(found), np.concatenate(owner)
    mine = first[same[owner]] == owner  # of a word said again only the first
    return grams[mine], same[owner[mine]], (whole % np.uint64(buckets)).astype(np.int64)


@dataclass
class ToxicityModel:
    """One logit a bucket, the weight of a word by its bucket, and a bias."""

    logits: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self.known = self.logits != 0

    def score(self, text: str | None) -> float:
        total = summed = 0.0
        for piece in pieces(text):
            grams, owner, whole = grams_of(piece, len(self.logits))
            if len(whole):
                shares, weight = _shares(grams, owner, whole, self.weights, self.known)
                total += float(weight.sum())
                summed += float((shares * self.logits[grams]).sum())
        logit = self.bias + (summed / total if total else 0.0)
        return float(1 / (1 + np.exp(-np.clip(logit, -700, 700))))


def pieces(text: str | None) -> Iterator[str]:
    """A very long text in parts, cut at spaces: memory stays bounded, and all of it counts."""
    text, at = text or "", 0
    while len(text) - at > PIECE:
        upto = text.find(" ", at + PIECE)
        if upto < 0:
            break
        yield text[at:upto]
        at = upto
    yield text[at:]


def _shares(grams: np.ndarray, owner: np.ndarray, whole: np.ndarray, weights: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each n-gram its share of the text's mean; the weight of each word, 0 for words that hold no known n-gram."""
    held = np.bincount(owner, known[grams], len(whole))
    weight = np.where(held > 0, weights[whole], 0.0)
    return (weight / np.bincount(owner, minlength=len(whole)))[owner], weight


def _telling(present: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Buckets whose presence goes with the class, by the chi-square of the two-by-two table; all others embed as zero."""
    n1, n0, (with0, with1) = (y == 1).sum(), (y == 0).sum(), present
    n, seen = n1 + n0, with1 + with0
    square = n * (with1 * (n0 - with0) - with0 * (n1 - with1)) ** 2 / np.maximum(n1 * n0 * seen * (n - seen), 1)
    return np.flatnonzero((square > TELLING) & (seen >= SEEN))


def trained(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = 1) -> ToxicityModel:
    """Fits the embeddings and the softmax to texts and their labels 0 or 1."""
    y = np.asarray(labels, np.int64)
    share = float(y.mean()) if len(y) else 0.0
    if share in (0.0, 1.0):
        return ToxicityModel(np.zeros(BUCKETS), np.ones(BUCKETS), 50.0 if share else -50.0)
    spread, present = np.zeros(BUCKETS), np.zeros((2, BUCKETS))
    for text, kind in zip(texts, y):  # a text's n-grams are counted and let go; below only the telling ones are kept
        grams, _, whole = grams_of(text)
        spread[np.unique(whole)] += 1
        present[kind, np.unique(grams)] += 1
    weights = COMMON / (COMMON + np.maximum(spread - 1, 0) / len(texts))
    used = _telling(present, y)
    place, known = np.full(BUCKETS, -1), np.zeros(BUCKETS, bool)
    place[used], known[used] = np.arange(len(used)), True
    rows = []
    for text in texts:
        grams, owner, whole = grams_of(text)
        share_of, weight = _shares(grams, owner, whole, weights, known)
        mine = known[grams]
        rows.append((place[grams[mine]].astype(np.int32), share_of[mine] / max(weight.sum(), 1e-12)))

    rng = np.random.default_rng(seed)
    values = {"table": rng.normal(0, 0.1, (len(used), DIMENSIONS)), "softmax": rng.normal(0, 0.1, (DIMENSIONS, 2)), "bias": np.zeros(2)}
    first, second = ({k: np.zeros_like(v) for k, v in values.items()} for _ in range(2))
    steps = 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            steps += 1
            mine = order[at : at + BATCH]
            columns, shares = np.concatenate([rows[i][0] for i in mine]), np.concatenate([rows[i][1] for i in mine])
            text_of = np.repeat(np.arange(len(mine)), [len(rows[i][0]) for i in mine])
            embedded = values["table"][columns] * shares[:, None]
            means = np.stack([np.bincount(text_of, e, len(mine)) for e in embedded.T], axis=1)
            z = means @ values["softmax"] + values["bias"]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(mine)), y[mine]] -= 1
            p /= len(mine)
            back = (p @ values["softmax"].T)[text_of] * shares[:, None]
            slopes = {"table": np.stack([np.bincount(columns, b, len(used)) for b in back.T], axis=1) + SHRINK * values["table"] / len(used),
                      "softmax": means.T @ p, "bias": p.sum(axis=0)}
            for k, slope in slopes.items():
                first[k] = 0.9 * first[k] + 0.1 * slope
                second[k] = 0.99 * second[k] + 0.01 * slope**2
                values[k] -= RATE * (first[k] / (1 - 0.9**steps)) / (np.sqrt(second[k] / (1 - 0.99**steps)) + 1e-8)
    side = values["softmax"][:, 1] - values["softmax"][:, 0]
    logits = np.zeros(BUCKETS)
    logits[used] = values["table"] @ side
    return ToxicityModel(logits, weights, float(values["bias"][1] - values["bias"][0]))


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def sample_of(docs: DataFrame, labels: DataFrame, each: int = SAMPLE) -> DataFrame:
    """(doc_id, text, toxic): at most ``each`` labelled texts of either class, held-out ones never, the first by a hash of doc_id."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~is_held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = None
    for kind in (0, 1):
        some = known.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(each)
        picked = some if picked is None else picked.union(some)
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("toxic").alias("toxic"))


def fitted(docs: DataFrame, labels: DataFrame, each: int = SAMPLE) -> ToxicityModel:
    """The model of the sample, trained in one task on its 2 * ``each`` rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, kinds = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            kinds += batch.column(1).to_pylist()
        model = trained(texts, kinds)
        yield pa.record_batch([pa.array([x], kind) for x, kind in (
            (model.logits.tobytes(), pa.binary()), (model.weights.tobytes(), pa.binary()), (model.bias, pa.float64()))], names=["logits", "weights", "bias"])

    rows = sample_of(docs, labels, each).repartition(1).sortWithinPartitions("doc_id").select("text", "toxic")
    found = rows.mapInArrow(run, "logits binary, weights binary, bias double").collect()
    if not found:  # without a sample there may be no task
        return trained([], [])
    return ToxicityModel(np.frombuffer(found[0]["logits"]), np.frombuffer(found[0]["weights"]), found[0]["bias"])


def scored(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [sent.value.score(text.as_py()) for text in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(scores, pa.float64()),
                                   pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(
        run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Documents that score below 0.5; columns as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def fine(texts):
        return texts.map(lambda t: sent.value.score(t) < 0.5).astype(bool)

    return docs.where(fine("text"))
