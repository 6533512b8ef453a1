"""Byte-pair encoding of whole texts with a contiguous rank array, and decoding.

A word is a list of parts and, beside it, a list of the ranks of adjacent parts. The smallest rank is looked for
again and again, its boundary is deleted and the two ranks next to it are looked up anew. Words are short, so scanning
the array beats keeping a queue; a word of more than ``LONG`` parts uses a queue with the same order of merges.

The vocabulary is the JSON of a public tokenizer: merges with word ends, texts normalised to NFC and lower case, white
space dropped. The driver reads it once and broadcasts it (its size is fixed by the vocabulary, not by the data).

Defined results: a null or empty text has no tokens and decodes to an empty text; repeated rows are encoded alike;
a text is encoded whole, whatever its length; other columns are neither read nor needed.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

LONG = 64
CACHE_WORDS = 400_000
NO_RANK = 1 << 62
SHIFT = 20

SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
PLAIN = re.compile(rf"{ENDINGS}|[a-z]+|[0-9]|[^{SPACE}a-z0-9]+")
ANY = regex.compile(rf"{ENDINGS}|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+")


def byte_letters() -> list[str]:
    """The visible letter that stands for each byte: itself if printable Latin-1, else the next free one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(free)) for b in range(256)]


class WordCache(dict):
    """Ids of words met before; words of more than ``LONG`` characters are never kept, so its size is bounded."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.encode(word)
        if len(word) <= LONG:
            self[word] = ids
        return ids

    def make_room(self) -> None:
        if len(self) >= CACHE_WORDS:
            self.clear()


class WordBpe:
    """Encoder and decoder for one vocabulary."""

    def __init__(self, model: dict):
        vocabulary = model["model"]["vocab"]
        end = model["model"]["end_of_word_suffix"]
        letters = byte_letters()
        self.inner = [vocabulary.get(c) for c in letters]
        self.last = [vocabulary.get(c + end) for c in letters]
        self.merges: dict[int, int] = {}
        for rank, (a, b) in enumerate(model["model"]["merges"]):
            key = vocabulary[a] << SHIFT | vocabulary[b]
            self.merges.setdefault(key, rank << SHIFT | vocabulary[a + b])
        self.added = {t["content"]: t["id"] for t in model["added_tokens"]}
        names = {i: t for t, i in (vocabulary | self.added).items()}
        self.tokens = [names.get(i, "") for i in range(max(names) + 1)]
        self.splitter = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.digits = [str(i) for i in range(len(self.tokens))]
        self.cache = WordCache(self.encode_word)

    def encode_word(self, word: str) -> tuple[int, ...]:
        raw = word.encode()
        parts = [self.inner[b] for b in raw]
        parts[-1] = self.last[raw[-1]]
        if None in parts:
            parts = [p for p in parts if p is not None]
        return tuple(self._by_queue(parts) if len(parts) > LONG else self._by_scan(parts))

    def _by_scan(self, parts: list[int]) -> list[int]:
        rank = self.merges.get
        ranks = [rank(a << SHIFT | b, NO_RANK) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NO_RANK:
                break
            at = ranks.index(least)
            parts[at] = least & ((1 << SHIFT) - 1)
            del parts[at + 1], ranks[at]
            if at:
                ranks[at - 1] = rank(parts[at - 1] << SHIFT | parts[at], NO_RANK)
            if at < len(ranks):
                ranks[at] = rank(parts[at] << SHIFT | parts[at + 1], NO_RANK)
        return parts

    def _by_queue(self, parts: list[int]) -> list[int]:
        rank, n = self.merges.get, len(parts)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        queue = [(r, i) for i in range(n - 1) if (r := rank(parts[i] << SHIFT | parts[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            least, at = heapq.heappop(queue)
            to = after[at]
            if parts[at] < 0 or to < 0 or rank(parts[at] << SHIFT | parts[to]) != least:
                continue
            parts[at], parts[to] = least & ((1 << SHIFT) - 1), -1
            after[at] = after[to]
            if after[to] >= 0:
                before[after[to]] = at
            for left, right in ((before[at], at), (at, after[at])):
                if left >= 0 and right >= 0 and (r := rank(parts[left] << SHIFT | parts[right])) is not None:
                    heapq.heappush(queue, (r, left))
        return [p for p in parts if p >= 0]

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        pieces = self.splitter.split(text) if text else []
        for place, piece in enumerate(pieces):
            if place % 2:
                ids.append(self.added[piece])
            elif piece:
                self.cache.make_room()
                ids += chain.from_iterable(map(self.cache.__getitem__, self.words(piece)))
        return ids

    def words(self, text: str) -> list[str]:
        if text.isascii():
            return PLAIN.findall(text.lower())
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return ANY.findall(text.replace("Σ", "σ").lower())  # letter by letter: no final sigma

    def decode(self, ids) -> str:
        return " ".join(map(self.tokens.__getitem__, ids))


_LOADED: dict[str, WordBpe] = {}


def loaded(text: str) -> WordBpe:
    """One encoder for each vocabulary and Python worker, so that its cache of words serves all tasks."""
    key = hashlib.md5(text.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = WordBpe(json.loads(text))
    return _LOADED[key]


def _vocabulary(df: DataFrame, path: str):
    with open(path, encoding="utf-8") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def encoded(docs: DataFrame, path: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """``docs`` with an array of token ids; ``path`` is the vocabulary's JSON, read on the driver."""
    from pyspark.sql import functions as F

    vocabulary = _vocabulary(docs, path)

    @F.pandas_udf("array<int>")
    def encode(texts):
        model = loaded(vocabulary.value)
        return texts.map(model.encode)

    return docs.withColumn(ids, encode(F.coalesce(F.col(text), F.lit(""))))


def decoded(docs: DataFrame, path: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """``docs`` with the text of its token ids; null ids give an empty text."""
    from pyspark.sql import functions as F

    vocabulary = _vocabulary(docs, path)

    @F.pandas_udf("string")
    def decode(lists):
        model = loaded(vocabulary.value)
        return lists.map(lambda x: "" if x is None else model.decode(x))

    return docs.withColumn(text, decode(F.col(ids)))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Per document: n_tokens, and digests of its ids and of the text that these ids decode to."""
    vocabulary = _vocabulary(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(vocabulary.value)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            counts, digests, texts = [], [], []
            for text in batch.column(1):
                ids = model.encode(text.as_py())
                counts.append(len(ids))
                digests.append(sha(" ".join(map(model.digits.__getitem__, ids))))
                texts.append(sha(model.decode(ids)))
            yield pa.record_batch([batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()),
                                   pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
