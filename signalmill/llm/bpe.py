"""Operator 1: BPE encoding and decoding.

A text is cut into pretokens by the vocabulary's pattern. Each pretoken's
symbols form a doubly linked list; a priority queue holds the merge ranks of
adjacent pairs. The lowest rank (leftmost first) is popped, skipped if its pair
no longer stands there, else merged, and the two new pairs are pushed. Ids are
decoded by joining the vocabulary's strings.

Natural text repeats its words, so a worker remembers recent words' ids in a
memo of bounded size.

Defined results: a null text counts as empty and has no ids; a text of any
length is encoded whole; equal texts, repeated rows and empty tables need no
special case, as each row is encoded on its own; columns other than those named
pass through :func:`encode` and :func:`decode` untouched, and one that already
has the output's name is replaced.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmill.llm.common import table, text_or_empty, tune

#: Fixed value: how the vocabulary's text is cut before merging. The white
#: space is Unicode's property, written out.
WHITE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
WHITE_SET = frozenset(chr(c) for c in (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))

#: Words that one memo generation holds; two generations are kept.
MEMO_WORDS = 350_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: a
    printable byte for itself, the others for letters from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in printable}
    letters.update({chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(printable))})
    return letters


class Vocabulary:
    """Merges, ids and added tokens of a byte-level tokenizer file (JSON)."""

    def __init__(self, spec: bytes):
        import regex

        said = json.loads(spec)
        ids, letters = said["model"]["vocab"], byte_letters()
        self.size = max([*ids.values(), *(t["id"] for t in said["added_tokens"])]) + 1
        self.of_byte = [0] * 256
        for letter, b in letters.items():
            self.of_byte[b] = ids[letter]
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for k, pair in enumerate(said["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank.setdefault(ids[a] * self.size + ids[b], k)
            self.merged.append(ids[a + b])
        self.bytes_of = {i: bytes(letters[c] for c in s) for s, i in ids.items()}
        self.added = {t["content"]: t["id"] for t in said["added_tokens"]}
        self.bytes_of.update({i: s.encode() for s, i in self.added.items()})
        self.pretokens = regex.compile(PATTERN).findall
        self.cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.added, key=len, reverse=True)) + ")").split if self.added else None

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pretoken."""
        symbols = [self.of_byte[b] for b in word]
        n = len(symbols)
        if n < 2:
            return symbols
        ranked, size, merged = self.rank.get, self.size, self.merged
        queue = [r * n + i for i, a in enumerate(symbols[:-1]) if (r := ranked(a * size + symbols[i + 1])) is not None]
        if not queue:
            return symbols
        heapq.heapify(queue)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while queue:
            r, i = divmod(heapq.heappop(queue), n)
            a, j = symbols[i], after[i]
            if a < 0 or j >= n or ranked(a * size + symbols[j]) != r:
                continue  # stale: the pair was merged away
            symbols[i] = a = merged[r]
            symbols[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranked(a * size + symbols[k])) is not None:
                    heapq.heappush(queue, r * n + i)
            if (k := before[i]) >= 0 and (r := ranked(symbols[k] * size + a)) is not None:
                heapq.heappush(queue, r * n + k)
        return [s for s in symbols if s >= 0]


class _Memo(dict):
    """Recent keys' values: a full generation is kept aside, and the one before it goes."""

    def __init__(self, make: Callable, most: int = MEMO_WORDS):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class _Whole(Exception):
    """The text must be cut as a whole: a run of white space crosses a space."""


class Encoder:
    """Encodes texts to a list of parts, one per word; ``pack`` makes a part of
    ids, and parts with ``between`` them make the part of both."""

    def __init__(self, vocabulary: Vocabulary, pack: Callable[[list[int]], str | bytes], between: str | bytes):
        self.vocabulary, self.pack = vocabulary, pack
        self.ends = {mark: between + pack(vocabulary.merge(mark.encode())) for mark in ".,;:!?"}
        self.words = _Memo(self._word)

    def _cut(self, text: str):
        merge = self.vocabulary.merge
        return self.pack([i for pretoken in self.vocabulary.pretokens(text) for i in merge(pretoken.encode())])

    def _word(self, word: str):
        if not word or word[-1] in WHITE_SET:
            raise _Whole
        if word.isalpha():
            return self.pack(self.vocabulary.merge(b" " + word.encode()))
        if word[-1] in self.ends and word[:-1].isalpha():
            return self.words[word[:-1]] + self.ends[word[-1]]
        return self._cut(" " + word)

    def _plain(self, text: str) -> list:
        """A space starts a pretoken unless more white space follows it, so words
        after single spaces can be encoded one by one."""
        end = len(text)
        while end and text[end - 1] in WHITE_SET:
            end -= 1
        first, *rest = text[:end].split(" ")
        try:
            if first and first[-1] in WHITE_SET:
                raise _Whole
            words = self.words
            parts = [words[w] for w in rest]
        except _Whole:
            return [self._cut(text)]
        return [p for p in (self._cut(first), *parts, self._cut(text[end:])) if p]

    def __call__(self, text: str) -> list:
        added = self.vocabulary.added
        if not any(s in text for s in added):
            return self._plain(text)
        parts: list = []
        for piece in self.vocabulary.cut(text):
            parts += [self.pack([added[piece]])] if piece in added else self._plain(piece) if piece else []
        return parts


@lru_cache(maxsize=4)
def vocabulary_of(spec: bytes) -> Vocabulary:
    return Vocabulary(spec)


def _decimal(ids: list[int]) -> str:
    return ",".join(map(str, ids))


@lru_cache(maxsize=4)
def decimal_encoder(spec: bytes) -> Encoder:
    return Encoder(vocabulary_of(spec), _decimal, ",")


@lru_cache(maxsize=4)
def decimal_strings(spec: bytes) -> dict[str, bytes]:
    return {str(i): s for i, s in vocabulary_of(spec).bytes_of.items()}


def tokenizer_file(spark: SparkSession, path: str):
    """The vocabulary file, sent to the executors: its size is that of one
    vocabulary (here 2 MB) and doesn't grow with the corpus."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_text(spec: bytes, text: str) -> list[int]:
    """Ids of one text; for tests and small uses."""
    parts = decimal_encoder(spec)(text)
    return [int(i) for i in ",".join(parts).split(",")] if parts else []


def decode_ids(spec: bytes, ids) -> str:
    strings = vocabulary_of(spec).bytes_of
    return b"".join([strings[i] for i in ids]).decode("utf-8", "replace")


def encode(df: DataFrame, vocabulary_path: str, text_column: str = "text", ids_column: str = "ids") -> DataFrame:
    """Adds the ids of each whole text as array<int>."""
    spec = tokenizer_file(df.sparkSession, vocabulary_path)

    @F.pandas_udf("array<int>")
    def ids_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([encode_text(spec.value, t or "") for t in texts], dtype=object)

    return df.withColumn(ids_column, ids_of(F.col(text_column)))


def decode(df: DataFrame, vocabulary_path: str, ids_column: str = "ids", text_column: str = "decoded") -> DataFrame:
    """Adds the text of each id list; a null list counts as empty."""
    spec = tokenizer_file(df.sparkSession, vocabulary_path)

    @F.pandas_udf("string")
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lists in batches:
            yield pd.Series([decode_ids(spec.value, () if ids is None else ids) for ids in lists], dtype=object)

    return df.withColumn(text_column, text_of(F.col(ids_column)))


def round_trip(df: DataFrame, vocabulary_path: str, key: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encodes and decodes each whole text: key, n_tokens, digest of the ids
    (decimal, joined by commas) and digest of the decoded text.

    One pass over the rows without a shuffle; ids don't leave the task.
    """
    spec = tokenizer_file(df.sparkSession, vocabulary_path)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, strings = decimal_encoder(spec.value), decimal_strings(spec.value)
        for batch in batches:
            counts, ids_digests, text_digests = [], [], []
            for text in batch.column(1):
                ids = ",".join(encoder(text.as_py()))
                listed = ids.split(",") if ids else []
                decoded = b"".join(map(strings.__getitem__, listed)).decode("utf-8", "replace")
                counts.append(len(listed))
                ids_digests.append(hashlib.sha256(ids.encode()).hexdigest())
                text_digests.append(hashlib.sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_digests, pa.string()), pa.array(text_digests, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = df.select(F.col(key).cast("long").alias(key), text_or_empty(text_column).alias("text"))
    return rows.mapInArrow(digests, f"`{key}` long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    tune(spark)
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
