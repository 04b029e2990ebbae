"""Operator 12: best-fit packing of documents into sequences of fixed size.

A document's ids and the end id are one piece; only longer documents are cut, at
every ``size`` ids. Pieces are packed online: a piece goes into the open bin with
the least free space that still holds it. Open bins are kept by free space, with a
bitset of the spaces that occur, so that the best one is the lowest set bit at or
above the piece's length. A task holds at most ``OPEN_BINS`` of them; where a new
one is wanted beyond, the fullest closes. The table's pieces come in runs of as
many pieces, the longest of a run first, so that short ones fill what long ones
leave and no bin closes before its run's short pieces have come.

Each task packs its part of the table by itself and is left with open bins. These
are packed again as pieces of their own, longest first, ``FAN`` tasks' leavings to
a task, until one task is left; so what isn't full at the end is at most what one
task holds open, however many tasks there were.

Defined results: a null text counts as empty and is the end id alone; each of
repeated rows is packed; a null key stays null; an empty table gives no rows;
texts are read whole; numbers of sequences have gaps; other columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmill.llm.bpe import byte_letters, tokenizer_file
from signalmill.llm.common import materialize, table, text_or_empty, tune

SIZE = 2048
END_ID = 0
OPEN_BINS = 4096
#: Tasks whose open bins one task packs in the next round.
FAN = 32
#: Entries of a worker's memory of words; it starts anew when full.
MEMORY = 400_000

# Fixed value: the split of the vocabulary file's pre-tokenizer.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Letters that composition leaves alone and that change case one by one (a dotted I becomes two), then signs: two pieces.
WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-įı-ȿ]+)([!-/:-@[-`{-~]*)").fullmatch
#: Characters of that kind, without white space.
PLAIN = re.compile("[!-~¡-įı-ȿ]+").fullmatch


class _Memory(dict):
    """What a function gives, remembered; it starts anew when full."""

    def __init__(self, of: Callable):
        self.of = of

    def __missing__(self, key):
        if len(self) >= MEMORY:
            self.clear()
        value = self.of(key)
        if len(key) < 200:
            self[key] = value
        return value


class WordEncoder:
    """The library's ids of a text, little-endian unsigned 32-bit.

    Nothing spans ASCII white space, so a text is encoded word by word, and a word
    once. Plain words are lowered and split here and merged by the library's
    model; all others go to the library whole, special tokens among them.
    """

    def __init__(self, spec: bytes):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec.decode())
        self.model = self.tokenizer.model
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or "(?!)").search
        self.letters = {b: c for c, b in byte_letters().items()}
        self.words = _Memory(self._word)
        self.pieces = _Memory(self._piece)

    def _piece(self, piece: str) -> bytes:
        letters = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        plain = WORD(text)
        if plain and not self.special(text):
            letters, signs = plain.groups()
            return self.pieces[letters.lower()] + self.pieces[signs] if signs else self.pieces[letters.lower()]
        if PLAIN(text) and "\x7f" not in text and not self.special(text):
            return b"".join(map(self.pieces.__getitem__, SPLIT.findall(text.lower())))
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: bytes) -> bytes:
        return b"".join(map(self.words.__getitem__, text.split()))


@lru_cache(maxsize=2)
def word_encoder(spec: bytes) -> WordEncoder:
    return WordEncoder(spec)


PIECES = "piece int, start long, length long, ids binary"


def pieces_of(df: DataFrame, vocabulary_path: str, size: int = SIZE, end_id: int = END_ID, key: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(key, piece, start, length, ids) of every text; ``start`` counts the
    document's ids before the piece. One pass, without a shuffle."""
    spec = tokenizer_file(df.sparkSession, vocabulary_path)
    last, step = np.array([end_id], "<u4").tobytes(), 4 * size

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(spec.value)
        for batch in batches:
            keys, numbers, parts = [], [], []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoder(text.as_buffer().to_pybytes()) + last
                for number, at in enumerate(range(0, len(ids), step)):
                    keys.append(k)
                    numbers.append(number)
                    parts.append(ids[at : at + step])
            lengths = pa.array([len(p) // 4 for p in parts], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(numbers, pa.int32()), pa.array([n * size for n in numbers], pa.int64()), lengths, pa.array(parts, pa.binary())], names=[key, "piece", "start", "length", "ids"])

    rows = df.select(F.col(key).cast("long").alias(key), text_or_empty(text_column).alias("text"))
    return rows.mapInArrow(cut, f"`{key}` long, {PIECES}")


class OpenBins:
    """A bounded number of open bins, kept by free space."""

    def __init__(self, size: int, most: int, first: int = 0):
        self.size, self.most, self.next = size, most, first
        self.spaces = 0  # bit f is set where a bin with f free places is open
        self.of_space: list[list[int]] = [[] for _ in range(size + 1)]
        self.count = 0

    def _take(self, space: int) -> int:
        bins = self.of_space[space]
        number = bins.pop()
        if not bins:
            self.spaces ^= 1 << space
        self.count -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) for a piece of 1 to ``size`` ids."""
        fitting = self.spaces >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            number = self._take(space)
        else:
            if self.count == self.most:
                self._take((self.spaces & -self.spaces).bit_length() - 1)  # the fullest closes
            space, number = self.size, self.next
            self.next += 1
        left = space - length
        if left:
            self.of_space[left].append(number)
            self.spaces |= 1 << left
            self.count += 1
        return number, self.size - space

    def open(self) -> list[tuple[int, int]]:
        """(bin, ids in it) of the bins that are still open."""
        return [(number, self.size - space) for space, bins in enumerate(self.of_space) for number in bins]


def _packed(rows: DataFrame, turn: int, size: int, most: int) -> DataFrame:
    """The rows with their bin and offset, and a row of nulls for each bin left
    open, with the ids in it as ``used``; written once."""
    fields = rows.schema.fields
    length = rows.columns.index("length")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, count = [], 0
        for batch in batches:
            held.append(batch)
            count += len(batch)
            if count >= most:
                yield pa.Table.from_batches(held)
                held, count = [], 0
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = OpenBins(size, most, (turn << 56) + (TaskContext.get().partitionId() << 32))
        names, schema = [], None
        for rows in runs(batches):
            schema = rows.schema
            names = [*schema.names, "bin", "offset", "used"]
            lengths = rows.column(length).to_numpy()
            numbers, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for k in np.argsort(-lengths, kind="stable").tolist():
                numbers[k], offsets[k] = bins.place(int(lengths[k]))
            whole = pa.Table.from_arrays([*rows.columns, pa.array(numbers), pa.array(offsets), pa.nulls(len(lengths), pa.int64())], names=names)
            yield from whole.to_batches()
        left = bins.open()
        if left:
            empty = [pa.nulls(len(left), f.type) for f in schema]
            yield pa.RecordBatch.from_arrays([*empty, pa.array([b for b, _ in left], pa.int64()), pa.nulls(len(left), pa.int64()), pa.array([u for _, u in left], pa.int64())], names=names)

    named = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return materialize(rows.mapInArrow(run, f"{named}, bin long, offset long, used long"))


def pack(pieces: DataFrame, size: int = SIZE, open_bins: int = OPEN_BINS, fan: int = FAN) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows that have a ``length`` of 1 to ``size``.

    All columns go along. The bins that a task leaves open are rows of the next
    round; a bin moves whole, so its pieces' offsets grow by one number.
    """
    first = _packed(pieces, 0, size, open_bins)
    moved, left, turn, tasks = None, first.where("used IS NOT NULL").select("bin", F.col("used").alias("length")), 0, None
    while tasks != 1:
        tasks, turn = max(1, left.count() // (fan * open_bins)), turn + 1
        again = _packed(left.withColumnRenamed("bin", "old").repartition(tasks, "old").sortWithinPartitions(F.desc("length"), "old"), turn, size, open_bins)
        step = again.where("used IS NULL").select("old", F.col("bin").alias("to"), F.col("offset").alias("by"))
        left = again.where("used IS NOT NULL").select("bin", F.col("used").alias("length"))
        if moved is None:
            moved = step
        else:
            later = step.select(F.col("old").alias("to"), F.col("to").alias("_to"), F.col("by").alias("_by"))
            moved = moved.join(later, "to", "left").select("old", F.coalesce("_to", "to").alias("to"), (F.col("by") + F.coalesce("_by", F.lit(0))).alias("by"))
    placed = first.where("used IS NULL").drop("used")
    joined = placed.join(moved, placed["bin"] == moved["old"], "left")
    return joined.select(*[placed[f"`{c}`"] for c in pieces.columns], F.coalesce("to", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("by", F.lit(0))).alias("offset"))


def sequences(packed: DataFrame, key: str = "doc_id") -> DataFrame:
    """(sequence_id, length, ids, parts): the ids of each sequence and the pieces
    that they are made of; a sequence has at most ``size`` of them."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", F.col(key).alias(key), "piece", "ids"))).alias("parts")
    ids = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), ""))
    return packed.groupBy("sequence_id").agg(parts, F.sum("length").alias("length")).select("sequence_id", "length", ids.alias("ids"), F.transform("parts", lambda p: p.dropFields("ids")).alias("parts"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    tune(spark)
    pieces = pieces_of(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
