"""Operator 10: token ids in binary files by bit-plane shuffling.

A file holds the ids of a run of documents, in ascending key order, as unsigned
32-bit integers in blocks of fixed size. A block is transposed: its byte planes
(or bit planes) are laid one after another and each plane is compressed with
zstandard, so the high planes of small ids shrink to nothing. A chunk index at
the end has each block's place and plane lengths, the documents' keys and
counts, and checksums, so a reader fetches only the blocks it needs.

File: magic, planes of all blocks, compressed documents' keys and counts, JSON
index, length of the index (8 bytes, little-endian), magic.

Defined results: a null text counts as empty and holds only the end id; rows
with a null key come first; rows of equal keys are ordered by their text, and
each is written; an empty table gives no file and an empty result; texts may be
of any length, a document may span blocks; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from signalmill.llm.bpe import Encoder, Vocabulary, byte_letters, tokenizer_file
from signalmill.llm.common import materialize, new_folder, one_task_each, open_shared, parts_of, table, text_or_empty, tune

MAGIC = b"IDPLANE1"
BLOCK_IDS = 1 << 16
#: Bytes of text of a file.
FILE_BYTES = 32 << 20
END_ID = 0


def planes_of(ids: np.ndarray, bits: bool) -> list[bytes]:
    """Transposed planes of a block of uint32 ids, lowest first."""
    if not bits:
        return [plane.tobytes() for plane in ids.astype("<u4").view(np.uint8).reshape(-1, 4).T]
    return [np.packbits((ids >> np.uint32(k)) & np.uint32(1)).tobytes() for k in range(32)]


def ids_of(planes: list[bytes], count: int, bits: bool) -> np.ndarray:
    if not bits:
        return np.ascontiguousarray(np.stack([np.frombuffer(p, np.uint8) for p in planes], 1)).view("<u4").ravel()
    ids = np.zeros(count, np.uint32)
    for k, p in enumerate(planes):
        ids |= np.unpackbits(np.frombuffer(p, np.uint8), count=count).astype(np.uint32) << np.uint32(k)
    return ids


class PlaneWriter:
    """Writes one file; holds one block of ids and the documents' counts."""

    def __init__(self, sink, block_ids: int = BLOCK_IDS, bits: bool = False, level: int = 3):
        self.sink, self.block_ids, self.bits = sink, block_ids, bits
        self.compress = zstandard.ZstdCompressor(level=level).compress
        self.held: list[bytes] = []
        self.held_ids, self.at = 0, 0
        self.blocks: list[dict] = []
        self.keys: list[int | None] = []
        self.counts: list[int] = []
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def add(self, key: int | None, ids: bytes) -> None:
        """ids: little-endian unsigned 32-bit integers."""
        self.keys.append(key)
        self.counts.append(len(ids) // 4)
        self.held.append(ids)
        self.held_ids += len(ids) // 4
        if self.held_ids >= self.block_ids:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        data = np.frombuffer(b"".join(self.held), "<u4")
        end = len(data) if last else len(data) // self.block_ids * self.block_ids
        for k in range(0, end, self.block_ids):
            block = data[k : k + self.block_ids]
            planes = [self.compress(p) for p in planes_of(block, self.bits)]
            self.blocks.append({"at": self.at, "ids": len(block), "planes": [len(p) for p in planes], "crc": zlib.crc32(block.tobytes())})
            self._put(b"".join(planes))
        self.held, self.held_ids = [data[end:].tobytes()], len(data) - end

    def close(self) -> int:
        """Writes what is left and the index; returns the file's ids."""
        self._flush(last=True)
        keys = np.array([0 if k is None else k for k in self.keys], "<i8")
        known = np.packbits(np.array([k is not None for k in self.keys], bool))
        parts = [self.compress(a.tobytes()) for a in (keys, known, np.array(self.counts, "<i8"))]
        index = {"bits": self.bits, "block_ids": self.block_ids, "blocks": self.blocks, "documents": len(self.keys), "at": self.at, "parts": [len(p) for p in parts]}
        self._put(b"".join(parts))
        said = json.dumps(index).encode()
        self._put(said + len(said).to_bytes(8, "little") + MAGIC)
        return sum(self.counts)


class PlaneReader:
    """Reads documents back from a seekable file, block by block."""

    def __init__(self, source):
        self.source = source
        source.seek(0, 2)
        size = source.tell()
        tail = self._get(size - 16, 16)
        if tail[8:] != MAGIC or self._get(0, 8) != MAGIC:
            raise ValueError("not a token-plane file")
        length = int.from_bytes(tail[:8], "little")
        self.index = json.loads(self._get(size - 16 - length, length))
        at, parts = self.index["at"], []
        for n in self.index["parts"]:
            parts.append(zstandard.ZstdDecompressor().decompress(self._get(at, n)))
            at += n
        n = self.index["documents"]
        known = np.unpackbits(np.frombuffer(parts[1], np.uint8), count=n).astype(bool)
        self.keys = [int(k) if there else None for k, there in zip(np.frombuffer(parts[0], "<i8"), known, strict=True)]
        self.counts = np.frombuffer(parts[2], "<i8").tolist()

    def _get(self, at: int, length: int) -> bytes:
        self.source.seek(at)
        return self.source.read(length)

    def block(self, k: int) -> np.ndarray:
        said = self.index["blocks"][k]
        data, at, planes = self._get(said["at"], sum(said["planes"])), 0, []
        for n in said["planes"]:
            planes.append(zstandard.ZstdDecompressor().decompress(data[at : at + n]))
            at += n
        ids = ids_of(planes, said["ids"], self.index["bits"])
        if zlib.crc32(ids.tobytes()) != said["crc"]:
            raise ValueError(f"block {k} is damaged")
        return ids

    def documents(self) -> Iterator[tuple[int | None, list[np.ndarray]]]:
        """(key, pieces of its ids) in the order of the file."""
        k, rest = 0, np.zeros(0, np.uint32)
        for key, count in zip(self.keys, self.counts, strict=True):
            pieces, need = [], count
            while need:
                if not len(rest):
                    rest, k = self.block(k), k + 1
                pieces.append(rest[:need])
                rest = rest[need:]
                need -= len(pieces[-1])
            yield key, pieces


class _LibraryVocabulary(Vocabulary):
    """The vocabulary with the tokenizers library's own merging of a pretoken."""

    def __init__(self, spec: bytes):
        from tokenizers import Tokenizer

        super().__init__(spec)
        self.model = Tokenizer.from_str(spec.decode()).model
        self.letters = {b: c for c, b in byte_letters().items()}

    def merge(self, word: bytes) -> list[int]:
        return [t.id for t in self.model.tokenize(word.decode("latin-1").translate(self.letters))]


@lru_cache(maxsize=4)
def binary_encoder(spec: bytes) -> Encoder:
    return Encoder(_LibraryVocabulary(spec), lambda ids: np.array(ids, "<u4").tobytes(), b"")


FILES = "file int, path string, documents long, ids long"


def write_ids(df: DataFrame, vocabulary_path: str, folder: str, key: str = "doc_id", text_column: str = "text", bits: bool = False, block_ids: int = BLOCK_IDS, end_id: int = END_ID, partitions: int | None = None) -> DataFrame:
    """Writes the ids of all texts, each with the end id, and returns the files'
    manifest, itself written once: file number, path, documents, ids.

    Rows are range-partitioned and sorted by key, a file for each partition;
    without ``partitions`` their number follows from the bytes of the texts. A
    task writes under a name of its own and renames at its end, so a repeated
    task leaves one whole file.
    """
    spec = tokenizer_file(df.sparkSession, vocabulary_path)
    last = np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = binary_encoder(spec.value), TaskContext.get()
        number, writer = task.partitionId(), None
        with open_shared(f"{folder}/ids-{number:06d}.bin", task.taskAttemptId()) as sink:
            for batch in batches:
                for k, text in zip(batch.column(0), batch.column(1), strict=True):
                    writer = writer or PlaneWriter(sink.open(), block_ids, bits)
                    writer.add(k.as_py(), b"".join([*encoder(text.as_py()), last]))
            ids = writer.close() if writer else 0
        if writer:
            yield pa.RecordBatch.from_pylist([{"file": number, "path": sink.path, "documents": len(writer.keys), "ids": ids}], pa.schema([("file", pa.int32()), ("path", pa.string()), ("documents", pa.int64()), ("ids", pa.int64())]))

    rows = df.select(F.col(key).cast("long").alias("key"), text_or_empty(text_column).alias("text"))
    partitions = partitions or parts_of(df.sparkSession, rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0, FILE_BYTES)
    return materialize(rows.repartitionByRange(partitions, "key").sortWithinPartitions("key", "text").mapInArrow(write, FILES))


def read_ids(manifest: DataFrame) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, read from the files.

    The files' offsets are a running sum over the manifest, a row for each file.
    Every file has a task, which holds one block of it at a time.
    """
    offset = F.coalesce(F.sum("ids").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("file", "path", offset.cast("long").alias("offset"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with open_shared(row["path"]) as source:
                    reader = PlaneReader(source.open())
                    keys, starts, counts, sums, at = [], [], [], [], row["offset"]
                    for key, pieces in reader.documents():
                        crc, count = 0, sum(map(len, pieces))
                        for piece in pieces:
                            crc = zlib.crc32(piece.tobytes(), crc)
                        keys.append(key)
                        starts.append(at)
                        counts.append(count)
                        sums.append(crc)
                        at += count
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())], names=["key", "start", "n_tokens", "ids_crc32"])

    return one_task_each(files, "file").mapInArrow(read, "key long, start long, n_tokens long, ids_crc32 long")


def op10_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    tune(spark)
    manifest = write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), new_folder(spark, "token-planes"))
    return read_ids(manifest).withColumnRenamed("key", "doc_id")
