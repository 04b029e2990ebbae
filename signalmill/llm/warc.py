"""Operator 7: dictionary-compressed web archives.

A task writes one archive: WARC records of a run of pages in key order. A
Zstandard dictionary is built from a sample of the archive's records, drawn by
hash from all of them and bounded, embedded in a leading skippable frame, and
every record is then compressed in a frame of its own with it, so any record can
be read alone.

Pages with equal payloads are archived once: the one with the smallest key is
the response, the others are revisits that name it and keep its HTTP header.

Defined results: a null html counts as an empty payload, a null url is written
as ``urn:page:<key>``; payloads of any length are written whole; of rows with
equal key and payload the first is the response and the others revisit it; a
null key counts as larger than any other and is never named by a revisit; with
fewer records than a dictionary needs, the bytes of those drawn serve as a raw
one, maybe an empty one; an empty table gives no archive and an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmill.llm.common import materialize, new_folder, one_task_each, open_shared, parts_of, table, tune

#: Fixed values of the format: the skippable frame that holds a dictionary, and
#: the profile of a revisit of an identical payload.
DICTIONARY_FRAME = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A dictionary is built from at most so many records and bytes of an archive.
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 256, 1 << 20, 16 << 10
#: Bytes of html of an archive, and rows of a file of the manifest.
FILE_BYTES, MANIFEST_ROWS = 32 << 20, 10_000
DATE = "2024-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(key: int | None) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{key}').urn}>"


def _line(value: str) -> str:
    return "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in value)


def record(key: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit has the HTTP header but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(key),
        "WARC-Target-URI": _line(url) if url else f"urn:page:{key}",
        "WARC-Date": DATE,
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if key is not None:
        head["X-Page-ID"] = str(key)
    if revisit:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to), "X-Refers-To-Page-ID": str(refers_to)}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC header, HTTP header and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


def build_dictionary(samples: list[bytes]) -> bytes:
    if len(samples) >= 8:
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8).as_bytes()
        except zstandard.ZstdError:
            pass  # too little or too uniform for training
    return b"".join(samples)[:DICTIONARY_BYTES]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_AUTO)


def write_archive(sink, records: Iterator[bytes], sample: list[bytes] | None = None, level: int = 3) -> int:
    """Writes records to a stream; returns their number. Without a ``sample`` the
    dictionary is built from the first records."""
    ahead: list[bytes] = []
    if sample is None:
        held = 0
        for data in records:
            ahead.append(data)
            held += len(data)
            if len(ahead) >= SAMPLE_RECORDS or held >= SAMPLE_BYTES:
                break
        sample = ahead
        if not ahead:
            return 0
    learned = build_dictionary([s[: SAMPLE_BYTES // 8] for s in sample])
    sink.write(DICTIONARY_FRAME.to_bytes(4, "little") + len(learned).to_bytes(4, "little") + learned)
    compress, count = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(learned), write_checksum=True).compress, 0
    for data in chain(ahead, records):
        sink.write(compress(data))
        count += 1
    return count


def read_archive(source, piece: int = 1 << 16) -> Iterator[bytes]:
    """Records of a stream, one at a time."""
    head = source.read(8)
    if not head:
        return
    if int.from_bytes(head[:4], "little") != DICTIONARY_FRAME:
        raise ValueError("no dictionary frame")
    reader = zstandard.ZstdDecompressor(dict_data=_dictionary(source.read(int.from_bytes(head[4:], "little"))))
    rest = source.read(piece)
    while rest:
        frame, out = reader.decompressobj(), []
        while not frame.eof:
            if not rest:
                raise ValueError("the archive ends within a record")
            out.append(frame.decompress(rest))
            rest = frame.unused_data if frame.eof else source.read(piece)
        rest = rest or source.read(piece)
        yield b"".join(out)


def payload_digests(df: DataFrame, key: str = "page_id", html_column: str = "html") -> DataFrame:
    """(key, digest, size) of every page, itself written once: the texts are read
    and hashed for it a single time, whatever is asked of it later."""
    return materialize(df.select(F.col(key).cast("long").alias("key"), _digest(html_column).alias("digest"), _size(html_column).alias("size")))


def repeated_payloads(digests: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(key, digest, first) of pages whose payload has a page with a smaller key,
    a row for each such page, so that a repeated key may be named repeatedly.

    Only keys and digests are shuffled; a payload that many pages share is
    summed where it lies, and its pages join by a join that Spark can split.
    """
    pages = digests.where(F.col("size") >= least_bytes)
    first = pages.groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    return pages.select("key", "digest").join(first, "digest").where(~F.col("key").eqNullSafe(F.col("first"))).select("key", "digest", "first")


def _digest(html_column: str):
    return F.sha1(F.coalesce(F.col(html_column).cast("string"), F.lit("")).cast("binary"))


def _size(html_column: str):
    return F.octet_length(F.coalesce(F.col(html_column).cast("string"), F.lit("")))


def write_warc(df: DataFrame, folder: str, key: str = "page_id", url_column: str = "url", html_column: str = "html", least_bytes: int = 0, partitions: int | None = None) -> DataFrame:
    """Writes archives and returns their manifest, itself written once, in files
    of many rows: number, path, records.

    Payloads are shuffled once, by ranges of the key; the rows that say whom a
    page revisits travel with them and are merged in the sorted partition.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()

        rows = (tuple(v.as_py() for v in row) for batch in batches for row in zip(*batch.columns, strict=True))
        sample, held, head = [], 0, None
        for head in rows:  # the drawn copies stand first
            if not head[-1]:
                break
            if len(sample) < 2 * SAMPLE_RECORDS and held < SAMPLE_BYTES:
                data = (head[4] or "").encode()
                sample.append(record(head[0], head[3], data, payload_digest(data), None, False)[: SAMPLE_BYTES // 8])
                held += len(sample[-1])
        if head is None or head[-1]:
            return

        def records() -> Iterator[bytes]:
            known, before = {}, None
            for k, digest, first, url, html, large, _ in chain([head], rows):
                if first is not None:
                    known = {(k, digest): first}
                    continue
                payload = (html or "").encode()
                refers = known.get((k, digest))
                if refers is None and large and k is not None and before == (k, digest):
                    refers = k
                before = (k, digest)
                yield record(k, url, payload, payload_digest(payload), refers, refers is not None)

        number = task.partitionId()
        with open_shared(f"{folder}/pages-{number:06d}.warc.zst", task.taskAttemptId()) as sink:
            count = write_archive(sink.open(), records(), sample)
        yield pa.RecordBatch.from_pylist([{"file": number, "path": sink.path, "records": count}], pa.schema([("file", pa.int32()), ("path", pa.string()), ("records", pa.int64())]))

    none = F.lit(None)
    digests = payload_digests(df, key, html_column)
    count, total = digests.agg(F.count("*"), F.sum("size")).first()
    partitions = partitions or parts_of(df.sparkSession, total or 0, FILE_BYTES)
    share = min(1.0, SAMPLE_RECORDS * partitions / max(1, count))
    chosen = F.pmod(F.xxhash64("key", "url", "digest"), F.lit(1 << 30)) < int(share * (1 << 30))
    pages = df.select(F.col(key).cast("long").alias("key"), _digest(html_column).alias("digest"), none.cast("long").alias("first"), F.col(url_column).cast("string").alias("url"), F.col(html_column).cast("string").alias("html"), (_size(html_column) >= least_bytes).alias("large"))
    pages = pages.withColumn("drawn", F.explode(F.array(F.lit(False), F.lit(True)))).where(~F.col("drawn") | chosen)  # page and drawn copy from one reading
    said = repeated_payloads(digests, least_bytes).select("key", "digest", "first", none.cast("string").alias("url"), none.cast("string").alias("html"), F.lit(True).alias("large"), F.lit(False).alias("drawn"))
    order = [F.desc("drawn"), "key", "digest", F.col("first").asc_nulls_last(), "url"]
    written = pages.unionByName(said).repartitionByRange(partitions, "key").sortWithinPartitions(*order).mapInArrow(write, "file int, path string, records long")
    return materialize(written.repartition(-(-partitions // MANIFEST_ROWS)))


def read_warc(manifest: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url) of
    every record of the archives. A response's payload is measured and its digest
    checked; a revisit's are those of its headers."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with open_shared(path) as source:
                    rows = []
                    for data in read_archive(source.open()):
                        head, http, payload = parse_record(data)
                        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        revisit = head["WARC-Type"] == "revisit"
                        size = int(http["Content-Length"]) if revisit else len(payload)
                        if not revisit and payload_digest(payload) != digest:
                            raise ValueError(f"{path}: damaged payload of page {head.get('X-Page-ID')}")
                        rows.append((int(head["X-Page-ID"]) if "X-Page-ID" in head else None, size, digest, head["WARC-Type"], int(head["X-Refers-To-Page-ID"]) if revisit else None, head["WARC-Target-URI"]))
                        if len(rows) == 2000:
                            yield _batch(rows)
                            rows = []
                    yield _batch(rows)

    return one_task_each(manifest.select("file", "path"), "file").select("path").mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    manifest = write_warc(table(spark, sf_dir, "pages"), new_folder(spark, "warc"))
    return read_warc(manifest).drop("url")


_BITS = [f"{i:04b}" for i in range(16)]
_VALUE = " + ".join(f"CAST(substr(bits, CAST(i * 5 + {k} AS BIGINT), 1) AS INTEGER) * {2 ** (5 - k)}" for k in range(1, 6))

SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, html, array_to_string(list_transform(string_split(sha1(html), ''), lambda c: {_BITS}[instr('0123456789abcdef', c)]), '') AS bits, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST({_VALUE} + 1 AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""
