"""Operator 8: quality rules with cross-document line frequency.

Rules of one document come first: words, symbols, repeated lines and words in
repeated three-word windows. Then lines are compared between documents: each
line is normalised (lower case, digits as 0, white space as one space) and
hashed; per host the distinct documents of each hash are counted; lines in more
documents than the host's limit are removed, and a document of which too little
is left is rejected.

The limit is a share of the host's documents between a least and a greatest
number: a small host isn't judged by a few documents, and on a host of any size a
line in more than ``MOST_DOCUMENTS`` documents is boilerplate.

``documents`` has no url: its host is ``source``, a parameter.

Defined results: a null text counts as empty and fails the base rules; a null
host is a host of its own; each row counts as a document, so repeated rows count
repeatedly; a line counts once in a document; texts are read whole; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmill.llm.common import materialize, spare, table, text_or_empty, tune

# White space between words, and the characters counted as symbols.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MOST_REPEATED = 50, 50  # words; hundredths of words in repeated windows
LEAST_DOCUMENTS, SHARE, MOST_DOCUMENTS = 10, 0.01, 40  # a line is frequent above the share, within these bounds
LEAST_LEFT = 0.5  # share of a document's words that must be left

DIGIT = re.compile(r"[0-9]")


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that stand twice or more in the text."""
    n = len(words) - 2
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    size = len(number)
    pairs = np.unique(ids[:-1] * size + ids[1:], return_inverse=True)[1]  # dense, so that no product overflows
    _, place, times = np.unique(pairs[:-1] * size + ids[2:], return_inverse=True, return_counts=True)
    twice = np.flatnonzero(times[place] > 1)
    marked = np.zeros(len(words), bool)
    for k in range(3):
        marked[twice + k] = True
    return int(marked.sum())


def normalised(line: str) -> str:
    return DIGIT.sub("0", b" ".join(line.lower().encode().split()).decode())


def measures(text: str) -> tuple[int, int, int, int, int, dict[int, int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the words
    of each normalised line by its hash."""
    words = text.encode().split()  # of bytes: ASCII white space only
    lines: dict[int, int] = {}
    seen: set[str] = set()
    repeated = 0
    for line in text.split("\n"):
        count = len(line.encode().split())
        if not count:
            continue
        if line in seen:
            repeated += 1
        seen.add(line)
        hashed = xxhash.xxh64_intdigest(normalised(line)) - (1 << 63)
        lines[hashed] = lines.get(hashed, 0) + count
    chars = len(text) - sum(map(text.count, SPACE))
    return len(words), chars, sum(map(text.count, SYMBOLS)), repeated, repeated_words(words), lines


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(df: DataFrame, key: str = "doc_id", text_column: str = "text", host: str = "source") -> DataFrame:
    """(key, host, the five counts, lines): one pass over the texts."""

    def of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measures(t.as_py()) for t in batch.column(2)]
            counts = [pa.array([f[k] for f in found], pa.int64()) for k in range(len(COUNTS))]
            lines = [f[-1] for f in found]
            offsets = pa.array(np.cumsum([0, *map(len, lines)]), pa.int32())
            hashes = pa.array([h for d in lines for h in d], pa.int64())
            words = pa.array([w for d in lines for w in d.values()], pa.int32())
            listed = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([hashes, words], ["line", "words"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *counts, listed], names=["key", "host", *COUNTS, "lines"])

    rows = df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), text_or_empty(text_column).alias("text"))
    return rows.mapInArrow(of_batch, f"key long, host string, {', '.join(f'{c} long' for c in COUNTS)}, lines array<struct<line: long, words: int>>")


def frequent_lines(measured: DataFrame, least_documents: int = LEAST_DOCUMENTS, share: float = SHARE, most_documents: int = MOST_DOCUMENTS) -> DataFrame:
    """(host, line, documents) of lines in more documents than the host's limit."""
    hosts = measured.groupBy("host").agg(F.greatest(F.lit(least_documents).cast("double"), F.least(F.lit(most_documents).cast("double"), F.count("*") * F.lit(share))).alias("limit"))
    counted = measured.select("host", F.explode("lines.line").alias("line")).groupBy("host", "line").agg(F.count("*").alias("documents")).where(F.col("documents") > least_documents)
    return counted.join(hosts, "host").where("documents > limit").select("host", "line", "documents")


def quality_rules(df: DataFrame, key: str = "doc_id", text_column: str = "text", host: str = "source", least_documents: int = LEAST_DOCUMENTS, share: float = SHARE, least_left: float = LEAST_LEFT) -> DataFrame:
    """(key, the five counts, base_failed, kept, removed_words), a row for each row.

    The measured rows, without the texts, are written once. Line counts are
    summed where they lie before the shuffle; a very frequent line's rows join
    the few frequent lines by a join that Spark can split or broadcast by its
    measured size, and their words are summed by row.
    """
    measured = materialize(measure(df, key, text_column, host).withColumn("row", F.monotonically_increasing_id()))
    lines = measured.select("row", "host", F.explode("lines").alias("l")).select("row", "host", "l.line", "l.words")
    removed = lines.join(frequent_lines(measured, least_documents, share), ["host", "line"]).groupBy("row").agg(F.sum("words").alias("removed_words"))
    judged = measured.drop("lines", "host").join(removed, "row", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
    left = F.col("n_words") - F.col("removed_words")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    depleted = left < least_left * F.col("n_words")
    return judged.select(F.col("key").alias(key), *COUNTS, failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), "removed_words")


def without_frequent_lines(df: DataFrame, text_column: str = "text", host: str = "source", least_documents: int = LEAST_DOCUMENTS, share: float = SHARE) -> DataFrame:
    """The rows with their hosts' frequent lines taken out of the text.

    Rows are joined to the hashes of their own frequent lines, gathered by row.
    """
    row, frequent = spare(df, "_row"), spare(df, "_frequent")
    tagged = materialize(df.withColumn(row, F.monotonically_increasing_id()))
    measured = materialize(measure(tagged, row, text_column, host))
    lines = measured.select("key", "host", F.explode("lines.line").alias("line"))
    bad = lines.join(frequent_lines(measured, least_documents, share), ["host", "line"]).groupBy(F.col("key").alias(row)).agg(F.collect_set("line").alias(frequent))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, bad_lines: pd.Series) -> pd.Series:
        out = []
        for text, bad in zip(texts, bad_lines, strict=True):
            drop = set(() if bad is None else map(int, bad))
            out.append(text if not drop or text is None else "\n".join(x for x in text.split("\n") if xxhash.xxh64_intdigest(normalised(x)) - (1 << 63) not in drop))
        return pd.Series(out, dtype=object)

    return tagged.join(bad, row, "left").withColumn(text_column, cut(F.col(text_column), F.col(frequent))).drop(row, frequent)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return quality_rules(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
places AS (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 3),
windows AS (SELECT r, i, concat(ws[i], ' ', ws[i + 1], ' ', ws[i + 2]) AS three FROM places),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, three) AS n FROM windows) WHERE n > 1),
marked AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, i AS p FROM twice UNION ALL SELECT r, i + 1 FROM twice UNION ALL SELECT r, i + 2 FROM twice) GROUP BY r),
lines AS (SELECT r, host, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM (SELECT r, host, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
again AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY r),
plain AS (SELECT r, host, regexp_replace(array_to_string(regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+'), ' '), '[0-9]', '0', 'g') AS line, sum(words) AS words FROM lines GROUP BY 1, 2, 3),
hosts AS (SELECT host, greatest(10, least(40, count(*) * 0.01)) AS most FROM d GROUP BY host),
often AS (SELECT p.host, p.line FROM plain p JOIN hosts h ON p.host = h.host GROUP BY p.host, p.line, h.most HAVING count(*) > h.most),
gone AS (SELECT p.r, CAST(sum(p.words) AS BIGINT) AS n FROM plain p JOIN often o ON p.host = o.host AND p.line = o.line GROUP BY p.r),
told AS (
  SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(w.t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(w.t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(a.n, 0) AS n_dup_lines, coalesce(m.n, 0) AS n_repeat_words, coalesce(g.n, 0) AS removed_words
  FROM w LEFT JOIN marked m ON w.r = m.r LEFT JOIN again a ON w.r = a.r LEFT JOIN gone g ON w.r = g.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, removed_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - removed_words >= 0.5 * n_words AS kept
FROM told
"""
