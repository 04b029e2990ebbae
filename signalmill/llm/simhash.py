"""Operator 6: SimHash near-duplicates by multi-index hashing.

A fingerprint of 64 bits is cut into segments, each with a small radius, so that
by the pigeonhole principle two fingerprints within ``RADIUS`` bits differ in one
segment by its radius at most. Each fingerprint looks up the Hamming ball of that
radius around its segment in a table of all fingerprints' segments, and every
match is verified by the whole distance. How many segments there are, how wide
and with which radii follows from the number of fingerprints (:func:`plan`):
the more there are, the wider the segments, so that a look-up meets few others.

Only distinct fingerprints are linked: copies meet in a grouped minimum. Buckets
with more than ``HOT`` fingerprints are dealt out in tiles of bounded size; a
tile returns a spanning forest of its links, never all pairs. A fingerprint has
679,120 others within four bits, so no vertex has more links at any size of corpus.

:mod:`signalmill.llm.similar` finds documents of a given similarity in the same
way, with longer fingerprints.

Defined results: a null text counts as empty; a text without words has
fingerprint zero and is linked like any other; rows with a null key take part
and get the component's smallest key that isn't null; repeated keys give a row
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from signalmill.llm.common import materialize, spare, table, text_or_empty, tune
from signalmill.llm.components import connected_components, salted_join

SEED = 42
RADIUS = 4
#: Fingerprints of a bucket beyond which it is dealt out in tiles of this size.
HOT = 1024


def ball(bits: int, radius: int) -> list[int]:
    """Masks of at most ``radius`` of ``bits`` bits, none first."""
    return [sum(1 << i for i in flipped) for k in range(radius + 1) for flipped in combinations(range(bits), k)]


@lru_cache(maxsize=64)
def plan(count: int, radius: int = RADIUS, bits: int = 64) -> tuple[tuple[int, int, int], ...]:
    """(lowest bit, bits, radius) of each segment, for so many fingerprints: of the
    radii whose sum, each plus one, is ``radius`` + 1, and of the widths, those
    with the fewest look-ups and matches expected of unlike fingerprints. The last
    bit of the table's size is rounded up, so that nearly equal tables are alike."""
    count = 1 << max(0, count - 1).bit_length()

    def cost(width: int, r: int) -> float:
        return sum(comb(width, k) for k in range(r + 1)) * (1 + count / 2.0**width)

    @lru_cache(maxsize=None)
    def best(width: int, left: int) -> tuple[float, tuple]:
        """The cheapest segments of so many bits whose radii, each plus one, sum to ``left``."""
        whole = (cost(width, left - 1), ((width, left - 1),))
        found = [whole] if sum(comb(width, k) for k in range(left)) <= 4096 else [(float("inf"), whole[1])]
        for r in range(min(left - 1, 3)):
            for own in range(4, width - 3):
                if sum(comb(own, k) for k in range(r + 1)) <= 4096:
                    rest = best(width - own, left - r - 1)
                    found.append((cost(own, r) + rest[0], ((own, r), *rest[1])))
        return min(found)

    at, out = bits, []
    for width, r in best(bits, radius + 1)[1]:
        at -= width
        out.append((at, width, r))
    return tuple(out)


def fingerprint(text: str, words: int = 4) -> int:
    """Signed 64-bit SimHash of the text's word shingles."""
    found = text.encode().lower().split()  # of bytes: A-Z only, ASCII white space only
    if not found:
        return 0
    joined = b" ".join(found)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    size = min(words, len(found))
    starts = (ends - lengths)[: len(found) - size + 1].tolist()
    of = xxhash.xxh64_intdigest
    hashes = np.array([of(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65_536):  # bounds the memory of very long texts
        ones += np.unpackbits(hashes[k : k + 65_536].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">u8")[0].astype(np.uint64).view(np.int64))


def fingerprints(df: DataFrame, key: str = "doc_id", text_column: str = "text", words: int = 4) -> DataFrame:
    """(key, fp): one row for each row, without a shuffle."""

    def of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(t.as_py(), words) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], names=["key", "fp"])

    return df.select(F.col(key).cast("long").alias("key"), text_or_empty(text_column).alias("text")).mapInArrow(of_batch, "key long, fp long")


def _distance(a, b):
    return F.bit_count(a.bitwiseXOR(b))


def _buckets(nodes: DataFrame, segments, ask: bool) -> DataFrame:
    """(bucket, flipped, fp): each fingerprint's segments or, if it asks, what it
    looks up."""

    def places(k: int, low: int, bits: int, radius: int):
        value = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << bits) - 1)) if bits < 64 else F.col("fp")
        masks = F.array(*[F.lit(m).cast("long") for m in (ball(bits, radius) if ask else [0])])
        return F.transform(masks, lambda m: F.struct(F.lit(k).alias("segment"), value.bitwiseXOR(m).alias("value")))

    each = nodes.select("fp", F.explode(F.concat(*[places(k, *of) for k, of in enumerate(segments)])).alias("p"))
    return each.select(F.struct("p.segment", "p.value").alias("bucket"), "fp")


def forest(ids: np.ndarray, prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """What links within ``radius`` join among fingerprints (n, words of 64 bits):
    each group's first id with each other one of it. A vertex is compared with
    those not yet reached only, so a close group takes one comparison each."""
    left, edges = np.arange(len(ids)), []
    while len(left) > 1:
        first, front, left = int(ids[left[0]]), [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = np.bitwise_count(prints[left] ^ prints[x]).sum(1) <= radius
            if near.any():
                hit = left[near]
                edges += [(first, int(i)) for i in ids[hit]]
                front.extend(hit)
                left = left[~near]
    return edges


def _forest(shown: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """What the links of one tile join."""
    fps = np.unique(np.concatenate([shown.fp.to_numpy(np.int64), asked.asks.to_numpy(np.int64)])) if len(shown) and len(asked) else np.zeros(0, np.int64)
    return pd.DataFrame(forest(fps, fps.view(np.uint64)[:, None], RADIUS), columns=["u", "v"], dtype=np.int64)


def links(nodes: DataFrame, hot: int = HOT) -> DataFrame:
    """``nodes`` has distinct fingerprints (fp). Returns (u, v) pairs whose
    components are those of all pairs within RADIUS.

    Ordinary buckets are joined and each match is verified; hot ones go through
    tiles, so no task holds more than ``hot`` fingerprints of either side.
    """
    segments = plan(nodes.count())
    shown, asked = _buckets(nodes, segments, False), _buckets(nodes, segments, True)
    full = materialize(shown.groupBy("bucket").count().where(F.col("count") > hot))
    some = not full.isEmpty()
    kept = shown.join(full, "bucket", "left_anti") if some else shown
    met = kept.alias("s").join(asked.alias("a"), "bucket").where((_distance(F.col("s.fp"), F.col("a.fp")) <= RADIUS) & (F.col("a.fp") < F.col("s.fp")))
    found = met.select(F.col("a.fp").alias("u"), F.col("s.fp").alias("v"))
    if not some:
        return found
    asked_full = asked.join(full, "bucket", "left_semi").groupBy("bucket").agg(F.count("*").alias("asking"))
    sizes = materialize(full.join(asked_full, "bucket").select("bucket", F.ceil(F.col("count") / hot).cast("int").alias("rows"), F.ceil(F.col("asking") / hot).cast("int").alias("cols")))
    part = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = shown.join(sizes, "bucket").select("bucket", part("rows").alias("row"), every("cols").alias("col"), "fp")
    right = asked.join(sizes, "bucket").select("bucket", every("rows").alias("row"), part("cols").alias("col"), F.col("fp").alias("asks"))
    tile = ["bucket", "row", "col"]
    return found.unionByName(left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInPandas(lambda s, a: _forest(s, a), "u long, v long"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text_column: str = "text", words: int = 4, hot: int = HOT) -> DataFrame:
    """(key, fp, component): one row for each row; component is the smallest key
    that links reach, its own included."""
    rows = materialize(fingerprints(df, key, text_column, words))
    nodes = materialize(rows.groupBy("fp").agg(F.min("key").alias("least")))
    joined = connected_components(links(nodes.select("fp"), hot)).withColumnRenamed("node", "fp")
    joined = materialize(joined)
    groups = joined.join(nodes, "fp").groupBy("root").agg(F.min("least").alias("component"))
    of_fp = salted_join(joined, groups, "root").select("fp", "component")
    labels = nodes.join(of_fp, "fp", "left").select("fp", F.coalesce("component", "least").alias("component"))
    return rows.join(labels, "fp").select(F.col("key").alias(key), "fp", "component")


def without_near_duplicates(df: DataFrame, key: str = "doc_id", text_column: str = "text", words: int = 4, hot: int = HOT) -> DataFrame:
    """The rows, with their own columns, of the smallest key of each component of
    fingerprints (see :func:`least_of_each`)."""
    return least_of_each(df, near_duplicates(df, key, text_column, words, hot), key, text_column)


def least_of_each(df: DataFrame, found: DataFrame, key: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows, with their own columns, whose key is that of their component;
    ``found`` has (key, component).

    Rows that share a key stand or fall together, but of those with equal text
    one stays. Texts are shuffled once, by their key.
    """
    named, copy = spare(df, "_named"), spare(df, "_copy")
    name = F.coalesce(F.col(key).cast("long").cast("string"), F.lit("none"))
    stay = found.where(F.col(key).eqNullSafe(F.col("component"))).select(name.alias(named)).distinct()
    # The join and the window share their partitioning by name.
    rows = df.withColumn(named, name).join(stay, named, "left_semi")
    one = F.row_number().over(W.partitionBy(named, F.xxhash64(text_or_empty(text_column))).orderBy(F.lit(0)))
    return rows.withColumn(copy, one).where(F.col(copy) == 1).select(*[F.col(f"`{c}`") for c in df.columns])


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
