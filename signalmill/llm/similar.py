"""Documents of similar word shingles, by SimHash and multi-index hashing.

The similarity of two texts is the share of word shingles (five words, of
lower-cased texts) that they have in common. It is estimated from fingerprints
of ``BITS`` bits: of two texts of similarity s about ``BITS`` * arccos(2s / (1 + s)) / pi
bits differ. Links are the pairs whose whole distance is within that number and
a margin of 1.65 standard deviations, so that 95 of 100 pairs at the very
boundary are found and nearly all beyond it. With 384 bits the estimate has that
margin on the other side too: half of the pairs at 0.74, a fifth at 0.68 and hardly
any below 0.6 are linked as well.

Fingerprints are cut into segments. The bits of a segment that differ between
similar texts are mostly those that were hardly decided, so of each segment only
the ball over its least certain bits is enumerated, by both sides: two texts meet
in a segment's bucket if all differing bits are among the uncertain ones of either.
:func:`plan` chooses how wide segments are, how many and how many bits are
uncertain from the number of texts, so that ``RECALL`` of the pairs at the boundary
meet in some segment while unlike texts hardly meet at any size of corpus.

Equal texts (of equal words) are one vertex. A bucket of many texts returns a
spanning forest of verified links, computed in blocks of bounded size. As texts of
a large group meet in many buckets, each text's largest bucket is linked first;
the other buckets then return only links between what that left apart.

Defined results: a null text counts as empty; texts without words are equal;
texts shorter than a shingle are one shingle; rows with a null key take part and
get the component's smallest key that isn't null; repeated keys give a row each;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import acos, ceil, log, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalmill.llm.common import materialize, text_or_empty
from signalmill.llm.components import connected_components, salted_join
from signalmill.llm.simhash import SEED, forest, least_of_each

WORDS, SIMILARITY, BITS, RECALL = 5, 0.8, 384, 0.95
#: Texts of a bucket up to which pairs are joined, and texts of a block beyond.
FEW, BLOCK = 4, 65_536


def differing(similarity: float) -> float:
    """Share of the bits that differ between two texts."""
    return acos(2 * similarity / (1 + similarity)) / pi


def radius_of(similarity: float, bits: int = BITS) -> int:
    p = differing(similarity)
    return int(bits * p + 1.65 * sqrt(bits * p * (1 - p)))


@lru_cache(maxsize=64)
def plan(count: int, similarity: float = SIMILARITY, bits: int = BITS, recall: float = RECALL) -> tuple[int, int, int]:
    """(width of a segment, uncertain bits, segments) for so many texts. What
    share of pairs meets in a segment is simulated: two sides' margins are normal
    and correlated as the shingle counts of texts of that similarity are."""
    draw = np.random.default_rng(0)
    alike = 2 * similarity / (1 + similarity)
    one = draw.normal(size=(3000, 48))
    other = alike * one + np.sqrt(1 - alike**2) * draw.normal(size=one.shape)
    flipped = (one > 0) != (other > 0)
    best = None
    for width in range(8, 49):
        ranks = [np.abs(x[:, :width]).argsort(1).argsort(1) for x in (one, other)]
        nearest = np.minimum(*ranks)
        # the uncertain bits needed until all flips of the segment are among them
        needed = np.where(flipped[:, :width], nearest + 1, 0).max(1)
        for uncertain in range(min(8, width) + 1):
            met = float((needed <= uncertain).mean())
            if not met:
                continue
            segments = 1 if met > recall else ceil(log(1 - recall) / log(1 - met))
            if segments * width > bits:
                continue
            chance = 2.0 ** (2 * uncertain - width)  # that two unlike texts meet in a segment
            cost = segments * (2**uncertain + count * chance)
            best = min(best or (cost, width, uncertain, segments), (cost, width, uncertain, segments))
    return best[1:]


def fingerprint(text: str, words: int = WORDS, bits: int = BITS) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(digest of the words, fingerprint as words of 64 bits, margin of each bit)."""
    found = text.encode().lower().split()  # of bytes: A-Z only, ASCII white space only
    joined = b" ".join(found)
    digest = xxhash.xxh3_128_digest(joined)
    if not found:
        return digest, np.zeros(bits // 64, np.uint64), np.zeros(bits, np.int64)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    size = min(words, len(found))
    starts = (ends - lengths)[: len(found) - size + 1].tolist()
    of = xxhash.xxh64_intdigest
    hashes = np.unique(np.array([of(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)], np.uint64))
    ones = np.zeros(bits, np.int64)
    steps = np.arange(bits // 64, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(0, len(hashes), 65_280):  # bounds the memory of very long texts
        mixed = hashes[k : k + 65_280, None] + steps
        mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(31)
        each = np.unpackbits(mixed.astype(">u8").view(np.uint8), axis=1)
        whole = len(each) // 255 * 255  # sums of 255 bits fit a byte
        if whole:
            ones += each[:whole].reshape(-1, 255, bits).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
        ones += each[whole:].sum(0, dtype=np.uint8)
    return digest, np.packbits(2 * ones > len(hashes)).view(">u8").astype(np.uint64), np.abs(2 * ones - len(hashes))


def _marked(df: DataFrame, key: str, text_column: str, words: int, shape: tuple[int, int, int]) -> DataFrame:
    """(key, digest, fp, weak): weak has the places of each segment's uncertain bits."""
    width, uncertain, segments = shape

    def of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, prints, weak = [], [], []
            for value in batch.column(1):
                digest, fp, margin = fingerprint(value.as_py(), words)
                places = margin[: segments * width].reshape(segments, width).argsort(1, kind="stable")[:, :uncertain]
                digests.append(digest)
                prints.append(fp.astype("<u8").tobytes())
                weak.append(places.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(prints, pa.binary()), pa.array(weak, pa.binary())], names=["key", "digest", "fp", "weak"])

    rows = df.select(F.col(key).cast("long").alias("key"), text_or_empty(text_column).alias("text"))
    return rows.mapInArrow(of_batch, "key long, digest binary, fp binary, weak binary")


def _prints(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(len(column), -1)


def bucket_rows(nodes: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """(bucket, node): the ball over the uncertain bits of each segment."""
    width, uncertain, segments = shape
    subset = (np.arange(1 << uncertain)[:, None] >> np.arange(uncertain)) & 1  # (balls, uncertain)

    def of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                some = batch.slice(start, 1000)
                n = some.num_rows
                bits = np.unpackbits(_prints(some.column(1)).astype(">u8").view(np.uint8).reshape(n, -1), axis=1)[:, : segments * width].reshape(n, segments, width)
                value = (bits.astype(np.int64) << np.arange(width, dtype=np.int64)).sum(2)
                weak = np.frombuffer(b"".join(some.column(2).to_pylist()), np.uint8).reshape(n, segments, uncertain).astype(np.int64)
                masks = ((np.int64(1) << weak)[:, :, None, :] * subset).sum(3)  # (n, segments, balls)
                bucket = (value[:, :, None] ^ masks) | (np.arange(segments, dtype=np.int64) << width)[None, :, None]
                node = np.repeat(some.column(0).to_numpy(), segments << uncertain)
                yield pa.RecordBatch.from_arrays([pa.array(bucket.ravel(), pa.int64()), pa.array(node, pa.int64())], names=["bucket", "node"])

    return nodes.select("node", "fp", "weak").mapInArrow(of_batch, "bucket long, node long")


def between(edges: list[tuple[int, int]], label: dict[int, int]) -> list[tuple[int, int]]:
    """The pairs that join vertices of different labels, one for each join."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    kept = []
    for u, v in edges:
        a, b = find(label[u]), find(label[v])
        if a != b:
            root[max(a, b)] = min(a, b)
            kept.append((u, v))
    return kept


def _forests(radius: int):
    """Links of sorted (bucket, tile, node, fp, label) rows, group by group."""

    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # pieces of the group at hand
        last, seen = None, {}

        def close() -> list[tuple[int, int]]:
            ids, prints, labels = (np.concatenate([h[k] for h in held]) for k in range(3))
            if len(ids) < 2 or labels.min() == labels.max():
                return []
            name = xxhash.xxh3_128_digest(ids.tobytes())
            if name in seen:  # the same texts met in another bucket
                return []
            if len(seen) > 100_000:
                seen.clear()
            seen[name] = True
            return between(forest(ids, prints, radius), dict(zip(ids.tolist(), labels.tolist(), strict=True)))

        for batch in batches:
            if not batch.num_rows:
                continue
            group = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], 1)
            ids, prints, labels = batch.column(2).to_numpy(), _prints(batch.column(3)), batch.column(4).to_numpy()
            cuts = [0, *(np.flatnonzero((group[1:] != group[:-1]).any(1)) + 1), len(ids)]
            edges: list[tuple[int, int]] = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                this = tuple(group[a].tolist())
                if held and this != last:
                    edges += close()
                    held = []
                last = this
                held.append((ids[a:b], prints[a:b], labels[a:b]))
            yield _edges(edges)
        if held:
            yield _edges(close())

    return of_partition


def _edges(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    flat = np.array(edges, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["u", "v"])


def links(nodes: DataFrame, shape: tuple[int, int, int], radius: int, few: int = FEW, block: int = BLOCK) -> DataFrame:
    """``nodes`` has (node, fp, weak). Returns (u, v) links within ``radius`` whose
    components are those of all pairs that meet in a bucket.

    Buckets of one text, most of them, go before anything else moves. Pairs of
    small buckets are joined, made distinct and verified; larger buckets are
    streamed in sorted order, in tiles of two blocks if they exceed a block.
    """
    rows = bucket_rows(nodes, shape)
    shared = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    met = materialize(rows.join(shared, "bucket"))
    small = met.where(F.col("n") <= few).select("bucket", "node")
    pairs = small.alias("a").join(small.alias("b"), "bucket").where("a.node < b.node").select(F.col("a.node").alias("u"), F.col("b.node").alias("v")).distinct()
    prints = nodes.select("node", "fp")
    both = pairs.join(prints.toDF("u", "fu"), "u").join(prints.toDF("v", "fv"), "v")
    apart = sum((F.bit_count(_word("fu", k).bitwiseXOR(_word("fv", k))) for k in range(1, BITS // 64)), F.bit_count(_word("fu", 0).bitwiseXOR(_word("fv", 0))))
    found = both.where(apart <= radius).select("u", "v")
    large = materialize(met.where(F.col("n") > few))
    if large.isEmpty():
        return found
    largest = large.groupBy("node").agg(F.max(F.struct("n", "bucket")).alias("m")).select("m.bucket", "node", "m.n")
    first = materialize(_linked(largest.withColumn("label", F.col("node")), prints, radius, block))
    # a text is in one largest bucket, so what its links join there is told by its first id
    labels = first.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("_root"))
    labelled = materialize(large.join(labels, "node", "left").withColumn("label", F.coalesce("_root", "node")).drop("_root"))
    apart_ = labelled.groupBy("bucket").agg((F.min("label") != F.max("label")).alias("open")).where("open").select("bucket")
    rest = _linked(labelled.join(apart_, "bucket", "left_semi"), prints, radius, block)
    return found.unionByName(first).unionByName(rest)


def _linked(rows: DataFrame, prints: DataFrame, radius: int, block: int) -> DataFrame:
    """(u, v) links between labels of (bucket, node, n, label) rows, in each bucket."""
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.least(own, o) * blocks + F.greatest(own, o))
    tiled = rows.join(prints, "node").select("bucket", F.explode(F.array_distinct(tiles)).alias("tile"), "node", "fp", "label")
    grouped = tiled.repartition("bucket", "tile").sortWithinPartitions("bucket", "tile", "node")
    return grouped.mapInArrow(_forests(radius), "u long, v long")


def _word(column: str, k: int):
    """The k-th 64 bits of a binary column."""
    return F.conv(F.hex(F.substring(column, 8 * k + 1, 8)), 16, -10).cast("long")


def similar_documents(df: DataFrame, key: str = "doc_id", text_column: str = "text", words: int = WORDS, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """(key, component): one row for each row; component is the smallest key among
    the texts that links reach, its own included."""
    shape = plan(1 << max(0, df.count() - 1).bit_length(), similarity)
    rows = materialize(_marked(df, key, text_column, words, shape))
    nodes = rows.groupBy("digest").agg(F.min("key").alias("least"), F.first("fp").alias("fp"), F.first("weak").alias("weak"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()))
    joined = materialize(connected_components(links(nodes, shape, radius_of(similarity), block=block)))
    least = nodes.select("node", "least")
    groups = joined.join(least, "node").groupBy("root").agg(F.min("least").alias("component"))
    of_node = salted_join(joined, groups, "root").select("node", "component")
    labels = nodes.select("node", "digest", "least").join(of_node, "node", "left").select("digest", F.coalesce("component", "least").alias("component"))
    return rows.select("key", "digest").join(labels, "digest").select(F.col("key").alias(key), "component")


def without_similar(df: DataFrame, key: str = "doc_id", text_column: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows, with their own columns, of the smallest key of each group of similar texts."""
    return least_of_each(df, similar_documents(df, key, text_column, words, similarity), key, text_column)
