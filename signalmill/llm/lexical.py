"""Operator 11: ranked lexical search over a clustered index.

Documents are put in an order in which neighbours share terms, by recursive graph
bisection: a set of documents is halved, and documents change sides in pairs as
long as the terms' gaps get cheaper. The first halvings are learned on a bounded
sample, and every document is routed by what they learned; range partitions of
that order are bisected further by their own tasks, over all their documents.
The order decides how fast a search is, never what it finds.

Neighbours form clusters. The index has a row for each cluster: its documents,
its terms, and for each term the documents' impacts and their greatest. The sum
of an item's term weights times the greatest impacts bounds every score in the
cluster. A search visits in each shard (a batch of the index's rows) the cluster
with the best bound first; the tenth best score so far over all shards is where
all others start. Then each shard visits its clusters by falling bound and stops
exactly where the bound is below the tenth best score; equal bounds are visited, since a
smaller id wins a tie. Results are mapped back from places to ids.

Items are a stated set of queries, taken in blocks of ``BLOCK`` against all rows.

Defined results: a null text has no terms; a document or item without terms takes
no part; each of repeated documents takes part; a null id comes first among equal
scores; equal items (id and text) count once; items of equal id and other text
are ranked apart; empty tables give no rows; texts are read whole; other columns
are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from signalmill.llm.common import new_folder, parts_of, table, text_or_empty, tune

#: Terms are hashed to so many features; they serve the order alone.
FEATURES = 1 << 14
#: Documents (expected) on which the first halvings are learned, and how many levels they have.
SAMPLE, DEPTH = 4096, 6
#: Rounds of exchanges of a halving.
ROUNDS = 8
#: A cluster has at most so many documents, and at most so many postings unless one document has more.
CLUSTER, CLUSTER_POSTINGS = 128, 1 << 16
#: Bytes of terms of a partition that one task bisects and indexes.
PART_BYTES = 12 << 20
BLOCK = 1024

#: Separators as spaces, A-Z lower-cased; all bytes of other characters belong to terms.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(LETTERS).split()


def features_of(terms) -> np.ndarray:
    return np.unique(np.fromiter((zlib.crc32(t) % FEATURES for t in terms), np.uint16))


class Bags:
    """Feature sets of documents, one after another."""

    def __init__(self, sets: list[np.ndarray]):
        self.flat = np.concatenate([*sets, np.zeros(0, np.uint16)]).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)

    def __len__(self) -> int:
        return len(self.starts) - 1

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """The sum of each document's weights."""
        total = np.concatenate([[0.0], np.cumsum(weights[self.flat])])
        return total[self.starts[1:]] - total[self.starts[:-1]]

    def counts(self, chosen: np.ndarray) -> np.ndarray:
        return np.bincount(self.flat, np.repeat(chosen, np.diff(self.starts)).astype(float), FEATURES)

    def of(self, documents: np.ndarray) -> Bags:
        lengths = np.diff(self.starts)[documents]
        starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        picked = Bags([])
        picked.flat = self.flat[np.repeat(self.starts[documents] - starts[:-1], lengths) + np.arange(starts[-1])]
        picked.starts = starts
        return picked


def halved(bags: Bags, rounds: int = ROUNDS) -> np.ndarray:
    """Which documents go right: the first half stays left to begin with, then
    pairs change sides while a term's documents get closer together."""
    n = len(bags)
    right = np.arange(n) >= n // 2
    n_left, n_right = n // 2, n - n // 2
    every = bags.counts(np.ones(n, bool))

    def cost(left: np.ndarray, of_right: np.ndarray) -> np.ndarray:
        left, of_right = np.maximum(left, 0), np.maximum(of_right, 0)
        return left * np.log2(n_left / (left + 1)) + of_right * np.log2(n_right / (of_right + 1))

    for _ in range(rounds):
        on_right = bags.counts(right)
        on_left = every - on_right
        now = cost(on_left, on_right)
        to_right, to_left = bags.sums(now - cost(on_left - 1, on_right + 1)), bags.sums(now - cost(on_left + 1, on_right - 1))
        stay, go = np.flatnonzero(~right), np.flatnonzero(right)
        stay, go = stay[np.argsort(-to_right[stay], kind="stable")], go[np.argsort(-to_left[go], kind="stable")]
        k = min(len(stay), len(go))
        gains = to_right[stay[:k]] + to_left[go[:k]]
        swaps = int(np.argmax(gains <= 1e-9)) if (gains <= 1e-9).any() else k
        if not swaps:
            break
        right[stay[:swaps]], right[go[:swaps]] = True, False
    return right


def bisected(bags: Bags, least: int) -> np.ndarray:
    """Documents in the order of recursive bisection down to sets of ``least``."""
    if len(bags) <= least:
        return np.arange(len(bags))
    right = halved(bags)
    sides = np.flatnonzero(~right), np.flatnonzero(right)
    return np.concatenate([side[bisected(bags.of(side), least)] for side in sides])


def learned(bags: Bags, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(weights of the features, threshold) of every halving, as a heap of nodes."""
    weights, limits = np.zeros(((1 << depth) - 1, FEATURES), np.float32), np.zeros((1 << depth) - 1)

    def learn(node: int, bags: Bags) -> None:
        if node >= len(limits) or len(bags) < 4:
            return
        right = halved(bags)
        on_right, on_left = bags.counts(right), bags.counts(~right)
        weights[node] = np.log2((on_right + 1) / (on_left + 1))
        scores = bags.sums(weights[node]) / np.maximum(1, np.diff(bags.starts))
        limits[node] = np.median(scores)
        for child, side in ((2 * node + 1, scores <= limits[node]), (2 * node + 2, scores > limits[node])):
            learn(child, bags.of(np.flatnonzero(side)))

    learn(0, bags)
    return weights, limits


def routed(features: np.ndarray, weights: np.ndarray, limits: np.ndarray) -> tuple[int, float]:
    """(leaf from left to right, score at the last halving)."""
    node, score = 0, 0.0
    while node < len(limits):
        score = float(weights[node][features].mean())  # the mean, or long documents would go one way
        node = 2 * node + 1 + (score > limits[node])
    return node - len(limits), score


def _sampled(texts: DataFrame, count: int) -> Bags:
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features_of(set(terms_of(t.as_buffer().to_pybytes()))).tobytes() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["features"])

    share = min(1.0, SAMPLE / max(1, count))
    picked = texts.select("text").sample(share, seed=11).mapInArrow(features, "features binary").limit(2 * SAMPLE)
    return Bags([np.frombuffer(r.features, np.uint16) for r in picked.collect()])


COUNTED = "key long, n long, terms string, times binary, features binary, leaf int, score double"


def counted(df: DataFrame, key: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Terms and their times of each document that has any, and its place in the
    learned order; written once to the shared folder."""
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("key"), text_or_empty(text_column).alias("text"))
    halvings = spark.sparkContext.broadcast(learned(_sampled(rows, rows.count())))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, limits = halvings.value
        for batch in batches:
            columns: list[list] = [[] for _ in range(7)]
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                terms = terms_of(text.as_buffer().to_pybytes())
                if not terms:
                    continue
                times: dict[bytes, int] = {}
                for t in terms:
                    times[t] = times.get(t, 0) + 1
                features = features_of(times)
                found = (k, len(terms), b" ".join(times), np.fromiter(times.values(), "<u4").tobytes(), features.tobytes(), *routed(features, weights, limits))
                for column, value in zip(columns, found, strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.float64())
            made = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*made[:2], made[2].cast(pa.string()), *made[3:]], names=["key", "n", "terms", "times", "features", "leaf", "score"])

    folder = new_folder(spark, "terms")
    rows.mapInArrow(count, COUNTED).withColumn("place", F.monotonically_increasing_id()).write.parquet(folder)
    return spark.read.parquet(folder)


def clusters_of(lengths: np.ndarray, most: int, postings: int) -> list[tuple[int, int]]:
    cuts, start, held = [], 0, 0
    for k, n in enumerate(lengths.tolist()):
        if k > start and (k - start == most or held + n > postings):
            cuts.append((start, k))
            start, held = k, 0
        held += n
    return [*cuts, (start, len(lengths))] if len(lengths) else []


INDEX = "keys array<long>, terms string, starts binary, places binary, impacts binary, maxima binary"


def _cluster(keys: list, terms: list[bytes], times: list[np.ndarray], ms: np.ndarray) -> dict:
    """An index row: postings by term, a term's places ascending."""
    number: dict[bytes, int] = {}
    ids, places = [], []
    for place, joined in enumerate(terms):
        mine = [number.setdefault(t, len(number)) for t in joined.split(b" ")]
        ids.append(np.array(mine, np.int64))
        places.append(np.full(len(mine), place, np.uint32))
    ids, places, tf = np.concatenate(ids), np.concatenate(places), np.concatenate(times).astype(np.int64)
    impacts = (1_000_000_000 * tf) // (1000 * tf + 8 * ms[places])
    order = np.argsort(ids, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(ids, minlength=len(number)))])
    return {
        "keys": keys, "terms": b" ".join(number).decode(), "starts": starts.astype("<u4").tobytes(), "places": places[order].astype("<u4").tobytes(),
        "impacts": impacts[order].astype("<u4").tobytes(), "maxima": np.maximum.reduceat(impacts[order], starts[:-1]).astype("<u4").tobytes(),
    }


@dataclass
class LexicalIndex:
    """Rows of clusters, and the number of documents that have a term."""

    rows: DataFrame
    documents: int


def _share(rows: DataFrame, partitions: int) -> Column:
    """The partition of a row, so that all have about as many bytes: leaves lie one
    after another, and a leaf's documents are dealt by hash over what it spans."""
    sizes = {r.leaf: r.bytes for r in rows.groupBy("leaf").agg(F.sum(F.octet_length("terms")).alias("bytes")).collect()}
    total, before, spans = max(1, sum(sizes.values())), 0, []
    for leaf, size in sorted(sizes.items()):
        spans += [F.lit(leaf), F.struct(F.lit(before * partitions / total).alias("first"), F.lit(size * partitions / total).alias("width"))]
        before += size
    if not spans:
        return F.lit(0)
    span = F.element_at(F.create_map(*spans), F.col("leaf"))
    return F.floor(span["first"] + span["width"] * (F.pmod(F.xxhash64("place"), F.lit(1 << 20)) / F.lit(1 << 20))).cast("int")


def build_index(df: DataFrame, key: str = "doc_id", text_column: str = "text", cluster: int = CLUSTER, partitions: int | None = None) -> LexicalIndex:
    """Reorders the documents and writes the index to the shared folder.

    Partitions are ranges of the learned order with about as many bytes each;
    documents of one leaf of it are dealt by hash, equal ones too. A task holds
    one partition.
    """
    spark = df.sparkSession
    rows = counted(df, key, text_column)
    said = rows.agg(F.count("*").alias("documents"), F.sum("n").alias("terms"), F.sum(F.octet_length("terms")).alias("bytes")).first()
    documents, total = said.documents, said.terms or 1
    partitions = partitions or parts_of(spark, said.bytes or 0, PART_BYTES)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        rows = pa.Table.from_batches(held)
        held.clear()
        order = bisected(Bags([np.frombuffer(f.as_py(), np.uint16) for f in rows.column("features")]), cluster)
        rows = rows.select(["key", "n", "terms", "times"]).take(pa.array(order))
        lengths = np.array([len(t.as_py()) // 4 for t in rows.column("times")])
        for start, end in clusters_of(lengths, cluster, CLUSTER_POSTINGS):
            part = rows.slice(start, end - start)
            ms = 100 - 90 + (90 * part.column("n").to_numpy().astype(np.int64) * documents) // total
            terms = part.column("terms").cast(pa.binary()).to_pylist()
            times = [np.frombuffer(t, "<u4") for t in part.column("times").to_pylist()]
            row = _cluster(part.column("key").to_pylist(), terms, times, ms)
            yield pa.RecordBatch.from_pylist([row], INDEX_SCHEMA)

    dealt = rows.withColumn("share", _share(rows, partitions)).select("share", "score", "key", "place", "n", "terms", "times", "features").repartitionById(partitions, "share").sortWithinPartitions("share", "score", "key", "place")
    folder = new_folder(spark, "lexical")
    dealt.mapInArrow(index, INDEX).write.parquet(folder)
    return LexicalIndex(spark.read.parquet(folder), documents)


INDEX_SCHEMA = pa.schema([("keys", pa.list_(pa.int64())), ("terms", pa.string()), *[(c, pa.binary()) for c in ("starts", "places", "impacts", "maxima")]])


class Items:
    """A block of items: their terms, numbered, and each item's term numbers."""

    def __init__(self, texts: list[str]):
        self.number: dict[str, int] = {}
        of_item = [sorted({self.number.setdefault(t.decode(), len(self.number)) for t in terms_of(text.encode())}) for text in texts]
        self.items = [k for k, terms in enumerate(of_item) if terms]
        self.starts = np.concatenate([[0], np.cumsum([len(of_item[k]) for k in self.items])]).astype(np.int64)
        self.terms = np.array([t for k in self.items for t in of_item[k]], np.int64)
        self.weights = np.zeros(len(self.number), np.int64)

    def matched(self, terms: str) -> tuple[list[int], list[int]]:
        """(place in the cluster's terms, number) of the terms that items have."""
        known = self.number
        pairs = [(k, known[t]) for k, t in enumerate(terms.split(" ")) if t in known]
        return [p[0] for p in pairs], [p[1] for p in pairs]


class Cluster:
    """Row ``k`` of a batch of the index seen by a block of items; postings stay in the batch."""

    def __init__(self, items: Items, batch: pa.RecordBatch, k: int):
        self.items, self.batch, self.k = items, batch, k
        places, numbers = items.matched(batch.column("terms")[k].as_py())
        self.place_of = np.full(len(items.number), -1, np.int32)
        self.place_of[numbers] = places
        greatest = np.zeros(len(items.number), np.int64)
        greatest[numbers] = self.ints("maxima")[places]
        self.bounds = np.add.reduceat((items.weights * greatest)[items.terms], items.starts[:-1])

    def ints(self, column: str) -> np.ndarray:
        return np.frombuffer(self.batch.column(column)[self.k].as_buffer(), "<u4")

    def keys(self) -> list:
        return self.batch.column("keys")[self.k].as_py()

    def scores(self, item: int) -> np.ndarray:
        """Scores of the cluster's documents for the block's item of that place."""
        starts, places, impacts = self.ints("starts"), self.ints("places"), self.ints("impacts")
        scores = np.zeros(len(self.batch.column("keys")[self.k]), np.int64)
        for t in self.items.terms[self.items.starts[item] : self.items.starts[item + 1]]:
            p = self.place_of[t]
            if p >= 0:
                of_term = slice(starts[p], starts[p + 1])
                scores[places[of_term]] += self.items.weights[t] * impacts[of_term].astype(np.int64)
        return scores


class Best:
    """The best (score, key) of an item so far; nulls are the smallest keys."""

    def __init__(self, most: int, least: int = 1):
        self.most, self.least, self.found = most, least, []

    def add(self, scores: np.ndarray, keys: list) -> None:
        good = np.flatnonzero(scores >= self.least)
        if len(good):
            self.found += [(-int(scores[k]), keys[k] is not None, keys[k] or 0) for k in good.tolist()]
            self.found.sort()
            del self.found[self.most :]
            if len(self.found) == self.most:
                self.least = max(self.least, -self.found[-1][0])


FOUND = pa.schema([("item", pa.int32()), ("key", pa.int64()), ("score", pa.int64())])


def _visit(items, least, most: int, first_only: bool, visits=None) -> callable:
    """Scans the clusters of a task, a batch of rows at a time. ``least`` is the
    score at which each item starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Items = items.value
        best = [Best(most, max(1, s)) for s in least]
        visited = total = 0
        for batch in batches:
            clusters = [Cluster(block, batch, k) for k in range(len(batch))]
            if not clusters:
                continue
            bounds = np.stack([c.bounds for c in clusters])
            if first_only:
                for item, k in enumerate(bounds.argmax(0).tolist()):
                    best[item].add(clusters[k].scores(item), clusters[k].keys())
                continue
            order = np.argsort(-bounds, 0, kind="stable")
            for item in range(bounds.shape[1]):
                total += int((bounds[:, item] > 0).sum())
                for k in order[:, item].tolist():
                    if bounds[k, item] < best[item].least:
                        break
                    visited += 1
                    best[item].add(clusters[k].scores(item), clusters[k].keys())
        if visits is not None:
            visits[0].add(visited)
            visits[1].add(total)
        rows = [{"item": block.items[i], "key": key if known else None, "score": -score} for i, b in enumerate(best) for score, known, key in b.found]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, FOUND)

    return run


def _document_frequencies(index: LexicalIndex, items) -> dict[int, int]:
    """Documents of each term of a block; one row a term comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Items = items.value
        counts = np.zeros(len(block.number), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                places, numbers = block.matched(row["terms"])
                counts[numbers] += np.diff(np.frombuffer(row["starts"], "<u4").astype(np.int64))[places]
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(counts[there])], names=["term", "documents"])

    counts = index.rows.select("terms", "starts").mapInArrow(run, "term long, documents long").groupBy("term").agg(F.sum("documents").alias("documents"))
    return {r.term: r.documents for r in counts.collect()}


def _search_block(index: LexicalIndex, texts: list[str], most: int, visits=None) -> DataFrame | None:
    """(item: place in the block, key, score): the best of each task of the index."""
    spark, block = index.rows.sparkSession, Items(texts)
    if not block.items:
        return None
    share = spark.sparkContext.broadcast
    for term, documents in _document_frequencies(index, share(block)).items():
        block.weights[term] = math.floor(1000 * math.log((2 * index.documents + 2) / (2 * documents + 1)))
    items = share(block)
    seeds = index.rows.mapInArrow(_visit(items, [1] * len(block.items), most, True), "item int, key long, score long")
    ranked = seeds.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(F.desc("score")))).where(F.col("rank") == most)
    start = {r.item: r.score for r in ranked.select("item", "score").collect()}
    return index.rows.mapInArrow(_visit(items, [start.get(k, 1) for k in block.items], most, False, visits), "item int, key long, score long")


def search(index: LexicalIndex, items: DataFrame, most: int = 10, item: str = "item_id", text_column: str = "text", key: str = "doc_id", block: int = BLOCK, visits=None) -> DataFrame:
    """(item, rank, key, score): the best documents of each item.

    ``visits`` are two accumulators: pairs of item and cluster visited, and those
    with a bound above zero.
    """
    asked = iter(items.select(F.col(item).cast("long").alias("item"), text_or_empty(text_column).alias("text")).distinct().toLocalIterator())
    spark, found = index.rows.sparkSession, []
    while held := list(islice(asked, block)):
        part = _search_block(index, [r.text for r in held], most, visits)
        if part is not None:
            ids = spark.createDataFrame([(k, r.item) for k, r in enumerate(held)], "item int, id long")
            first = len(found)
            found.append(part.join(F.broadcast(ids), "item").select(F.lit(first).alias("block"), "item", "id", "key", "score"))
    if not found:
        return spark.createDataFrame([], f"`{item}` long, rank int, `{key}` long, score long")
    rank = F.row_number().over(W.partitionBy("block", "item").orderBy(F.desc("score"), F.asc_nulls_first("key")))
    return reduce(DataFrame.unionByName, found).withColumn("rank", rank).where(F.col("rank") <= most).select(F.col("id").alias(item), "rank", F.col("key").alias(key), "score")


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents),
f AS (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS term FROM d),
postings AS (SELECT r, doc_id, n, term, count(*) AS tf FROM f GROUP BY ALL),
sizes AS (SELECT count(*) FILTER (WHERE len(ts) > 0) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_terms FROM d),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, sizes GROUP BY term, n_docs),
asked AS (SELECT row_number() OVER () AS q, item_id, text FROM (SELECT DISTINCT item_id, coalesce(text, '') AS text FROM benchmark)),
wanted AS (SELECT DISTINCT q, item_id, unnest({_TERMS}) AS term FROM asked),
scored AS (
  SELECT q, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM wanted JOIN postings USING (term) JOIN weights USING (term), sizes GROUP BY q, item_id, r, doc_id),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
