"""Operator 9: approximate nearest neighbours in balanced posting lists.

Vectors are dealt to lists around centroids. The centroids come from a bounded
sample that is halved again and again at the median between two means, so the
lists are balanced. A vector near a boundary is replicated to a second list.
Centroids are searched by a graph in the task's memory: each is linked to its
nearest ones and to a few far ones, and the search walks from near to nearer. A
query reads every list whose distance is within a ratio of the nearest list's.
The ratio isn't guessed: it is the least that finds ``target`` of the true
neighbours of the sample, measured by brute force there.

The largest inner product is the least distance after every vector gets a
further component that brings it to the length of the longest.

Equal vectors are indexed once, with the smallest keys that a result can need (a
query's k nearest among equal vectors are those of smallest key), so a vector
that a third of the rows share is one entry.

Lists lie in the order in which the sample was halved, so neighbours in space are
neighbours in number, and a run of them makes a shard of about ``SHARD_VALUES``
components. A query travels once to each shard in which it reads lists, with
their numbers, not once to each list, and a shard gives it back at most k rows.
Shards with more vectors or queries than a tile holds are dealt out in tiles.

There are about as many lists as a list has vectors, and more once lists have
``LIST`` vectors, up to an eighth of the sample. The sample has about ``SAMPLE``
vectors (fewer if they are long); beyond that lists grow instead. Every row is indexed and every query is answered.

Vectors are compared with those of their own length. The ``MOST_INDEXES`` most
frequent lengths have an index each; vectors of other lengths are compared with
all of their length, in tiles.

Defined results: rows with a null key take no part; nor do vectors that are null,
zero or hold a null or non-finite component; repeated rows count once; different
vectors under one key each take part; no row with the query's own key is its
candidate; ties go to the smaller key; fewer candidates than k are all returned,
none gives no row; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from signalmill.llm.common import materialize, table, tune

K = 20
#: Vectors in a list, on average: the square root of their number, and so many at
#: most. Bounds of the sample, in vectors and in components.
LIST, SAMPLE, SAMPLE_VALUES = 1024, 32_768, 1 << 22
#: Lengths of vectors that get an index, and components of a shard of lists.
MOST_INDEXES, SHARD_VALUES = 16, 1 << 20
#: Lists that hold a vector, and how much farther than the nearest they may be.
REPLICAS, BOUNDARY = 2, 1.02
#: Links of a centroid to near and to far ones, and nodes a search keeps open.
NEAR, FAR, OPEN = 16, 8, 8
#: Share of the sample's true neighbours that the ratio must find.
TARGET, PROBES = 0.98, 256
#: Candidates and queries of a tile.
TILE_ROWS, TILE_QUERIES = 32_768, 4096


class CentroidGraph:
    """Centroids, the graph over them and the ratio that selects lists."""

    def __init__(self, sample: np.ndarray, lists: int, longest: float, seed: int = 3):
        self.longest, self.ratio = longest, 1.0
        points = self.lifted(sample)
        self.centroids = self._halved(points, lists, np.random.default_rng(seed))
        n = len(self.centroids)
        apart = self._apart(self.centroids)
        near = np.argsort(apart, 1, kind="stable")[:, : NEAR + 1]
        draw = np.random.default_rng(seed + 1)
        self.links = np.concatenate([near, draw.integers(0, n, (n, FAR)), (np.arange(n)[:, None] + 1) % n], 1)  # the last links all into one ring
        self.entries = np.unique(np.linspace(0, n - 1, min(n, OPEN)).astype(int))

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0, self.longest**2 - (vectors**2).sum(1)))
        return np.concatenate([vectors, rest[:, None]], 1)

    def aimed(self, queries: np.ndarray) -> np.ndarray:
        """Queries of the common length: a query's length doesn't change its ranking."""
        scaled = queries * (self.longest / np.sqrt((queries**2).sum(1)))[:, None]
        return np.concatenate([scaled, np.zeros((len(queries), 1))], 1)

    def _apart(self, points: np.ndarray) -> np.ndarray:
        c = self.centroids
        return np.sqrt(np.maximum(0, (points**2).sum(1)[:, None] + (c**2).sum(1)[None, :] - 2 * points @ c.T))

    @staticmethod
    def _halved(points: np.ndarray, lists: int, draw: np.random.Generator) -> np.ndarray:
        groups = [np.arange(len(points))]
        while len(groups) < lists and len(groups) * 4 <= len(points):
            halves = []
            for group in groups:
                own = points[group]
                a, b = own[draw.choice(len(own), 2, replace=False)]
                for _ in range(4):
                    order = np.argsort(own @ (b - a), kind="stable")
                    low, high = order[: len(own) // 2], order[len(own) // 2 :]
                    a, b = own[low].mean(0), own[high].mean(0)
                halves += [group[low], group[high]]
            groups = halves
        return np.stack([points[g].mean(0) for g in groups])

    def search(self, points: np.ndarray, ratio: float) -> np.ndarray:
        """Distances (points, lists) to the lists found within ``ratio`` of the
        nearest one; infinite for those not visited. The walk opens every node
        within the ratio, and the OPEN nearest ones to get there."""
        n, lists = len(points), len(self.centroids)
        far = np.full((n, lists), np.inf)
        opened = np.zeros((n, lists), bool)
        far[:, self.entries] = self._distance(points, np.repeat(np.arange(n), len(self.entries)), np.tile(self.entries, n)).reshape(n, -1)
        while True:
            kth = np.partition(far, min(OPEN, lists) - 1, 1)[:, min(OPEN, lists) - 1]
            near = far <= np.maximum(ratio * far.min(1), np.where(np.isfinite(kth), kth, far.min(1)))[:, None]
            at, node = np.nonzero(near & np.isfinite(far) & ~opened)
            if not len(at):
                return far
            opened[at, node] = True
            reached = np.unique((at[:, None] * lists + self.links[node]).ravel())
            reached = reached[np.isinf(far.ravel()[reached])]
            at, node = np.divmod(reached, lists)
            far[at, node] = self._distance(points, at, node)

    def _distance(self, points: np.ndarray, at: np.ndarray, node: np.ndarray) -> np.ndarray:
        out = np.empty(len(at))
        for k in range(0, len(at), 65_536):  # bounds the memory of the gathered rows
            gap = points[at[k : k + 65_536]] - self.centroids[node[k : k + 65_536]]
            out[k : k + 65_536] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
        return out

    def homes(self, vectors: np.ndarray, replicas: int = REPLICAS) -> list[np.ndarray]:
        """Lists of each vector: the nearest, and those hardly farther."""
        far = self.search(self.lifted(vectors), BOUNDARY)
        order = np.argsort(far, 1, kind="stable")[:, :replicas]
        near = np.take_along_axis(far, order, 1)
        return [nodes[kept] for nodes, kept in zip(order, near <= BOUNDARY * near[:, :1], strict=True)]

    def selected(self, queries: np.ndarray) -> list[np.ndarray]:
        """Lists that each query reads."""
        far = self.search(self.aimed(queries), self.ratio)
        keep = far <= self.ratio * far.min(1)[:, None]
        return [np.flatnonzero(row) for row in keep]

    def calibrate(self, sample: np.ndarray, k: int, target: float, probes: int = PROBES, seed: int = 9) -> CentroidGraph:
        """Sets the ratio by brute force within the sample."""
        if len(self.centroids) < 2:
            return self
        home = np.full((len(sample), REPLICAS), -1)
        for start in range(0, len(sample), 2048):
            for i, own in enumerate(self.homes(sample[start : start + 2048]), start):
                home[i, : len(own)] = own
        asked = np.random.default_rng(seed).choice(len(sample), min(probes, len(sample)), replace=False)
        needed = []
        far = self._apart(self.aimed(sample[asked]))
        scores = sample[asked] @ sample.T
        scores[np.arange(len(asked)), asked] = -np.inf
        for row, score in zip(far, scores, strict=True):
            best = np.argpartition(-score, min(k, len(score) - 1))[:k]
            own = home[best]
            needed.append(np.where(own >= 0, row[own], np.inf).min(1) / row.min())
        self.ratio = float(np.quantile(np.concatenate(needed), target)) + 1e-9
        return self


def _usable(vector: Column) -> Column:
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return whole & F.exists(vector, lambda x: x != 0)


def distinct_vectors(df: DataFrame, key: str, vector_column: str, k: int) -> DataFrame:
    """(vector, size, keys) of each distinct vector with its k + 1 smallest keys,
    written once. Repeated rows go first, so that they take no places; keys beyond
    those are cut before the next shuffle, where Spark limits the rank by group."""
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(vector_column).cast("array<double>").alias("vector")).where("key is not null and vector is not null")
    rows = rows.where(_usable(F.col("vector"))).dropDuplicates(["key", "vector"])
    rank = F.row_number().over(W.partitionBy("vector").orderBy("key"))
    few = rows.withColumn("rank", rank).where(F.col("rank") <= k + 1)
    return materialize(few.groupBy("vector").agg(F.array_sort(F.collect_list("key")).alias("keys")).select("vector", F.size("vector").alias("size"), "keys"))


def fit(vectors: DataFrame, size: int, count: int, longest: float, k: int = K, target: float = TARGET, sample: int = SAMPLE) -> CentroidGraph:
    """An index for ``count`` distinct vectors (vector) of one length, from a
    sample taken by their hash."""
    wanted = min(sample, SAMPLE_VALUES // size)
    part = F.pmod(F.xxhash64("vector"), F.lit(1 << 30)) < int(min(1.0, wanted / count) * (1 << 30))
    # about `wanted` vectors, 32 MB at most, reach the driver
    drawn = vectors.where((F.col("size") == size) & part).select("vector").toArrow().column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
    chosen = np.unique(drawn, axis=0) if len(drawn) else np.array([vectors.where(F.col("size") == size).first()["vector"]])
    lists = 1 << max(0, int(np.ceil(np.log2(max(1.0, count / min(LIST, np.sqrt(count)))))))
    return CentroidGraph(chosen, min(lists, max(1, len(chosen) // 8)), float(longest) * (1 + 1e-12)).calibrate(chosen, k, target)


def fit_each(vectors: DataFrame, k: int = K, target: float = TARGET, sample: int = SAMPLE) -> tuple[dict[int, CentroidGraph], dict[int, int]]:
    """An index for each of the most frequent lengths, and lists of their shards."""
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    sizes = vectors.groupBy("size").agg(F.count("*").alias("n"), F.max(length).alias("longest")).orderBy(F.desc("n"), "size").limit(MOST_INDEXES).collect()
    indexes = {r["size"]: fit(vectors, r["size"], r["n"], r["longest"], k, target, sample) for r in sizes}
    shards = {r["size"]: max(1, int(SHARD_VALUES * len(indexes[r["size"]].centroids) // (r["n"] * r["size"]))) for r in sizes}
    return indexes, shards


def _dealt(rows: DataFrame, indexes: dict[int, CentroidGraph], shards: dict[int, int], asks: bool, columns: str) -> DataFrame:
    """The rows with their lists, once for each shard with a list that holds or,
    with ``asks``, interests them. Lengths without an index have one list."""
    names = [c.split()[0] for c in columns.split(", ")]
    none = pa.array([], pa.int32())

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes).tolist():
                own = batch.take(pa.array(np.flatnonzero(sizes == size)))
                for start in range(0, own.num_rows, 256):
                    some = own.slice(start, 256)
                    at, shard, lists = np.arange(some.num_rows), np.zeros(some.num_rows, np.int32), [np.zeros(1, np.int32)] * some.num_rows
                    if size in indexes:
                        vectors = some.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(some.num_rows, -1)
                        found = indexes[size].selected(vectors) if asks else [np.sort(x) for x in indexes[size].homes(vectors)]
                        at, shard, lists = [], [], []
                        for i, own_lists in enumerate(found):
                            there, first = np.unique(own_lists // shards[size], return_index=True)
                            at += [i] * len(there)
                            shard += there.tolist()
                            lists += np.split(own_lists, first[1:])
                    out = some.take(pa.array(at, pa.int64()))
                    offsets = pa.array(np.cumsum([0, *map(len, lists)]), pa.int32())
                    listed = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(lists), pa.int32()) if len(lists) else none)
                    yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), listed, *(out.column(n) for n in ("size", *names))], names=["shard", "lists", "size", *names])

    return rows.select("size", *names).mapInArrow(deal, f"shard int, lists array<int>, size int, {columns}")


def _nearest(k: int):
    """Top k of a tile for each of its queries: every list in turn, the queries
    that read it against the vectors it holds."""

    def of_tile(_, rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asked):
            return pd.DataFrame({"query": [], "scores": [], "keys": []})
        x, q = np.stack(rows["vector"].to_numpy()), np.stack(asked["vector"].to_numpy())
        own, counts = asked["query"].to_numpy(np.int64), rows["keys"].map(len).to_numpy()
        flat, starts = np.concatenate(rows["keys"].to_numpy()), np.cumsum(counts) - counts
        margin = 1e-12 * np.sqrt((x**2).sum(1).max() * (q**2).sum(1))
        held, read = _by_list(rows["lists"]), _by_list(asked["lists"])
        # the k + 1 best scores of each query so far: what is farther can't matter
        best, most = np.full((len(q), k + 1), -np.inf), k + 1
        ats, nears = [], []
        for number, asking in read.items():
            there = held.get(number)
            if there is None:
                continue
            for start in range(0, len(asking), 512):  # bounds the scores held at once
                some = asking[start : start + 512]
                rough = q[some] @ x[there].T
                both = np.concatenate([best[some], rough], 1)
                cut = both.shape[1] - most
                best[some] = np.partition(both, cut, 1)[:, cut:]
                at, near = np.nonzero(rough >= (best[some].min(1) - margin[some])[:, None])
                ats.append(some[at])
                nears.append(there[near])
        if not ats:
            return pd.DataFrame({"query": [], "scores": [], "keys": []})
        pairs = np.unique(np.concatenate(ats) * len(x) + np.concatenate(nears))  # replicas meet here
        at, near = np.divmod(pairs, len(x))
        # the same sum for a vector wherever it stands
        exact = np.concatenate([(x[near[i : i + 16_384]] * q[at[i : i + 16_384]]).sum(1) for i in range(0, len(at), 16_384)])
        n = counts[near]
        place = np.repeat(starts[near] - np.cumsum(n) + n, n) + np.arange(n.sum())
        at, exact, key = np.repeat(at, n), np.repeat(exact, n), flat[place]
        other = key != own[at]
        at, exact, key = at[other], exact[other], key[other]
        order = np.lexsort((key, -exact, at))
        at, exact, key = at[order], exact[order], key[order]
        first = np.searchsorted(at, np.arange(len(q)))
        kept = np.arange(len(at)) - first[at] < k
        at, exact, key = at[kept], exact[kept], key[kept]
        cuts = np.searchsorted(at, np.arange(1, len(q)))
        return pd.DataFrame({"query": own, "scores": np.split(exact, cuts), "keys": np.split(key, cuts)})

    return of_tile


def _by_list(lists: pd.Series) -> dict[int, np.ndarray]:
    """Rows of each list."""
    flat = np.concatenate(lists.to_numpy())
    row = np.repeat(np.arange(len(lists)), lists.map(len).to_numpy())
    order = np.argsort(flat, kind="stable")
    numbers, first = np.unique(flat[order], return_index=True)
    return dict(zip(numbers.tolist(), np.split(row[order], first[1:]), strict=True))


def nearest(df: DataFrame, queries: Column, key: str = "vec_id", vector_column: str = "embedding", k: int = K, target: float = TARGET, sample: int = SAMPLE, tile_rows: int = TILE_ROWS, tile_queries: int = TILE_QUERIES) -> DataFrame:
    """(query_id, rank, key, score) of the k nearest rows found for each row that
    the condition ``queries`` (on ``key``) selects."""
    vectors = distinct_vectors(df, key, vector_column, k)
    indexes, shards = fit_each(vectors, k, target, sample)
    vector = F.col(vector_column).cast("array<double>")
    asked = df.where(queries).select(F.col(key).cast("long").alias("query"), vector.alias("vector"), F.size(vector).alias("size")).where(F.col("query").isNotNull() & F.col("vector").isNotNull() & _usable(F.col("vector"))).dropDuplicates(["query", "vector"])
    shown = materialize(_dealt(vectors, indexes, shards, False, "vector array<double>, keys array<bigint>"))
    asking = materialize(_dealt(asked, indexes, shards, True, "vector array<double>, query bigint"))
    # A row for each shard; Spark broadcasts it or not by its size.
    count = lambda rows, name, most: rows.groupBy("size", "shard").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    where = ["size", "shard"]
    tiles = materialize(count(shown, "down", tile_rows).join(count(asking, "across", tile_queries), where))
    part = lambda of, n: F.pmod(F.xxhash64(of), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = shown.join(tiles, where).select(*where, part("vector", "down").alias("row"), every("across").alias("col"), "vector", "keys", "lists")
    right = asking.join(tiles, where).select(*where, every("down").alias("row"), part("query", "across").alias("col"), "vector", "query", "lists")
    tile = [*where, "row", "col"]
    met = left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInPandas(_nearest(k), "query long, scores array<double>, keys array<bigint>")
    # A query has k entries from each of its tiles at most; equal entries come from replicas.
    pairs = F.transform(F.arrays_zip("scores", "keys"), lambda p: F.struct((-p["scores"]).alias("far"), p["keys"].alias("key")))
    ordered = met.groupBy("query").agg(F.array_sort(F.flatten(F.collect_list(pairs))).alias("all"))
    once = F.filter("all", lambda p, i: (i == 0) | (p != F.get("all", i - 1)))
    best = ordered.select("query", F.slice(once, 1, k).alias("best"))
    return best.select("query", F.posexplode("best")).select(F.col("query").alias("query_id"), (F.col("pos") + 1).alias("rank"), F.col("col.key").alias(key), (-F.col("col.far")).alias("score"))


def op9_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
