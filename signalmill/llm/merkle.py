"""Operator 13: Merkle manifest of a dataset.

A row is a leaf, the digest of its fields. Each group (source) has a tree over its
leaves in key order, every three neighbours under one node (the last run may be
shorter); the groups' roots, in order of the groups, have a tree of the same kind.
A proof lists a leaf's siblings level by level up to the root, so that anyone who
holds a row, its proof and the root can tell whether the row was altered.

Leaves are range-partitioned and sorted by (group, key). One row for each
partition (its first and last group and their counts) gives every group's offset
in a partition and its size. A task then builds the complete, aligned subtrees of
its own leaves. What can't be completed there, the ragged nodes at a partition's
ends, is a few nodes a level; they are shuffled by the coordinate (group, level,
index) of a common ancestor ``STEP`` levels up, at most 3 ** STEP nodes to a
coordinate, round after round until each group has its root.

Defined results: nulls are framed as ``-``; rows of a null group form the group
that comes first, rows of null key come first in their group; rows of equal key
are ordered by leaf, and each is a leaf; an empty table gives no rows; texts are
read whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmill.llm.common import materialize, parts_of, table

ARITY = 3
#: Levels that one round of the ragged nodes climbs.
STEP = 4
#: Leaves of a partition.
PART_ROWS = 200_000
#: The ends of trees go to all executors up to so many bytes; beyond, rows are shuffled to them.
BROADCAST_BYTES = 32 << 20
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "array<struct<left: string, right: string>>"


def digest(joined: str) -> str:
    return hashlib.sha256(joined.encode()).hexdigest()


def framed(value: Column) -> Column:
    """A value with its length, so that no two rows of fields read alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    return F.sha2(F.concat(*map(framed, values)), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(proof, leaf, lambda node, run: F.sha2(F.concat(run["left"], node, run["right"]), 256))


def height(leaves: int) -> int:
    """Levels above the leaves."""
    levels = 0
    while leaves > 1:
        leaves, levels = -(-leaves // ARITY), levels + 1
    return levels


def aligned(nodes: list[str], start: int, count: int) -> list[tuple[int, list[str]]]:
    """Levels of the complete subtrees over leaves ``start`` onwards of a group of
    ``count``: (index of the first node, nodes) from the leaves up."""
    levels = [(start, nodes)]
    while count > 1:
        low, nodes = levels[-1]
        high = low + len(nodes)
        up, end = -(-low // ARITY), -(-high // ARITY) if high == count else high // ARITY
        if up >= end:
            break
        levels.append((up, [digest("".join(nodes[k : k + ARITY])) for k in range(up * ARITY - low, end * ARITY - low, ARITY)]))
        count = -(-count // ARITY)
    return levels


def tops_of(levels: list[tuple[int, list[str]]]) -> list[tuple[int, int, str]]:
    """(level, index, node) of the nodes whose parent isn't there, in order of their leaves."""
    before, after = [], []  # after: a list for each level
    for level, (low, nodes) in enumerate(levels):
        up, above = levels[level + 1] if level + 1 < len(levels) else (None, [])
        after.append([])
        for k, node in enumerate(nodes):
            parent = (low + k) // ARITY
            if up is None or parent < up:
                before.append((level, low + k, node))
            elif parent >= up + len(above):
                after[-1].append((level, low + k, node))
    return before + [top for tops in after[::-1] for top in tops]


def siblings(nodes: pa.Array, low: int, index: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """What stands left and right of each node of the level in its run."""
    first = index // ARITY * ARITY

    def joined(others: list[np.ndarray], there: list[np.ndarray]) -> pa.Array:
        picked = [pc.fill_null(nodes.take(pa.array(np.where(t, k - low, 0), mask=~t)), "") for k, t in zip(others, there, strict=True)]
        return pc.binary_join_element_wise(*picked, "")

    left, right = [first + k for k in range(ARITY - 1)], [first + k for k in range(1, ARITY)]
    return joined(left, [k < index for k in left]), joined(right, [(k > index) & (k < low + len(nodes)) for k in right])


class Places:
    """Offsets and sizes of the groups of each partition, from one row for each partition."""

    def __init__(self, ends: Sequence):
        """ends: rows (part, first group, its count, last group, its count)."""
        runs: dict[str, int] = defaultdict(int)
        self.before: dict[int, int] = {}
        self.of_part = {r.part: r for r in ends}
        for r in sorted(ends, key=lambda r: r.part):
            self.before[r.part] = runs[r.first]
            runs[r.first] += r.n_first
            if r.last != r.first:
                runs[r.last] += r.n_last
        self.size = dict(runs)

    def of(self, part: int, group: str, count: int) -> tuple[int, int]:
        """(index of the group's first leaf in the partition, leaves of the group)."""
        ends = self.of_part[part]
        if group not in (ends.first, ends.last):
            return 0, count
        return (self.before[part] if group == ends.first else 0), self.size[group]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, pa.Table]]:
    """(partition, group, rows) of a sorted partition, holding a group at a time."""
    held: list[pa.RecordBatch] = []
    mark = None
    for batch in batches:
        parts, groups = batch.column("part").to_pylist(), batch.column("group").to_pylist()
        start = 0
        for k in range(len(groups) + 1):
            if k == len(groups) or (parts[k], groups[k]) != mark:
                if k > start:
                    held.append(batch.slice(start, k - start))
                if k < len(groups):
                    if held:
                        yield *mark, pa.Table.from_batches(held)
                    mark, held, start = (parts[k], groups[k]), [], k
    if held:
        yield *mark, pa.Table.from_batches(held)


def _local_tops(places) -> callable:
    schema = pa.schema([("part", pa.int32()), ("top", pa.int32()), ("group", pa.string()), ("leaves", pa.int64()), ("level", pa.int32()), ("index", pa.int64()), ("node", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark, number = None, 0
        for part, group, rows in _runs(batches):
            number = number if part == mark else 0
            mark = part
            start, count = places.value.of(part, group, len(rows))
            found = tops_of(aligned(rows.column("leaf").to_pylist(), start, count))
            yield pa.RecordBatch.from_pylist([{"part": part, "top": number + k, "group": group, "leaves": count, "level": level, "index": index, "node": node} for k, (level, index, node) in enumerate(found)], schema)
            number += len(found)

    return run


def _local_proofs(places, names: list[str]) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark, number = None, 0
        for part, group, rows in _runs(batches):
            number = number if part == mark else 0
            mark = part
            n = len(rows)
            start, count = places.value.of(part, group, n)
            levels = aligned(rows.column("leaf").to_pylist(), start, count)
            tops = tops_of(levels)
            first = np.array([max(index * ARITY**level, start) for level, index, _ in tops])
            top = np.searchsorted(first, np.arange(start, start + n), "right") - 1
            deep = np.array([level for level, _, _ in tops])[top]
            lefts, rights, of_row, of_level = [], [], [], []
            for level, (low, nodes) in enumerate(levels[:-1]):
                rise = np.flatnonzero(deep > level)
                left, right = siblings(pa.array(nodes, pa.string()), low, (rise + start) // ARITY**level)
                lefts.append(left)
                rights.append(right)
                of_row.append(rise)
                of_level.append(np.full(len(rise), level))
            offsets = pa.array(np.concatenate([[0], np.cumsum(deep)]).astype(np.int32))
            order = pa.array(np.lexsort((np.concatenate(of_level), np.concatenate(of_row)))) if lefts else pa.array([], pa.int64())
            pieces = [pa.concat_arrays([a.cast(pa.string()) for a in side]).take(order) if side else pa.array([], pa.string()) for side in (lefts, rights)]
            proof = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(pieces, ["left", "right"]))
            whole = [rows.column(name).combine_chunks() for name in names] + [pa.array(top + number, pa.int32()), proof]
            out = pa.RecordBatch.from_arrays(whole, names=[*names, "top", "proof"])
            for k in range(0, n, 10_000):
                yield out.slice(k, 10_000)
            number += len(tops)

    return run


def _climb(target: int) -> callable:
    """A round: nodes of one coordinate, in neighbouring rows, up to its node."""
    schema = pa.schema([("group", pa.string()), ("leaves", pa.int64()), ("level", pa.int32()), ("index", pa.int64()), ("to_level", pa.int32()), ("to_index", pa.int64()), ("node", pa.string()), ("path", pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])))])

    def coordinate(rows: list[dict]) -> list[dict]:
        goal = rows[0]["goal"]
        at: dict[int, dict[int, str]] = defaultdict(dict)
        for r in rows:
            at[r["level"]][r["index"]] = r["node"]
        out = []
        for level in range(min(at), goal):
            for index in sorted(at[level]):
                parent = index // ARITY
                if parent not in at[level + 1]:
                    at[level + 1][parent] = digest("".join(at[level][k] for k in range(parent * ARITY, parent * ARITY + ARITY) if k in at[level]))
        for r in rows:
            path, index = [], r["index"]
            for level in range(r["level"], goal):
                others = [(k, at[level][k]) for k in range(index // ARITY * ARITY, index // ARITY * ARITY + ARITY) if k != index and k in at[level]]
                path.append({"left": "".join(v for k, v in others if k < index), "right": "".join(v for k, v in others if k > index)})
                index //= ARITY
            out.append({k: r[k] for k in ("group", "leaves", "level", "index")} | {"to_level": goal, "to_index": index, "node": at[goal][index], "path": path})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if held and (held[0]["group"], held[0]["goal_index"]) != (r["group"], r["goal_index"]):
                    done += coordinate(held)
                    held = []
                held.append(r)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
        if held:
            yield pa.RecordBatch.from_pylist(coordinate(held), schema)

    return run


CLIMBED = f"group string, leaves long, level int, index long, to_level int, to_index long, node string, path {PROOF}"


def forest(leaves: DataFrame, order: Sequence[str], partitions: int | None = None, step: int = STEP) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Trees over ``leaves`` (group: string without nulls; leaf; order columns; others).

    Returns the rows with ``part``, ``top`` and the ``proof`` up to their subtree's
    top; (part, top, group, proof) from each top to its group's root; and
    (group, subroot).
    """
    spark = leaves.sparkSession
    names = leaves.columns
    rows = materialize(leaves.withColumn("_place", F.monotonically_increasing_id()))
    partitions = partitions or parts_of(spark, rows.count(), PART_ROWS, PART_ROWS // 20)
    keys = ["group", *order, "leaf", "_place"]  # the place spreads equal rows
    dealt = materialize(rows.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys).drop("_place").withColumn("part", F.spark_partition_id()))
    counts = dealt.groupBy("part", "group").agg(F.count("*").alias("n"))
    ends = counts.groupBy("part").agg(F.min(F.struct("group", "n")).alias("a"), F.max(F.struct("group", "n")).alias("b"))
    places = spark.sparkContext.broadcast(Places(ends.select("part", F.col("a.group").alias("first"), F.col("a.n").alias("n_first"), F.col("b.group").alias("last"), F.col("b.n").alias("n_last")).collect()))
    proven = dealt.mapInArrow(_local_proofs(places, [*names, "part"]), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields) + f", top int, proof {PROOF}")
    tops = materialize(dealt.mapInArrow(_local_tops(places), "part int, top int, group string, leaves long, level int, index long, node string"))
    tallest = height(tops.agg(F.max("leaves")).first()[0] or 0)
    tree_height = F.lit(0)
    for k in range(tallest):
        tree_height = tree_height + (F.col("leaves") > F.lit(ARITY**k)).cast("int")
    alive = tops.select("group", "leaves", "level", "index", "node")
    paths = tops.select("part", "top", "group", "level", "index", F.expr(f"CAST(array() AS {PROOF})").alias("proof"))
    for target in range(step, tallest + step, step):
        goal = F.least(F.lit(target), tree_height)
        waiting = alive.withColumn("goal", goal).where("level < goal")
        scale = F.element_at(F.array(*[F.lit(ARITY**k) for k in range(target + 1)]), F.col("goal") - F.col("level") + 1)
        waiting = waiting.withColumn("_scale", scale.cast("long")).withColumn("goal_index", F.expr("index div _scale")).drop("_scale")
        climbed = materialize(waiting.repartition("group", "goal_index").sortWithinPartitions("group", "goal_index").mapInArrow(_climb(target), CLIMBED))
        alive = alive.where(F.col("level") >= F.least(F.lit(target), tree_height)).unionByName(climbed.select("group", "leaves", F.col("to_level").alias("level"), F.col("to_index").alias("index"), "node").distinct())
        steps = climbed.select("group", "level", "index", "to_level", "to_index", "path")
        paths = paths.join(steps, ["group", "level", "index"], "left").select(
            "part", "top", "group", F.coalesce("to_level", "level").alias("level"), F.coalesce("to_index", "index").alias("index"), F.when(F.col("path").isNull(), F.col("proof")).otherwise(F.concat("proof", "path")).alias("proof")
        )
    return proven, paths.select("part", "top", "group", "proof"), alive.select("group", F.col("node").alias("subroot"))


def manifest(leaves: DataFrame, group: str, order: Sequence[str], partitions: int | None = None, step: int = STEP) -> DataFrame:
    """Adds ``proof`` (a level's left and right siblings, up to the root), ``subroot``
    and ``root`` to rows that have a ``leaf``, the group and the order columns.
    Columns of these three names are replaced."""
    kept = [F.col(f"`{c}`") for c in leaves.columns if c.lower() not in ("proof", "subroot", "root")]
    named = leaves.select(F.struct(*kept).alias("row"), F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("group"), F.col("leaf"), *[F.col(c).alias(f"key{k}") for k, c in enumerate(order)])
    proven, paths, subroots = forest(named, [f"key{k}" for k in range(len(order))], partitions, step)
    subroots = materialize(subroots)
    upper, upper_paths, roots = forest(subroots.select(F.lit("").alias("group"), F.col("group").alias("name"), F.col("subroot").alias("leaf")), ["name"], None, step)
    above = upper.join(upper_paths.withColumnRenamed("proof", "_above").drop("group"), ["part", "top"]).select(F.col("name").alias("group"), F.col("leaf").alias("subroot"), F.concat("proof", "_above").alias("_above"))
    ends = materialize(paths.join(above, "group").crossJoin(F.broadcast(roots.select(F.col("subroot").alias("root")))).select("part", "top", "subroot", "root", F.concat("proof", "_above").alias("_rest")))
    size = ends.agg(F.sum(F.size("_rest") * (2 * ARITY * 64) + 256)).first()[0] or 0
    ends = F.broadcast(ends) if size <= BROADCAST_BYTES else ends
    return proven.join(ends, ["part", "top"]).select("row.*", F.concat("proof", "_rest").alias("proof"), "subroot", "root")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in FIELDS]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, leaf_of(*fields[:-1], F.replace(F.col("text").cast("string"), F.lit("\n"), F.lit("")))).alias("tampered")
    leaves = docs.select("doc_id", "source", leaf_of(*fields).alias("leaf"), tampered)
    proven = manifest(leaves, "source", ["doc_id"]).withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("proof")))
    joined = F.array_join(F.transform("proof", lambda run: F.concat(run["left"], run["right"])), "")
    return proven.select("doc_id", "leaf", "subroot", "root", F.sha2(joined, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_LEAF = " || ".join(f"coalesce(strlen(CAST({f} AS VARCHAR)) || ':' || CAST({f} AS VARCHAR), '-')" for f in FIELDS)
_TAMPERED = _LEAF.replace("CAST(text AS VARCHAR)", "replace(text, chr(10), '')")
SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, row_number() OVER () AS r, sha256({_LEAF}) AS leaf, sha256({_TAMPERED}) AS altered,
         list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
                     lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))) AS crc FROM documents),
placed AS (SELECT *, coalesce('=' || source, '') AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM d),
trees AS (
  SELECT g, 0 AS lv, i, n, leaf AS h FROM placed
  UNION ALL SELECT g, lv + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM trees WHERE n > 1 GROUP BY g, lv, i // 3, n),
subroots AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM trees WHERE n = 1),
top AS (
  SELECT 0 AS lv, i, n, h FROM subroots
  UNION ALL SELECT lv + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY lv, i // 3, n),
runs AS (
  SELECT p.r, t.lv, t.i, t.h, CAST(p.i // CAST(pow(3, t.lv) AS BIGINT) AS BIGINT) AS own FROM placed p JOIN trees t ON t.g = p.g AND t.n > 1 AND t.i // 3 = p.i // CAST(pow(3, t.lv + 1) AS BIGINT)
  UNION ALL SELECT p.r, 100 + t.lv, t.i, t.h, s.i // CAST(pow(3, t.lv) AS BIGINT) FROM placed p JOIN subroots s ON s.g = p.g JOIN top t ON t.n > 1 AND t.i // 3 = s.i // CAST(pow(3, t.lv + 1) AS BIGINT)),
steps AS (SELECT r, lv, coalesce(string_agg(h, '' ORDER BY i) FILTER (WHERE i < own), '') AS a, coalesce(string_agg(h, '' ORDER BY i) FILTER (WHERE i > own), '') AS b FROM runs GROUP BY r, lv),
proofs AS (SELECT r, list(a || '|' || b ORDER BY lv) AS steps FROM steps GROUP BY r),
told AS (
  SELECT p.doc_id, p.leaf, s.h AS subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(replace(coalesce(array_to_string(f.steps, ''), ''), '|', '')) AS proof_sha256,
         list_reduce(list_prepend(CASE WHEN xor(p.crc, 4294967295) % 2 = 0 THEN p.altered ELSE p.leaf END, coalesce(f.steps, [])), lambda acc, x: sha256(split_part(x, '|', 1) || acc || split_part(x, '|', 2))) AS folded_root
  FROM placed p JOIN subroots s ON s.g = p.g LEFT JOIN proofs f ON f.r = p.r)
SELECT *, folded_root = root AS verified FROM told
"""
