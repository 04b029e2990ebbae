"""Connected components of an edge table, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalmill.llm.common import materialize

#: Rounds after which a graph would count as broken; a round at least halves
#: the depth of what is left, so 2^60 vertices in a chain need fewer.
MOST_ROUNDS = 60
#: Parts into which the edges of one vertex are dealt, so that a hub is no task of its own.
SALTS = 64


def _salt(other: str) -> Column:
    return F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a vertex is linked to the vertex's least neighbour.

    A vertex's edges lie in parts by (vertex, salt). Each part has its minimum,
    the parts' minima give the vertex's, and that goes back to the parts; no step
    has more than a part of a hub's edges in a task.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).withColumn("salt", _salt("v"))
    parts = both.groupBy("u", "salt").agg(F.min("v").alias("part"))
    least = parts.groupBy("u").agg(F.min("part").alias("m"), F.collect_list("salt").alias("salts")).select("u", F.least("u", "m").alias("m"), F.explode("salts").alias("salt"))
    return both.where("v > u").join(least, ["u", "salt"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every neighbour below a vertex, and the vertex, are linked to the least."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).withColumn("salt", _salt("v"))
    parts = down.groupBy("u", "salt").agg(F.min("v").alias("part"))
    least = parts.groupBy("u").agg(F.min("part").alias("m"), F.collect_list("salt").alias("salts"))
    placed = least.select("u", "m", F.explode("salts").alias("salt"))
    moved = down.join(placed, ["u", "salt"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` has (u, v); returns (node, root) for every node of an edge, root
    being the least node of its component (the root itself is included).

    Alternates large-star and small-star steps until the edges form stars. Each
    round is written to the shared folder, so the plan stays small and a lost
    executor costs one round. Self links are ignored, repeated links count once,
    and an empty table gives an empty one.
    """
    found = materialize(edges.where("u <> v").select("u", "v").distinct())  # read three times below
    after = materialize(_small_star(found))
    state = _state(after)
    for _ in range(MOST_ROUNDS):
        after, before = materialize(_small_star(_large_star(after))), state
        state = _state(after)
        if state == before:
            break
    else:
        raise RuntimeError("components didn't settle")
    roots = after.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return after.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def salted_join(rows: DataFrame, few: DataFrame, on: str, salts: int = SALTS) -> DataFrame:
    """Inner join of rows, many of which may share a key, with a table that has a
    row for each key: that table is repeated once for each salt."""
    dealt = rows.withColumn("_salt", F.monotonically_increasing_id() % salts)
    each = few.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return dealt.join(each, [on, "_salt"]).drop("_salt")


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
