"""Connected components of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalmill.operators.storage import materialize

#: Far more rounds than any graph needs: a round at least halves what is left.
MOST_ROUNDS = 60


def canonical(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs with the lesser side first, each once; a pair with itself goes."""
    return pairs.where(F.col(a) != F.col(b)).select(F.least(a, b).alias(a), F.greatest(a, b).alias(b)).distinct()


def both_ways(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Every pair from both sides, so that a lookup by one column finds all."""
    return pairs.unionByName(pairs.select(F.col(b).alias(a), F.col(a).alias(b)))


def components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node of a pair; a component is named by its
    least node.

    Each round every node takes the least label among its own and its
    neighbours', then the label of that label. Groupings are partial minima, and
    every round is written to the shared folder.
    """
    edges = materialize(both_ways(canonical(pairs, a, b), a, b).select(F.col(a).alias("node"), F.col(b).alias("other")))
    labels = materialize(edges.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("component")))
    for _ in range(MOST_ROUNDS):
        near = edges.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("component").alias("near"))
        lower = labels.join(near, "node").select("node", F.least("component", "near").alias("label"))
        # follow the label's own label
        hop = lower.select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = materialize(lower.join(hop, "label", "left").select("node", F.least("label", F.coalesce("next", "label")).alias("component")))
        if after.join(labels, ["node", "component"], "left_anti").isEmpty():
            return after
        labels = after
    raise RuntimeError("components didn't settle")
