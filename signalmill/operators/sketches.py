"""Sketches stored by period and merged on reading.

Distinct counts and quantiles of any run of periods come from a few kilobytes a
period, not from the rows. Both sketches are Spark's own; their errors follow from
their sizes: ``3 * 1.04 / sqrt(2 ** lg)`` of a distinct count (three standard
errors) and about ``4 / k`` of a rank.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG, K = 12, 400


def distinct_error(lg: int = LG) -> float:
    """Share of a distinct count by which an estimate may be off, three standard errors."""
    return 3 * 1.04 / math.sqrt(1 << lg)


def rank_error(k: int = K) -> float:
    """Share of all rows by which the rank of an estimated quantile may be off."""
    return 4.0 / k


def sketched(rows: DataFrame, keys: list[str], item: Column, amount: Column, lg: int = LG, k: int = K) -> DataFrame:
    """(keys, n, items, amounts): rows counted, a sketch of the distinct items and
    one of the amounts of each group; nulls are left out of the sketches. The
    groups' sketches are made where the rows lie and merged in the shuffle."""
    return rows.withColumn("_item", item.cast("string")).withColumn("_amount", amount.cast("double")).groupBy(*keys).agg(F.count("*").alias("n"), F.hll_sketch_agg("_item", lg).alias("items"), F.expr(f"kll_sketch_agg_double(_amount, {k})").alias("amounts"))


def merged(stored: DataFrame, keys: list[str], ranks: tuple[float, ...] = (0.5,)) -> DataFrame:
    """(keys, n, distinct, quantiles) over the periods of ``stored`` that are left;
    groups without an amount have null quantiles."""
    both = stored.groupBy(*keys).agg(F.sum("n").alias("n"), F.hll_union_agg("items").alias("_items"), F.expr("kll_merge_agg_double(amounts)").alias("_amounts"))
    asked = ", ".join(f"{float(r)}D" for r in ranks)
    quantiles = F.expr(f"CASE WHEN kll_sketch_get_n_double(_amounts) > 0 THEN kll_sketch_get_quantile_double(_amounts, array({asked})) END")
    return both.select(*keys, "n", F.hll_sketch_estimate("_items").alias("distinct"), quantiles.alias("quantiles"))
