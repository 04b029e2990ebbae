"""Relational helpers that the other operators and queries share.

Everything is a join, a grouping or a window; whatever decides between rows has
an explicit total order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from signalmill.operators.storage import materialize


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order; its columns stay. Spark limits
    the rank by group before it shuffles."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def top(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key, with their rank."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def insert_absent(state: DataFrame, fresh: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First writer wins: the state and, of the fresh rows whose key it lacks,
    the first of each key."""
    return state.unionByName(latest(fresh.join(state.select(*keys), keys, "left_anti"), keys, order))


def upsert(state: DataFrame, fresh: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Last writer wins: the fresh rows replace those of the state. The fresh
    side keeps the first of each key in the order."""
    fresh = latest(fresh, keys, order)
    return state.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)


def delete(state: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return state.join(gone.select(*keys), keys, "left_anti")


def until_known_run(rows: DataFrame, known: DataFrame, ref: str, order: list[Column], run: int, keys: list[str]) -> DataFrame:
    """Rows in order up to the first run of ``run`` known references, which stops
    the reading; ``keys`` part the rows into streams that are read alone."""
    told = rows.join(known.select(ref).distinct().withColumn("_known", F.lit(1)), ref, "left").withColumn("_known", F.coalesce("_known", F.lit(0)))
    placed = _streaks(told, keys, order, F.col("_known") == 1, F.col("_known") == 0)
    stops = placed.where(F.col("streak") >= run).groupBy(*keys).agg(F.min("_place").alias("_stop"))
    met = placed.alias("p").join(stops.alias("s"), [F.col(f"p.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys], "left")
    return met.where(F.col("_stop").isNull() | (F.col("_place") <= F.col("_stop"))).select(*[F.col(f"p.`{c}`") for c in told.columns if c != "_known"])


def in_order(rows: DataFrame, keys: list[str], order: list[Column], amount: Column | None = None) -> DataFrame:
    """Adds each row's place in its group's order (from 0), the group's size, and
    the running and whole sums of an amount.

    Rows are dealt to tasks by ranges of group and order and written once; the
    sums of whole ranges, a row for each range and group, give what lies before a
    range. So a group that holds a third of the rows is spread over tasks.
    """
    dealt = rows.withColumn("_amount", F.lit(1) if amount is None else amount).repartitionByRange(*[F.col(k) for k in keys], *order)
    dealt = materialize(dealt.withColumn("_range", F.spark_partition_id()))
    own = W.partitionBy(*keys, "_range").orderBy(*order)
    before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    sums = dealt.groupBy(*keys, "_range").agg(F.count("*").alias("_c"), F.sum("_amount").alias("_s"))
    zero = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    sums = sums.select(*keys, "_range", zero("_c").alias("_c0"), zero("_s").alias("_s0"), F.sum("_c").over(whole).alias("_n"), F.sum("_s").over(whole).alias("_total"))
    placed = dealt.withColumn("_own", F.row_number().over(own) - 1).withColumn("_run", F.sum("_amount").over(own.rowsBetween(W.unboundedPreceding, 0)))
    met = placed.alias("p").join(sums.alias("s"), [F.col(f"p.{k}").eqNullSafe(F.col(f"s.{k}")) for k in [*keys, "_range"]])
    return met.select(*[F.col(f"p.`{c}`") for c in rows.columns], (F.col("_own") + F.col("_c0")).alias("_place"), "_n", (F.col("_run") + F.col("_s0")).alias("_running"), "_total")


def spread_sample(rows: DataFrame, order: list[Column], k: int, keys: list[str]) -> DataFrame:
    """k rows of each group at equal steps of its order: the places
    floor(i * n / k); the whole group if it has no more than k."""
    placed = in_order(rows, keys, order)
    # A place is taken if it is the first at or after a multiple of n / k.
    i = F.ceil(F.col("_place") * k / F.col("_n"))
    taken = (F.col("_n") <= k) | ((i < k) & (F.floor(i * F.col("_n") / k) == F.col("_place")))
    return placed.where(taken).drop("_place", "_n", "_running", "_total")


def _streaks(rows: DataFrame, keys: list[str], order: list[Column], counted: Column, resets: Column) -> DataFrame:
    from signalmill.operators.ranges import carried

    told = rows.withColumn("_one", F.coalesce(counted.cast("int"), F.lit(0))).withColumn("_reset", F.coalesce(resets, F.lit(False)))
    placed = in_order(told, keys, order, F.col("_one"))
    since = carried(placed, keys, [F.col("_place")], F.when(F.col("_reset"), F.col("_running") - F.col("_one")), "_since")
    return since.select(*rows.columns, "_place", (F.col("_running") - F.coalesce("_since", F.lit(0))).alias("streak"))


def consecutive(rows: DataFrame, keys: list[str], order: list[Column], counted: Column, resets: Column) -> DataFrame:
    """Adds ``streak``: how many counted rows there were since the last reset, the
    reset's own row included. The running count of a key is taken over ranges, and
    what it was at the last reset is carried along, so no key is in one task."""
    return _streaks(rows, keys, order, counted, resets).drop("_place")


def densest_window(rows: DataFrame, keys: list[str], at: str, days: int) -> DataFrame:
    """Per key, the most rows that any span of ``days`` holds."""
    seconds = F.unix_micros(F.col(at).cast("timestamp"))
    span = W.partitionBy(*keys).orderBy(seconds).rangeBetween(0, days * 86_400_000_000)
    return rows.withColumn("_held", F.count("*").over(span)).groupBy(*keys).agg(F.max("_held").alias("densest"))
