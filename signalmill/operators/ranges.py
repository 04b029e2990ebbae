"""Joins of intervals and of moments, and scans along one key by all tasks.

An interval lies at the level whose bins are just longer than it, so it touches
one or two of them; of two intervals that overlap the shorter one looks the other
up in the bins of its level. A pair is kept in the one bin that holds the later
start, so nothing is met twice and nothing compared but what shares a bin.

Scans deal rows to tasks by ranges of key and order; what a range ends with, a row
for each range and key, is carried into the ranges after it. So a key that holds a
third of all rows is scanned by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from signalmill.operators.storage import materialize


def carried(rows: DataFrame, keys: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """Adds the last value that isn't null, of the row itself or of those before
    it in its key's order. Null keys are a key."""
    dealt = rows.withColumn("_value", value).repartitionByRange(*[F.col(k) for k in keys], *order)
    dealt = materialize(dealt.withColumn("_range", F.spark_partition_id()))
    own = W.partitionBy(*keys, "_range").orderBy(*order)
    known = dealt.withColumn("_last", F.last("_value", True).over(own.rowsBetween(W.unboundedPreceding, 0)))
    ends = known.withColumn("_own", F.row_number().over(own)).groupBy(*keys, "_range").agg(F.max_by("_last", "_own").alias("_end"))
    before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select(*keys, "_range", F.last("_end", True).over(before).alias("_before"))
    met = known.alias("p").join(ends.alias("e"), [F.col(f"p.{k}").eqNullSafe(F.col(f"e.{k}")) for k in [*keys, "_range"]])
    return met.select(*[F.col(f"p.`{c}`") for c in rows.columns], F.coalesce("_last", "_before").alias(name))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, name: str = "found", ties: tuple[str, ...] = ()) -> DataFrame:
    """The left rows with the right row of their keys that was the latest at their
    time, as a struct; of right rows of one time the last by ``ties``. Null where
    there is none, and for null keys or times. Every left row stays, repeated ones
    too."""
    kinds = dict(right.dtypes)
    theirs = right.where(F.col(at).isNotNull()).select(*keys, F.col(at).alias("_at"), F.lit(0).alias("_side"), *[F.col(t).alias(f"_tie{n}") for n, t in enumerate(ties)], F.struct(*right.columns).alias("_right"))
    mine = left.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_side"), *[F.lit(None).cast(kinds[t]).alias(f"_tie{n}") for n, t in enumerate(ties)], F.struct(*left.columns).alias("_left"))
    order = [F.col("_at"), F.col("_side"), *[F.col(f"_tie{n}") for n in range(len(ties))]]
    scanned = carried(theirs.unionByName(mine, allowMissingColumns=True), keys, order, F.col("_right"), "_found").where("_side = 1")
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    return scanned.select("_left.*", F.when(whole & F.col("_at").isNotNull(), F.col("_found")).alias(name))


def _leveled(rows: DataFrame, keys: list[str], start: str, end: str, side: str) -> DataFrame:
    """Rows as a struct, with bounds as numbers and the level; without null or reversed ones."""
    kind = dict(rows.dtypes)[start]
    number = lambda c: F.unix_micros(F.col(c).cast("timestamp")) if kind in ("timestamp", "timestamp_ntz", "date") else F.col(c).cast("long")
    bounds = rows.select(*[F.col(k).alias(f"k{n}") for n, k in enumerate(keys)], F.struct(*rows.columns).alias(side), number(start).alias(f"{side}_start"), number(end).alias(f"{side}_end"))
    return bounds.where(f"{side}_start <= {side}_end").withColumn(f"{side}_level", F.length(F.bin(F.col(f"{side}_end") - F.col(f"{side}_start"))))


def _binned(rows: DataFrame, side: str) -> DataFrame:
    """A row for each bin that the interval touches at ``level``."""
    return rows.withColumn("bin", F.explode(F.expr(f"sequence(shiftright({side}_start, level), shiftright({side}_end, level))")))


def overlapping(left: DataFrame, right: DataFrame, start: str, end: str, keys: list[str] | None = None) -> DataFrame:
    """(a, b): all pairs of left and right rows, as structs, of equal keys whose
    intervals overlap. ``start`` and ``end`` belong to the interval and are
    numbers, dates or timestamps; rows with a null among keys or bounds, or that end before
    they start, are in no pair."""
    keys = keys or []
    sides = {"a": _leveled(left, keys, start, end, "a"), "b": _leveled(right, keys, start, end, "b")}
    levels = {side: sorted(r[0] for r in rows.select(f"{side}_level").distinct().collect()) for side, rows in sides.items()}  # 64 at most
    on = [*[f"k{n}" for n in range(len(keys))], "level", "bin"]

    def met(short: str, long: str, equal: bool) -> DataFrame:
        own = _binned(sides[long].withColumn("level", F.col(f"{long}_level")), long)
        wanted = F.filter(F.array(*[F.lit(n) for n in levels[long]]).cast("array<int>"), lambda n: n >= F.col(f"{short}_level") if equal else n > F.col(f"{short}_level"))
        looked = _binned(sides[short].withColumn("level", F.explode(wanted)), short)
        pairs = looked.join(own, on).where("a_start <= b_end AND b_start <= a_end")
        return pairs.where(F.expr("bin = shiftright(greatest(a_start, b_start), level)")).select("a", "b")

    return met("a", "b", True).unionByName(met("b", "a", False))
