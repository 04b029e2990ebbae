"""Sketches by period against the rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalmill.operators import sketches


def test_merged_sketches_keep_their_errors(spark, tmp_path):
    df = spark.range(200_000).select((F.col("id") % 40).alias("day"), F.lit("a").alias("kind"), (F.col("id") % 70_000).alias("item"), (F.pmod(F.xxhash64("id"), F.lit(1_000_000)) / 10).alias("amount"))
    sketches.sketched(df, ["kind", "day"], F.col("item"), F.col("amount")).write.parquet(f"{tmp_path}/s")
    stored = spark.read.parquet(f"{tmp_path}/s")
    assert stored.count() == 40
    ranks = (0.01, 0.25, 0.5, 0.99)
    for days in ("true", "day < 20", "day = 3"):
        r = sketches.merged(stored.where(days), ["kind"], ranks).first()
        kept = df.where(days)
        assert r.n == kept.count()
        exact = kept.select("item").distinct().count()
        assert abs(r["distinct"] - exact) <= exact * sketches.distinct_error()
        for rank, value in zip(ranks, r.quantiles, strict=True):
            below = kept.where(F.col("amount") <= value).count() / r.n
            assert abs(below - rank) <= sketches.rank_error() + 1 / r.n


def test_nulls_and_nothing(spark):
    df = spark.createDataFrame([("a", None, None), ("a", None, None), ("b", "x", 2.0), (None, "x", 1.0)], "kind string, item string, amount double")
    got = {r.kind: (r.n, r["distinct"], r.quantiles) for r in sketches.merged(sketches.sketched(df, ["kind"], F.col("item"), F.col("amount")), ["kind"]).collect()}
    assert got == {"a": (2, 0, None), "b": (1, 1, [2.0]), None: (1, 1, [1.0])}
    assert sketches.merged(sketches.sketched(df.limit(0), ["kind"], F.col("item"), F.col("amount")), ["kind"]).count() == 0
