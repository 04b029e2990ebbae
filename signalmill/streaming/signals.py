"""Signals as a stream: new files are read once, repeated references within the
watermark are dropped, and counts by window and type come out as they close."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LATE = "30 days"


def read(spark: SparkSession, path: str, schema: str, files_at_once: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def without_repeats(stream: DataFrame, keys: list[str], at: str = "detected_at", late: str = LATE) -> DataFrame:
    """The first row of each key within the watermark; state is bounded by it."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def windowed(stream: DataFrame, at: str, span: str, by: list[str], late: str = LATE, slide: str | None = None) -> DataFrame:
    """Counts and sums of ``value`` by window and columns; late rows beyond the
    watermark don't count."""
    window = F.window(at, span, slide) if slide else F.window(at, span)
    out = stream.withWatermark(at, late).groupBy(window.alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def sessions(stream: DataFrame, at: str, gap: str, by: list[str], late: str = LATE) -> DataFrame:
    """Rows of a key that follow each other within a gap, counted."""
    out = stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes each row once to a Parquet folder and stops when the input is read."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def each_batch(stream: DataFrame, apply, checkpoint: str) -> StreamingQuery:
    """Runs a batch operator (as a snapshot diff or a resolution) on every
    micro-batch; ``apply`` gets the rows and the batch's number."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
