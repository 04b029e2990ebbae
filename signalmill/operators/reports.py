"""Roll-ups, digests and coverage reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from signalmill.operators.relational import in_order, latest
from signalmill.operators.storage import materialize

UNSTATED, UNCLASSED = "(unstated)", "(unclassed)"


def classify(text: Column, classes: list[tuple[str, str]]) -> Column:
    """The first class whose pattern the text holds, in any case; unstated for no
    text, unclassed if none fits."""
    out = F.lit(UNCLASSED)
    for name, pattern in reversed(classes):
        out = F.when(text.rlike(f"(?iu){pattern}"), name).otherwise(out)
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", UNSTATED).otherwise(out)


def synthesis(notes: DataFrame, dimensions: list[str], order: list[Column]) -> DataFrame:
    """(dimension, bucket, companies): companies counted once each, by their first
    notification in the order, along every dimension. One pass: the dimensions
    are a sum over grouping sets."""
    first = latest(notes, ["company_id"], order)
    each = first.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit(UNSTATED)).alias("bucket")) for d in dimensions])).alias("x"))
    return each.groupBy("x.dimension", "x.bucket").agg(F.count("*").alias("companies"))


def provenance(signals: DataFrame) -> DataFrame:
    """(source, touched, exclusive): companies with a signal of the source, and
    those with no other source."""
    pairs = signals.select("company_id", "source").distinct()
    alone = pairs.groupBy("company_id").agg(F.count("*").alias("_n"))
    return pairs.join(alone, "company_id").groupBy("source").agg(F.count("*").alias("touched"), F.count_if(F.col("_n") == 1).alias("exclusive"))


def exclusive_to(signals: DataFrame, sources: list[str]) -> DataFrame:
    """Companies all of whose signals come from a set of sources."""
    return signals.groupBy("company_id").agg(F.bool_and(F.col("source").isin(*sources)).alias("_all")).where("_all").select("company_id")


def field_inventory(rows: DataFrame, group: str, fields: str, width: int = 200) -> DataFrame:
    """(group, field, filled, values): how often each key of a map column has a
    value, and how many different ones."""
    each = rows.select(group, F.explode(fields).alias("field", "value")).where("value is not null and value <> ''")
    # equal values are summed where they lie; counting distinct ones beside all would repeat every row
    values = each.groupBy(group, "field", F.left("value", F.lit(width)).alias("_value")).agg(F.count("*").alias("_n"))
    return values.groupBy(group, "field").agg(F.sum("_n").alias("filled"), F.count("*").alias("values"))


def funnel(rows: DataFrame, stages: list[tuple[str, Column]]) -> DataFrame:
    """(stage, place, n, percent): rows that passed each stage and all before it."""
    passed, counts = F.lit(True), []
    for name, condition in stages:
        passed = passed & F.coalesce(condition, F.lit(False))
        counts.append((name, F.count_if(passed)))
    one = rows.agg(F.count("*").alias("_all"), *[c.alias(f"_{i}") for i, (_, c) in enumerate(counts)])
    listed = F.array(*[F.struct(F.lit(n).alias("stage"), F.lit(i).alias("place"), F.col(f"_{i}").alias("n")) for i, (n, _) in enumerate(counts)])
    return one.select("_all", F.explode(listed).alias("s")).select("s.stage", "s.place", "s.n", F.when(F.col("_all") > 0, F.round(100.0 * F.col("s.n") / F.col("_all"), 2)).alias("percent"))


def hierarchy(rows: DataFrame, code: str, widths: list[int]) -> DataFrame:
    """(width, code, n): codes cut to each width; shorter codes don't count for it."""
    parts = [rows.where(F.length(code) >= w).groupBy(F.lit(w).alias("width"), F.substring(code, 1, w).alias("code")).agg(F.count("*").alias("n")) for w in widths]
    return reduce(DataFrame.unionByName, parts)


def pareto(counts: DataFrame, keys: list[str], name: str, n: str = "n") -> DataFrame:
    """Adds ``running`` and ``share`` (hundredths): the most frequent first, ties by name."""
    told = in_order(counts, keys, [F.desc(n), F.col(name)], F.col(n))
    return told.withColumn("running", F.col("_running")).withColumn("share", F.round(100.0 * F.col("_running") / F.col("_total"), 2)).drop("_place", "_n", "_running", "_total")


def names_for_share(counts: DataFrame, keys: list[str], name: str, percent: float) -> DataFrame:
    """How many of the most frequent names make up a share."""
    told = pareto(counts, keys, name)
    before = F.col("running") - F.col("n")
    total = F.sum("n").over(W.partitionBy(*keys))
    return told.withColumn("_before", 100.0 * before / total).where(F.col("_before") < percent).groupBy(*keys).agg(F.count("*").alias("names"))


def compare_populations(rows: DataFrame, bucket: str, member: Column) -> DataFrame:
    """(bucket, inside, outside, inside_share, outside_share, difference, times):
    how a bucket's share differs between members and the rest."""
    inside, outside = F.coalesce(member, F.lit(False)), ~F.coalesce(member, F.lit(False))
    per = rows.groupBy(bucket).agg(F.count_if(inside).alias("inside"), F.count_if(outside).alias("outside"))
    whole = F.broadcast(per.agg(F.sum("inside").alias("_inside"), F.sum("outside").alias("_outside")))  # one row
    share = lambda c: F.round(100.0 * F.col(c) / F.nullif(F.col(f"_{c}"), F.lit(0)), 4)
    told = per.join(whole, F.lit(True)).withColumn("inside_share", share("inside")).withColumn("outside_share", share("outside")).drop("_inside", "_outside")
    return told.withColumn("difference", F.round(F.col("inside_share") - F.col("outside_share"), 4)).withColumn("times", F.round(F.col("inside_share") / F.nullif(F.col("outside_share"), F.lit(0.0)), 4))


def absent_profile(rows: DataFrame, bucket: str, absent: Column) -> DataFrame:
    """(bucket, absent_share, present_share, difference): each value's share among
    absent and present rows in per cent, the greatest difference first, ties by
    the value."""
    counts = rows.groupBy(F.coalesce(F.col(bucket).cast("string"), F.lit("(none)")).alias("bucket")).agg(F.count_if(absent).alias("_a"), F.count_if(~absent).alias("_p"))
    whole = counts.agg(F.sum("_a").alias("_wa"), F.sum("_p").alias("_wp"))  # one row
    share = lambda n, w: F.coalesce(100.0 * F.col(n) / F.nullif(F.col(w), F.lit(0)), F.lit(0.0))
    told = counts.join(F.broadcast(whole), F.lit(True)).select("bucket", share("_a", "_wa").alias("absent_share"), share("_p", "_wp").alias("present_share"))
    return told.withColumn("difference", F.col("absent_share") - F.col("present_share")).orderBy(F.desc(F.abs("difference")), "bucket")


def most_common(rows: DataFrame, value: str, k: int) -> DataFrame:
    """(value, n): the ``k`` most frequent values; of equally frequent ones the
    first in order."""
    return rows.groupBy(value).agg(F.count("*").alias("n")).orderBy(F.desc("n"), value).limit(k)


def calibration_alarm(rows: DataFrame, kept: Column) -> DataFrame:
    """(source, kept, dropped, alarm): an alarm for sources of which a territory's
    filter kept nothing while it dropped rows, so it likely speaks another
    language than the data."""
    told = rows.groupBy("source").agg(F.count_if(kept).alias("kept"), F.count_if(~kept).alias("dropped"))
    return told.withColumn("alarm", (F.col("kept") == 0) & (F.col("dropped") > 0))


def crosstab(rows: DataFrame, line: str, column: str, values: list[str]) -> DataFrame:
    """Shares (hundredths) of each column value within a line."""
    counts = rows.groupBy(line).pivot(column, values).count()
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(v), F.lit(0)) for v in values])
    return counts.select(line, *[F.round(100.0 * F.coalesce(F.col(v), F.lit(0)) / F.nullif(total, F.lit(0)), 4).alias(v) for v in values])


def histogram(rows: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n): bins of equal width from ``low`` to ``high``, outliers in 0 and bins + 1."""
    return rows.where(F.col(value).isNotNull()).groupBy(F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))


def plateaus(rows: DataFrame, value: str, least: int) -> DataFrame:
    return rows.groupBy(value).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def size_band(total: Column) -> Column:
    """Company size by its postings; none is unknown."""
    return F.when(total.isNull(), None).when(total < 5, "1-4").when(total < 20, "5-19").when(total < 100, "20-99").otherwise("100+")


def band_overlaps(band: Column, least: Column, most: Column) -> Column:
    """Whether a band overlaps a wanted range; an unknown size doesn't if there is one."""
    bounds = {"1-4": (1, 4), "5-19": (5, 19), "20-99": (20, 99), "100+": (100, None)}
    low = F.create_map(*[F.lit(x) for k, (a, _) in bounds.items() for x in (k, a)])
    high = F.create_map(*[F.lit(x) for k, (_, b) in bounds.items() if b for x in (k, b)])
    free = least.isNull() & most.isNull()
    return free | F.coalesce(((most.isNull()) | (low[band] <= most)) & (least.isNull() | high[band].isNull() | (high[band] >= least)) & band.isNotNull(), F.lit(False))


def digest(notes: DataFrame, values: DataFrame, k: int = 10) -> DataFrame:
    """The first k pending notifications by score and greatest value, nulls last,
    then by id, with the backlog's size. Spark keeps k rows per task to rank them."""
    most = values.groupBy("note_id").agg(F.max("value").alias("value"))
    pending = materialize(notes.where("sent_at is null"))  # counted and ranked
    backlog = pending.agg(F.count("*").alias("backlog"))
    tops = pending.join(most, "note_id", "left").orderBy(F.desc("score"), F.desc_nulls_last("value"), "note_id").limit(k)
    return tops.join(F.broadcast(backlog), F.lit(True))


def scan_report(runs: DataFrame) -> DataFrame:
    """(category, new, duplicates, errors): runs with an error add no rows."""
    fine = F.col("error").isNull()
    return runs.groupBy("category").agg(F.coalesce(F.sum(F.when(fine, F.col("new"))), F.lit(0)).alias("new"), F.coalesce(F.sum(F.when(fine, F.col("duplicates"))), F.lit(0)).alias("duplicates"), F.count_if(~fine).alias("errors"))


def read_cost(paths: DataFrame) -> DataFrame:
    """(path, rows_read, percent): calls * (share * population + fixed), and the
    yield in hundredths, null without calls."""
    read = F.col("calls") * (F.col("share") * F.col("population") + F.col("fixed"))
    return paths.select("path", read.alias("rows_read"), F.round(100.0 * F.col("hits") / F.nullif(F.col("calls"), F.lit(0)), 2).alias("percent"))


def coverage(rows: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """Rows of each group and how many have a value in each column."""
    return rows.groupBy(*group).agg(F.count("*").alias("rows"), *[F.count(c).alias(f"with_{c}") for c in columns])
