"""Confidence of a company's signals.

Each signal scores by its type and fades with age; a company's confidence is its
best faded score, a bonus for different types and one for links to other
provinces. One grouping by company does it.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalmill.functions.numbers import freshness, step

# Thresholds and scores, highest first.
TENDER = [(1_000_000, 85), (250_000, 65), (50_000, 45), (0, 25)]
FINANCING = [(500_000, 80), (100_000, 60), (25_000, 40), (0, 20)]
FOREIGN_WORKERS = [(5, 90), (2, 75), (1, 65)]
HIRING = [(10, 75), (5, 60), (2, 45), (1, 30)]
RANK = [(950, 90), (800, 75), (500, 60), (0, 45)]
GROWTH = [(200, 90), (100, 75), (50, 60), (0, 45)]
PERMIT = [("nouvelle", 75), ("amélioration", 50), ("amelioration", 50), ("autorisation", 30), ("occupation", 25)]
EQUIPMENT, VEHICLE = ("equipement", "équipement", "inventaire", "production"), ("vehicule", "véhicule")
CORROBORATION, MOST_CORROBORATION, MOST_EXPANSION = 12.0, 30.0, 15.0
HIGH, MEDIUM = 70.0, 40.0
LEVELS = {"low": 0, "medium": 1, "high": 2}
LEAST_LEVEL = {"low": "high", "medium": "medium", "high": "low"}  # by sensitivity


def _mentions(text: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(text, F.lit(p))
    return out


def tender(value: Column) -> Column:
    return step(F.coalesce(value, F.lit(0.0)), TENDER)


def financing(value: Column, goods: Column) -> Column:
    kind = F.lower(F.coalesce(goods, F.lit("")))
    bonus = F.when(_mentions(kind, EQUIPMENT), 15.0).when(_mentions(kind, VEHICLE), 0.0).otherwise(5.0)
    return F.least(F.lit(100.0), step(F.coalesce(value, F.lit(0.0)), FINANCING) + bonus)


def hiring(value: Column, posted: Column, official: Column) -> Column:
    """``posted`` is the number of the company's hiring signals; an official
    permit for foreign workers scores by its own number of posts."""
    return F.when(official, step(F.coalesce(F.nullif(value, F.lit(0.0)), posted), FOREIGN_WORKERS)).otherwise(step(posted, HIRING))


def permit(nature: Column) -> Column:
    kind = F.lower(F.coalesce(nature, F.lit("")))
    out = F.lit(35.0)
    for part, score in reversed(PERMIT):
        out = F.when(F.contains(kind, F.lit(part)), float(score)).otherwise(out)
    return out


def registry_change(kind: Column, nature: Column) -> Column:
    """A new site scores 70, whether the label says that it is a secondary one or not."""
    return F.when(kind.isin("new_site", "new_secondary_site"), 70.0).when(kind == "address_change", 50.0).when(kind == "permit", permit(nature)).otherwise(20.0)


def ranking(rank: Column, growth: Column) -> Column:
    by_rank = F.when(rank.isNotNull(), step(1000 - rank, RANK)).otherwise(F.lit(0.0))
    by_growth = F.when(growth.isNotNull(), step(growth, GROWTH)).otherwise(F.lit(0.0))
    return F.greatest(F.lit(50.0), by_rank, by_growth)


def base_score(posted: Column) -> Column:
    """Score of a signal row (signal_type, value, source, fields map) by its type."""
    field = lambda name: F.col("fields")[name]
    kind = F.col("signal_type")
    return (
        F.when(kind == "tender", tender(F.col("value")))
        .when(kind == "financing", financing(F.col("value"), field("goods")))
        .when(kind == "hiring", hiring(F.col("value"), posted, F.col("source") == "foreign_workers"))
        .when(kind == "registry", registry_change(field("change"), field("nature")))
        .when(kind == "ranking", ranking(field("rank").try_cast("double"), field("growth").try_cast("double")))
        .otherwise(30.0)
    )


def signal_scores(signals: DataFrame, as_of: datetime) -> DataFrame:
    """Adds ``base`` and ``faded`` to signals (company_id, signal_type, value,
    source, detected_at, fields). A company's hiring signals are counted by a
    grouping that joins back, so a company with very many is split as any join."""
    posted = signals.where("signal_type = 'hiring'").groupBy("company_id").agg(F.count("*").alias("_posted"))
    told = signals.join(posted, "company_id", "left").withColumn("base", base_score(F.coalesce("_posted", F.lit(0))))
    return told.withColumn("faded", F.col("base") * freshness(F.col("detected_at"), as_of)).drop("_posted")


def level(score: Column) -> Column:
    return F.when(score >= HIGH, "high").when(score >= MEDIUM, "medium").otherwise("low")


def confidence(signals: DataFrame, as_of: datetime, expansion: DataFrame | None = None) -> DataFrame:
    """(company_id, best, types, corroboration, expansion, score, level). The
    level reads the score before it is rounded. ``expansion`` has (company_id,
    bonus)."""
    posted = F.count_if(F.col("signal_type") == "hiring")
    # The hiring score depends on a count over the group; so the best faded hiring
    # row is kept apart and scored once the count is known.
    age = freshness(F.col("detected_at"), as_of)
    is_hiring, official = F.col("signal_type") == "hiring", (F.col("source") == "foreign_workers") & (F.coalesce(F.col("value"), F.lit(0.0)) != 0)
    fixed = F.max(F.when(~is_hiring | official, base_score(F.lit(0)) * age))
    freshest_official = F.max(F.when(is_hiring & (F.col("source") == "foreign_workers") & ~official, age))
    freshest = F.max(F.when(is_hiring & (F.col("source") != "foreign_workers"), age))
    per = signals.groupBy("company_id").agg(fixed.alias("_fixed"), freshest_official.alias("_official"), freshest.alias("_plain"), posted.alias("_posted"), F.count_distinct("signal_type").alias("types"))
    best = F.greatest(F.coalesce("_fixed", F.lit(0.0)), F.coalesce(F.col("_official") * step(F.col("_posted"), FOREIGN_WORKERS), F.lit(0.0)), F.coalesce(F.col("_plain") * step(F.col("_posted"), HIRING), F.lit(0.0)))
    per = per.select("company_id", best.alias("best"), "types", F.least(F.lit(MOST_CORROBORATION), CORROBORATION * (F.col("types") - 1)).alias("corroboration"))
    if expansion is None:
        per = per.withColumn("expansion", F.lit(0.0))
    else:
        per = per.join(expansion.select("company_id", F.greatest(F.lit(0.0), F.least(F.lit(MOST_EXPANSION), "bonus")).alias("expansion")), "company_id", "left").withColumn("expansion", F.coalesce("expansion", F.lit(0.0)))
    raw = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("best") + F.col("corroboration") + F.col("expansion")))
    return per.withColumn("score", F.round(raw, 1)).withColumn("level", level(raw))


def passes(level_column: Column, sensitivity: Column) -> Column:
    """Whether a level is enough for a sensitivity: the more sensitive, the less."""
    order = F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair])
    least = F.create_map(*[F.lit(x) for pair in LEAST_LEVEL.items() for x in pair])
    return order[level_column] >= order[least[sensitivity]]
