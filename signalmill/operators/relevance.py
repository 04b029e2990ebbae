"""Relevance of a company to a profile's needs, and the matching before it.

Profiles, needs and categories are small tables of configuration; signals and
companies are large. Needs meet signals by the category that a signal type makes
likely: an equi-join on the exploded category.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalmill.operators.relational import densest_window


@dataclass(frozen=True)
class Weighting:
    # Bases of the three grades, bonuses and their limits.
    keyword: float = 90.0
    main: float = 60.0
    secondary: float = 30.0
    absence: float = 15.0
    per_signal: float = 8.0
    most_velocity: float = 24.0
    who: float = 12.0
    window_days: int = 60
    grade_aaa: float = 80.0
    grade_aa: float = 50.0


#: Weightings ready for three uses.
PRESETS = {
    "surety": Weighting(most_velocity=40.0, per_signal=15.0),
    "early_financing": Weighting(absence=30.0),
    "acquisition": Weighting(secondary=40.0, main=70.0, keyword=100.0, absence=5.0, most_velocity=35.0, per_signal=12.0),
}

GRADES = {"A": 0, "AA": 1, "AAA": 2}
LEAST_GRADE = {"low": "AAA", "medium": "AA", "high": "A"}  # by sensitivity


def sphere_base(keyword_hit: Column, is_main: Column, is_likely: Column, weight: Column, w: Weighting = Weighting()) -> Column:
    """Base of a signal for one linked category: a keyword counts in full, the
    main category of the type and the others by the link's weight; else null."""
    return F.when(weight.isNull(), None).when(keyword_hit, w.keyword).when(is_likely & is_main, w.main * weight / 100).when(is_likely, w.secondary * weight / 100)


def in_territory(city: Column, region: Column, territory: Column) -> Column:
    """A need without a territory takes any; else it equals the city or region."""
    folded = lambda c: F.lower(F.trim(c))
    return territory.isNull() | F.coalesce(folded(city) == folded(territory), F.lit(False)) | F.coalesce(folded(region) == folded(territory), F.lit(False))


def in_territories(place: Column, allowed: list[str]) -> Column:
    """Membership of a source's territories: no list or no place passes. Places are
    compared by their letters and digits alone, in normal form; a territory is
    also known by what is left of it without its letters beyond ASCII."""
    if not allowed:
        return F.lit(True)
    from signalmill.functions.text import normalise, normalised

    key = lambda name: normalised(name).replace(" ", "")
    keys = {key(a) for a in allowed} | {key("".join(c for c in a if c.isascii())) for a in allowed}
    return place.isNull() | (F.trim(place) == "") | F.replace(normalise(place), F.lit(" "), F.lit("")).isin(*sorted(keys))


def match_needs(signals: DataFrame, types: DataFrame, needs: DataFrame) -> DataFrame:
    """Signals with the needs they may serve: (signal_id, company_id, need_id,
    sphere, is_main, is_likely, weight).

    ``types`` has (signal_type, spheres array, the main one first), ``needs``
    (need_id, sphere, weight), both configuration."""
    likely = types.select("signal_type", F.posexplode("spheres").alias("place", "sphere"))
    linked = likely.join(needs, "sphere").select("signal_type", "sphere", (F.col("place") == 0).alias("is_main"), "need_id", "weight")
    return signals.join(linked, "signal_type").select("signal_id", "company_id", "need_id", "sphere", "is_main", F.lit(True).alias("is_likely"), "weight")


def absence_bonus(signals: DataFrame, expected_type: str, w: Weighting = Weighting()) -> DataFrame:
    """(company_id, absence): companies with signals, none of the expected type."""
    there = F.bool_or(F.col("signal_type") == expected_type)
    return signals.groupBy("company_id").agg(F.when(there, 0.0).otherwise(w.absence).alias("absence"))


def velocity_bonus(signals: DataFrame, w: Weighting = Weighting()) -> DataFrame:
    """(company_id, densest, velocity): for signals close to each other."""
    dense = densest_window(signals, ["company_id"], "detected_at", w.window_days)
    return dense.withColumn("velocity", F.least(F.lit(w.most_velocity), w.per_signal * (F.col("densest") - 1)))


def who(company_kinds: Column, need_kinds: Column, w: Weighting = Weighting(), unrestricted: str = "any") -> Column:
    """Struct (bonus, off_profile) from the company's kinds of client (array) and
    the need's (array of struct(kind, weight)). Unknown kinds never count against."""
    free = (F.size(F.coalesce(need_kinds, F.array())) <= 0) | F.exists(need_kinds, lambda k: k["kind"] == unrestricted) | (F.size(F.coalesce(company_kinds, F.array())) <= 0)
    shared = F.filter(need_kinds, lambda k: F.array_contains(company_kinds, k["kind"]))
    best = F.array_max(F.transform(shared, lambda k: k["weight"]))
    free = F.coalesce(free, F.lit(True))
    return F.struct(F.when(free | (F.size(shared) == 0), 0.0).otherwise(w.who * best / 100).alias("bonus"), (~free & (F.size(shared) == 0)).alias("off_profile"))


def relevance(base: Column, feedback: Column, absence: Column, velocity: Column, who_bonus: Column) -> Column:
    return F.least(F.lit(100.0), base * feedback + absence + velocity + who_bonus)


def grade(score: Column, w: Weighting = Weighting()) -> Column:
    return F.when(score >= w.grade_aaa, "AAA").when(score >= w.grade_aa, "AA").otherwise("A")


def passes(grade_column: Column, sensitivity: Column) -> Column:
    order = F.create_map(*[F.lit(x) for pair in GRADES.items() for x in pair])
    least = F.create_map(*[F.lit(x) for pair in LEAST_GRADE.items() for x in pair])
    return order[grade_column] >= order[least[sensitivity]]


def feedback_weight(rejections: Column) -> Column:
    """Each "not relevant" takes 0.15 off, down to 0.4."""
    return F.greatest(F.lit(0.4), 1.0 - 0.15 * rejections)


def normalised_weights(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Adds ``weight``: 100 for the greatest of each group, the others in proportion."""
    from pyspark.sql import Window as W

    return df.withColumn("weight", F.round(100.0 * F.col(value) / F.max(value).over(W.partitionBy(*keys)), 1))
