"""Tie-breakers between a query's competitors by what addresses and statuses say.

A fact is an array of comparable forms; null or empty is unknown, and unknown is
not "no".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BROKEN, QUERY_UNKNOWN, COMPETITOR_UNKNOWN, SEVERAL, EXCLUDED = "broken", "query unknown", "competitor unknown", "several compatible", "all excluded"


def _known(fact: Column) -> Column:
    return F.coalesce(F.size(fact) > 0, F.lit(False))


def by_fact(pairs: DataFrame, fact: str, asked: str) -> DataFrame:
    """(query_id, outcome, winner) of pairs (query_id, id, fact of the competitor,
    fact asked): broken if exactly one competitor is compatible and all are known."""
    fits = _known(F.col(fact)) & _known(F.col(asked)) & F.coalesce(F.arrays_overlap(fact, asked), F.lit(False))
    told = pairs.groupBy("query_id").agg(F.bool_or(~_known(F.col(asked))).alias("_no"), F.bool_or(~_known(F.col(fact))).alias("_unknown"), F.count_if(fits).alias("_fit"), F.min(F.when(fits, F.col("id"))).alias("_winner"))
    outcome = F.when(F.col("_no"), QUERY_UNKNOWN).when(F.col("_unknown"), COMPETITOR_UNKNOWN).when(F.col("_fit") == 0, EXCLUDED).when(F.col("_fit") > 1, SEVERAL).otherwise(BROKEN)
    return told.select("query_id", outcome.alias("outcome"), F.when(outcome == BROKEN, F.col("_winner")).alias("winner"))


#: Levels of an address in order, and whether each is a coarser form of the one
#: before: an exclusion falls through to a coarser form of the same fact only.
LEVELS = (("code", False), ("area", True), ("city", False))


def by_address(pairs: DataFrame) -> DataFrame:
    """(query_id, level, winner, outcome) of pairs (query_id, id, codes, city,
    asked_codes, asked_city): whole postal codes, then their areas, then cities."""
    whole = lambda c, n: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.length(x) == n)
    town = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.array(c))
    facts = {"code": (whole(F.col("codes"), 6), whole(F.col("asked_codes"), 6)), "area": (whole(F.col("codes"), 3), whole(F.col("asked_codes"), 3)), "city": (town(F.col("city")), town(F.col("asked_city")))}
    out = pairs.select("query_id").distinct()
    for name, _ in LEVELS:
        there, asked = facts[name]
        told = by_fact(pairs.select("query_id", "id", there.alias("there"), asked.alias("asked")), "there", "asked")
        out = out.join(told.select("query_id", F.col("outcome").alias(f"_{name}"), F.col("winner").alias(f"_w_{name}")), "query_id")
    level, winner, outcome = F.lit(None).cast("string"), F.lit(None).cast(dict(pairs.dtypes)["id"]), F.col(f"_{LEVELS[-1][0]}")
    for i in range(len(LEVELS) - 1, -1, -1):
        name = LEVELS[i][0]
        said = F.col(f"_{name}")
        goes_on = said.isin(QUERY_UNKNOWN, COMPETITOR_UNKNOWN, SEVERAL) if i + 1 < len(LEVELS) else F.lit(False)
        if i + 1 < len(LEVELS) and LEVELS[i + 1][1]:
            goes_on = goes_on | (said == EXCLUDED)
        level = F.when(said == BROKEN, name).when(goes_on, level)
        winner = F.when(said == BROKEN, F.col(f"_w_{name}")).when(goes_on, winner)
        outcome = F.when(said == BROKEN, said).when(goes_on, outcome).otherwise(said)
    return out.select("query_id", level.alias("level"), winner.alias("winner"), outcome.alias("outcome"))


def by_status(candidates: DataFrame, apart: float = 8.0, struck: str = "struck_off") -> DataFrame:
    """(query_id, outcome, winner): of the competitors within ``apart`` of the
    best, those struck off drop out; one left wins if it scores as the best does."""
    best = F.max("score").over(W.partitionBy("query_id"))
    near = candidates.withColumn("_best", best).where(F.col("_best") - F.col("score") < apart)
    alive = F.coalesce(F.col("status") != struck, F.lit(True))
    told = near.groupBy("query_id").agg(F.count_if(alive).alias("_left"), F.min(F.when(alive, F.col("id"))).alias("_id"), F.max(F.when(alive, F.col("score"))).alias("_score"), F.max("_best").alias("_best"))
    outcome = F.when(F.col("_left") == 0, "none left").when(F.col("_left") > 1, "several left").when(F.col("_score") < F.col("_best"), "not the best").otherwise(BROKEN)
    return told.select("query_id", outcome.alias("outcome"), F.when(outcome == BROKEN, F.col("_id")).alias("winner"))


def explain_move(before: DataFrame, after: DataFrame) -> DataFrame:
    """(query_id, move) of two runs (query_id, level, winner): what a change of the
    levels did to each query."""
    a = before.select("query_id", F.col("level").alias("_la"), F.col("winner").alias("_wa"))
    b = after.select("query_id", F.col("level").alias("_lb"), F.col("winner").alias("_wb"))
    move = (
        F.when(F.col("_wa").isNull() & F.col("_wb").isNull(), "still open").when(F.col("_wa").isNull(), "now broken").when(F.col("_wb").isNull(), "no longer broken")
        .when(F.col("_wa") != F.col("_wb"), "other winner").when(F.col("_la") != F.col("_lb"), "same winner by another level").otherwise("unchanged")
    )
    return a.join(b, "query_id", "full_outer").select("query_id", move.alias("move"))


def contradiction_cause(candidates: DataFrame, fact: str, asked: str, apart: float = 8.0, cut: int = 5) -> DataFrame:
    """(query_id, cause): who carries the fact asked for when the retained id does
    not: one of its own sites, a competitor within the gap, a candidate beyond
    the gap, one beyond the cut, or nobody. ``candidates`` has (query_id, id,
    rank, score, is_site, fact, asked); the retained id has rank 1, and rows of
    its sites have its rank."""
    fits = F.coalesce(F.arrays_overlap(fact, asked), F.lit(False))
    best = F.max("score").over(W.partitionBy("query_id"))
    told = candidates.withColumn("_gap", best - F.col("score")).withColumn("_fits", fits)
    any_of = lambda c: F.coalesce(F.bool_or(F.col("_fits") & c), F.lit(False))
    other = F.col("rank") > 1
    cause = (
        F.when(any_of((F.col("rank") == 1) & F.col("is_site")), "own site").when(any_of(other & (F.col("rank") <= cut) & (F.col("_gap") < apart)), "competitor")
        .when(any_of(other & (F.col("rank") <= cut)), "beyond the gap").when(any_of(other), "beyond the cut").otherwise("nobody")
    )
    return told.groupBy("query_id").agg(cause.alias("cause"))
