"""Exact joins of names by edits, without comparing all pairs.

Two names whose longer one has M characters and that differ in at most d edits,
d = (1 - score) M, share a piece: cut the shorter one into d + 1 pieces, and d
edits leave one of them whole, near its own place. The shorter names are indexed
by their pieces under every d that a longer partner may have; a name looks up, for
each length a partner may have, the substrings that could be that partner's
pieces. Everything is a join by (length, d, number of the piece, its text), and
edits are counted only for pairs that share one.

The lower the score asked for, the shorter the pieces. :func:`best_matches` wants
few matches for each name, so it asks for high scores first; only names that don't
have enough matches there go on to lower ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalmill.functions import blocks
from signalmill.functions.fuzzy import edit_similarity, letters
from signalmill.operators import blocking
from signalmill.operators.relational import top
from signalmill.operators.storage import materialize

#: Scores asked for one after another.
STEPS = (92.0, 84.0, 76.0, 68.0)
#: Below it pieces are so short that they tell nothing: names left are compared with all.
LEAST_BY_PIECES = 55.0
#: A meeting by a piece costs about as much as so many pairs of a block.
PIECE_WORK = 20.0


def _edits(length: Column, least: float) -> Column:
    """Edits that leave a name of this length, the longer one, at the score."""
    return F.floor(length * ((100.0 - least) / 100.0 + 1e-6)).cast("int")


def _piece(length: Column, edits: Column, number: Column) -> tuple[Column, Column]:
    """(start from 0, size) of a piece of ``edits`` + 1 nearly equal ones, short ones first."""
    size = F.floor(length / (edits + 1)).cast("int")
    short = edits + 1 - length % (edits + 1)
    return number * size + F.greatest(F.lit(0), number - short), size + (number >= short).cast("int")


def _indexed(names: DataFrame, least: float) -> DataFrame:
    """(b, m, d, i, piece): the pieces of each name as the shorter one of a pair."""
    share = (100.0 - least) / 100.0 + 1e-6
    each = names.select(F.col("name").alias("b"), F.length("name").alias("m"))
    each = each.withColumn("d", F.explode(F.sequence(_edits(F.col("m"), least), _edits(F.floor(F.col("m") / (1 - share)), least))))
    each = each.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("d"))))
    start, size = _piece(F.col("m"), F.col("d"), F.col("i"))
    return each.select("b", "m", "d", "i", F.substring("b", start + 1, size).alias("piece"))


def _asked(names: DataFrame, least: float) -> DataFrame:
    """(a, m, d, i, piece): what each name looks up as the longer one of a pair."""
    each = names.select(F.col("name").alias("a"), F.length("name").alias("_long")).withColumn("d", _edits(F.col("_long"), least))
    each = each.withColumn("m", F.explode(F.sequence(F.greatest(F.lit(1), F.col("_long") - F.col("d")), F.col("_long"))))
    each = each.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("d"))))
    start, size = _piece(F.col("m"), F.col("d"), F.col("i"))
    # At most i edits lie before a piece that all pieces before it lack, and d - i behind it.
    shift, before, behind = F.col("_long") - F.col("m"), F.col("i"), F.col("d") - F.col("i")
    low = F.greatest(F.lit(0), start - before, start + shift - behind)
    high = F.least(F.col("_long") - size, start + before, start + shift + behind)
    each = each.withColumn("_low", low).withColumn("_high", high).withColumn("_size", size).where("_low <= _high")
    each = each.withColumn("_at", F.explode(F.sequence("_low", "_high")))
    return each.select("a", "m", "d", "i", F.substring("a", F.col("_at") + 1, F.col("_size")).alias("piece")).distinct()


def met(longer: DataFrame, shorter: DataFrame, least: float) -> DataFrame:
    """(a, b): names of ``longer`` and no longer names of ``shorter`` that share a
    piece, each pair once; all pairs of the score are among them."""
    return _asked(longer, least).join(_indexed(shorter, least), ["m", "d", "i", "piece"]).select("a", "b").distinct()


def similar_names(names: DataFrame, others: DataFrame, least: float) -> DataFrame:
    """(a, b, score): all pairs of ``names`` (name) and ``others`` (name) of at
    least the score, from the side of ``names``; a name is a pair with itself."""
    names, others = names.where("name <> ''").distinct(), others.where("name <> ''").distinct()
    if least <= LEAST_BY_PIECES:
        tag = lambda df, c: df.select(F.col("name").alias(c), F.lit(0).alias("_all"), letters(F.col("name")).alias(f"_{c}"))
        common = F.aggregate(F.zip_with("_a", "_b", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
        longest = F.greatest(F.length("a"), F.length("b"))
        strange = lambda c: F.length(c) - F.aggregate(f"_{c}", F.lit(0), lambda s, x: s + x)  # noqa: E731  characters that letters() doesn't count
        pairs = blocking.in_tiles(tag(names, "a"), tag(others, "b"), "_all", "a", "b").where(longest - common - F.least(strange("a"), strange("b")) <= _edits(longest, least))
    else:
        pairs = met(names, others, least).union(met(others, names, least).select("b", "a")).distinct()
    return pairs.withColumn("score", edit_similarity(F.col("a"), F.col("b"))).where(F.col("score") >= least).select("a", "b", "score")


def _meetings(names: DataFrame, others: DataFrame, least: float) -> float:
    """How often names would meet by pieces."""
    keys = ["m", "d", "i", "piece"]
    total = lambda a, b: _asked(a, least).groupBy(*keys).agg(F.count("*").alias("_n")).join(_indexed(b, least).groupBy(*keys).agg(F.count("*").alias("_of")), keys).agg(F.sum(F.col("_n").cast("double") * F.col("_of"))).first()[0] or 0.0
    return total(names, others) + total(others, names)


def best_matches(pool: DataFrame, least: float, most: int, kind: type = blocks.Edits) -> DataFrame:
    """(query_id, id, score, rank): for each company of ``pool`` (company_id, name,
    provinces array) the best ``most`` that have a province it lacks, by edits or
    another score of :mod:`signalmill.functions.blocks`.

    Companies of equal name and provinces have the same matches, and none of them
    matches another, so they are searched once: a class of such companies, of which
    the first ``most`` ids can be anybody's matches. Null names or provinces and
    empty names match nothing. By edits, names meet by pieces as long as that is
    less work than comparing all of them in blocks, which the last step does.
    """
    named = materialize(pool.where("name <> '' AND provinces IS NOT NULL").select("company_id", "name", F.array_sort(F.array_distinct("provinces")).alias("provinces")))
    first = top(named, ["name", "provinces"], [F.col("company_id")], most)
    heads = first.groupBy("name", "provinces").agg(F.array_sort(F.collect_list("company_id")).alias("ids"))
    heads = blocking.numbered(heads, "_r", F.element_at("ids", 1))
    left, found = heads.select("name", "provinces"), []
    all_ = heads.count()
    for step in (s for s in STEPS if s > least) if kind is blocks.Edits else ():
        if PIECE_WORK * _meetings(left.select("name").distinct(), heads.select("name").distinct(), step) > float(left.count()) * all_:
            break
        pairs = similar_names(left.select("name"), heads.select("name"), step)
        theirs = heads.select(F.col("name").alias("b"), F.col("provinces").alias("_theirs"), "ids")
        near = left.join(pairs, left["name"] == pairs["a"]).join(theirs, "b").where(F.size(F.array_except("_theirs", "provinces")) > 0)
        best = materialize(top(near.select("name", "provinces", F.explode("ids").alias("id"), "score"), ["name", "provinces"], [F.col("score").desc(), F.col("id")], most))
        done = best.groupBy("name", "provinces").agg(F.count("*").alias("n")).where(F.col("n") == most).drop("n")
        found.append(best.join(done, ["name", "provinces"], "left_semi"))
        left = materialize(left.join(done, ["name", "provinces"], "left_anti"))
    own = blocking.numbered(left.withColumn("_all", F.lit(0)), "_l")
    near = blocking.in_blocks(own.withColumnRenamed("name", "a"), heads.select(F.lit(0).alias("_all"), "_r", F.col("name").alias("b"), "provinces"), "_all", kind, least, most)
    near = near.join(own.select("_l", "name", "provinces"), "_l").join(heads.select("_r", "ids"), "_r")
    found.append(top(near.select("name", "provinces", F.explode("ids").alias("id"), "score"), ["name", "provinces"], [F.col("score").desc(), F.col("id")], most))
    matches = reduce(DataFrame.unionByName, found)
    return named.join(matches, ["name", "provinces"]).select(F.col("company_id").alias("query_id"), "id", "score", "rank")
