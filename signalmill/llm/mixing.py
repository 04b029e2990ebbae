"""Operator 5: mixing sources to target weights by hierarchical budgeting.

A tree of domains, languages and sources has a weight at every node. The token
budget goes down from the root: siblings share what their parent has in
proportion to their weights, none beyond its capacity (its tokens times the
epochs allowed). What a sibling can't use goes to the others; only what no
sibling can use is missing at the parent, whose own siblings then share it, and
so on up. Each leaf has its documents in an order of its own for every epoch,
drawn from a seed; whole epochs come first, and the last one gives the prefix
whose tokens fill the leaf's budget, its last document cut.

All of it is DataFrame functions. The shares among siblings have a closed form:
with siblings by capacity per weight, the water level is the greatest of the
levels that hold if the first ones are full. A leaf's prefix is found by sums:
tokens by ``BUCKETS`` parts of the order first, then a running sum within the
one part where the prefix ends. So no leaf is ever gathered or sorted whole, and
texts don't travel.

``documents`` has no domain: it is a parameter, as are the weights, the budget
and the measure of tokens (a quarter of the UTF-8 bytes, rounded up).

Defined results: null domains, languages and sources are nodes of empty name; a
null or empty text has no tokens and isn't selected; a node without a weight of
its own has its level's default; with weight 0 it gets nothing; rows of equal key
stand at one place of the order, and if the prefix ends there each is cut to what
is left before it; a null key stands as an empty one; an empty table or budget gives an empty result; other
columns are ignored by :func:`mix` and kept by :func:`apply_mix`.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from signalmill.llm.common import materialize, table

LEVELS = ("domain", "language", "origin")
BUCKETS = 4096
#: The leaves' table, some 300 bytes for each, is broadcast up to so many.
FEW_LEAVES = 50_000


@dataclass(frozen=True)
class Weights:
    """Integer weights by level and name, and each level's default."""

    domain: dict[str, int] = field(default_factory=dict)
    language: dict[str, int] = field(default_factory=dict)
    origin: dict[str, int] = field(default_factory=dict)
    default: int = 10

    def of(self, level: str) -> Column:
        named = getattr(self, level)
        if not named:
            return F.lit(self.default).cast("long")
        known = F.create_map(*[F.lit(x) for pair in named.items() for x in pair])
        return F.coalesce(F.element_at(known, F.col(level)), F.lit(self.default)).cast("long")


#: Weights of the registered query and of the pipeline.
WEIGHTS = Weights(domain={"a": 30, "b": 20}, language={"en": 50, "fr": 20, "de": 20})
SEED, EPOCHS, PERCENT = 17, 2, 60


def domain_of_source() -> Column:
    """A stand-in for the domain that ``documents`` lacks: four groups of sources
    by the first digit of their hash."""
    return F.translate(F.substring(F.md5(F.coalesce("source", F.lit(""))), 1, 1), "0123456789abcdef", "aaaabbbbccccdddd")


def byte_tokens(text_column: str = "text") -> Column:
    return F.ceil(F.octet_length(F.coalesce(F.col(text_column), F.lit(""))) / 4).cast("long")


def _leaf_columns(domain: Column | None, language: str, origin: str) -> list[Column]:
    empty = F.lit("")
    domain = domain_of_source() if domain is None else domain
    return [F.coalesce(domain.cast("string"), empty).alias("domain"), F.coalesce(F.col(language).cast("string"), empty).alias("language"), F.coalesce(F.col(origin).cast("string"), empty).alias("origin")]


def place(seed: int, epoch: Column, key: Column) -> Column:
    """Where a key stands in an epoch's order: a hash, then the key itself."""
    key = F.coalesce(key.cast("string"), F.lit(""))
    return F.concat_ws(":", F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), key)), key)


def _shared(nodes: DataFrame, weights: Weights, level: str, parent: list[str]) -> DataFrame:
    """``nodes`` has capacity and what its parent has (``given``); adds its own
    ``budget``: given tokens rise to one water level among siblings."""
    weight = weights.of(level)
    usable = nodes.withColumn("weight", weight).withColumn("usable", F.when(weight > 0, F.col("capacity")).otherwise(0))
    siblings = W.partitionBy(*parent)
    order = siblings.orderBy((F.col("usable") / F.col("weight")).asc_nulls_last(), level)
    before = F.coalesce(F.sum("usable").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    others = F.sum("weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    level_here = F.when(others > 0, (F.col("given") - before) / others)
    water = F.max("level_here").over(siblings)
    poured = F.floor(F.col("weight") * F.col("water")).cast("long")
    return usable.withColumn("level_here", level_here).withColumn("water", water).withColumn("budget", F.greatest(F.lit(0), F.least("usable", F.coalesce(poured, F.lit(0))))).drop("level_here", "water", "usable", "weight")


def budgets(leaves: DataFrame, weights: Weights, epochs: int, budget: Column) -> DataFrame:
    """``leaves`` has the LEVELS and tokens; adds ``budget``, whole tokens. The
    column ``budget`` is given in terms of ``tokens``, the sum over all leaves.

    Capacities are summed up the tree (a node with weight 0 adds none), budgets
    flow down. The tree has a row for each leaf; windows see one node's children.
    """
    able = F.when((weights.of("domain") > 0) & (weights.of("language") > 0) & (weights.of("origin") > 0), F.col("tokens") * epochs).otherwise(0)
    sized = leaves.withColumn("capacity", able.cast("long"))
    by_language = sized.groupBy("domain", "language").agg(F.sum("capacity").alias("capacity"))
    by_domain = by_language.groupBy("domain").agg(F.sum("capacity").alias("capacity"))
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).select(budget.cast("long").alias("given"))
    # The totals are one row; so each domain gets it by a join on a constant.
    top = by_domain.withColumn("root", F.lit(0)).join(F.broadcast(total.withColumn("root", F.lit(0))), "root")
    top = _shared(top, weights, "domain", ["root"]).select("domain", F.col("budget").alias("given"))
    middle = _shared(by_language.join(top, "domain"), weights, "language", ["domain"]).select("domain", "language", F.col("budget").alias("given"))
    return _shared(sized.join(middle, ["domain", "language"]), weights, "origin", ["domain", "language"]).drop("given", "capacity")


def plan(df: DataFrame, weights: Weights = WEIGHTS, epochs: int = EPOCHS, percent: int = PERCENT, seed: int = SEED, key: str = "doc_id", domain: Column | None = None, language: str = "lang", origin: str = "source", tokens: Column | None = None, budget: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The measured rows (key, LEVELS, tokens) and what each leaf gives, both
    written once: leaf, tokens, budget, whole (epochs taken whole), and where the
    prefix of the epoch after those ends (``last``) and begins to be cut
    (``before``). ``budget`` is in tokens; if None, ``percent`` of the corpus."""
    measure = byte_tokens() if tokens is None else tokens
    rows = materialize(df.select(F.col(key).alias("key"), *_leaf_columns(domain, language, origin), F.coalesce(measure, F.lit(0)).cast("long").alias("tokens")).where("tokens > 0"))
    leaves = rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    asked = F.floor(F.col("tokens") * percent / 100) if budget is None else F.lit(budget)
    shares = budgets(leaves, weights, epochs, asked).withColumn("whole", F.floor(F.col("budget") / F.col("tokens")).cast("int"))
    shares = materialize(shares.withColumn("need", F.col("budget") - F.col("whole") * F.col("tokens")))
    # Where the prefix ends: the part of the order first, then the place in it.
    placed = rows.join(shares.where("need > 0").select(*LEVELS, "whole", "need"), list(LEVELS)).select(*LEVELS, "need", "tokens", place(seed, F.col("whole"), F.col("key")).alias("place"))
    placed = placed.withColumn("bucket", F.conv(F.substring("place", 1, 3), 16, 10).cast("int"))
    parts = placed.groupBy(*LEVELS, "need", "bucket").agg(F.sum("tokens").alias("held"))
    running = F.sum("held").over(W.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow))
    ends = parts.withColumn("after", running).where((F.col("after") >= F.col("need")) & (F.col("after") - F.col("held") < F.col("need")))
    ends = ends.select(*LEVELS, "bucket", (F.col("after") - F.col("held")).alias("base"))
    inside = placed.join(ends, [*LEVELS, "bucket"]).groupBy(*LEVELS, "need", "base", "place").agg(F.sum("tokens").alias("held"))
    upto = F.sum("held").over(W.partitionBy(*LEVELS).orderBy("place").rowsBetween(W.unboundedPreceding, W.currentRow))
    before = F.col("base") + F.col("upto") - F.col("held")
    last = inside.withColumn("upto", upto).withColumn("before", before).where((F.col("before") < F.col("need")) & (F.col("before") + F.col("held") >= F.col("need")))
    return rows, materialize(shares.join(last.select(*LEVELS, F.col("place").alias("last"), "before"), list(LEVELS), "left"))


def _epochs(rows: DataFrame, leaves: DataFrame, seed: int) -> DataFrame:
    """Rows of LEVELS, key and tokens, once for each epoch that takes them."""
    told = leaves.where("budget > 0").select(*LEVELS, "whole", "need", "last", "before")
    if leaves.count() <= FEW_LEAVES:  # beyond that Spark shuffles, and splits hot leaves
        told = F.broadcast(told)
    where = place(seed, F.col("whole"), F.col("key"))
    known = rows.join(told, list(LEVELS)).withColumn("place", F.when(F.col("last").isNotNull(), where))
    times = F.col("whole") + F.when(F.col("place") <= F.col("last"), 1).otherwise(0)
    each = known.where(times > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), times - 1)))
    cut = (F.col("epoch") == F.col("whole")) & (F.col("place") == F.col("last"))
    return each.withColumn("taken", F.when(cut, F.least("tokens", F.col("need") - F.col("before"))).otherwise(F.col("tokens"))).drop("whole", "need", "last", "before", "place")


def mix(df: DataFrame, seed: int = SEED, key: str = "doc_id", **options) -> DataFrame:
    """(key, domain, language, origin, epoch, tokens, taken): a row for each time
    that a document is taken; ``taken`` is less than ``tokens`` only where a
    leaf's prefix ends."""
    rows, leaves = plan(df, seed=seed, key=key, **options)
    return _epochs(rows, leaves, seed).select(F.col("key").alias(key), *LEVELS, F.col("epoch").cast("int").alias("epoch"), "tokens", "taken")


def apply_mix(df: DataFrame, seed: int = SEED, key: str = "doc_id", domain: Column | None = None, language: str = "lang", origin: str = "source", tokens: Column | None = None, **options) -> DataFrame:
    """The documents taken, whole and with their own columns, once for each epoch
    that takes them. Rows meet a row for each leaf; texts aren't shuffled if the
    leaves are counted to be few."""
    _, leaves = plan(df, seed=seed, key=key, domain=domain, language=language, origin=origin, tokens=tokens, **options)
    measure = byte_tokens() if tokens is None else tokens
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("whole_row")
    rows = df.select(whole, F.col(key).alias("key"), *_leaf_columns(domain, language, origin), F.coalesce(measure, F.lit(0)).cast("long").alias("tokens")).where("tokens > 0")
    return _epochs(rows, leaves, seed).select("whole_row.*")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


_LEVEL = """
{name}_level AS (
  SELECT *, sum(usable) OVER (PARTITION BY {parent} ORDER BY usable / nullif(weight, 0) NULLS LAST, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - usable AS before,
         sum(weight) OVER (PARTITION BY {parent} ORDER BY usable / nullif(weight, 0) NULLS LAST, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS others
  FROM {name}),
{name}_water AS (
  SELECT *, max(CASE WHEN others > 0 THEN (given - before) / others END) OVER (PARTITION BY {parent}) AS water FROM {name}_level),
{name}_budget AS (
  SELECT *, greatest(0, least(usable, CAST(floor(weight * water) AS BIGINT))) AS budget FROM {name}_water)"""


def _sql() -> str:
    """The same in one plain statement: each leaf's order is one whole window."""

    def weight(level: str) -> str:
        named = getattr(WEIGHTS, level)
        cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in named.items())
        return f"CASE {level} {cases} ELSE {WEIGHTS.default} END" if cases else str(WEIGHTS.default)

    level = lambda name, of, parent: _LEVEL.format(name=name, level=of, parent=parent)
    return f"""
WITH rows_ AS (
  SELECT doc_id, translate(substr(md5(coalesce(source, '')), 1, 1), '0123456789abcdef', 'aaaabbbbccccdddd') AS domain,
         coalesce(lang, '') AS language, coalesce(source, '') AS origin,
         CAST(ceil(strlen(coalesce(text, '')) / 4) AS BIGINT) AS tokens
  FROM documents WHERE strlen(coalesce(text, '')) > 0),
leaves AS (SELECT domain, language, origin, CAST(sum(tokens) AS BIGINT) AS tokens FROM rows_ GROUP BY domain, language, origin),
top AS (SELECT domain, {weight("domain")} AS weight, CAST(sum(tokens) * {EPOCHS} AS BIGINT) AS usable,
        (SELECT CAST(floor(sum(tokens) * {PERCENT} / 100) AS BIGINT) FROM leaves) AS given, 0 AS root FROM leaves GROUP BY domain),
{level("top", "domain", "root").strip()},
middle AS (SELECT l.domain, l.language, {weight("language")} AS weight, CAST(sum(l.tokens) * {EPOCHS} AS BIGINT) AS usable, min(b.budget) AS given
           FROM leaves l JOIN top_budget b ON l.domain = b.domain GROUP BY l.domain, l.language),
{level("middle", "language", "domain").strip()},
bottom AS (SELECT l.domain, l.language, l.origin, {weight("origin")} AS weight, l.tokens, l.tokens * {EPOCHS} AS usable, b.budget AS given
           FROM leaves l JOIN middle_budget b ON l.domain = b.domain AND l.language = b.language),
{level("bottom", "origin", "domain, language").strip()},
epochs AS (SELECT unnest(range({EPOCHS})) AS epoch),
ordered AS (
  SELECT r.doc_id, r.domain, r.language, r.origin, CAST(e.epoch AS INTEGER) AS epoch, r.tokens, b.budget - e.epoch * b.tokens AS need,
         sum(r.tokens) OVER (PARTITION BY r.domain, r.language, r.origin, e.epoch
           ORDER BY md5(concat('{SEED}:', e.epoch, ':', r.doc_id)), r.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - r.tokens AS before
  FROM rows_ r JOIN bottom_budget b ON r.domain = b.domain AND r.language = b.language AND r.origin = b.origin CROSS JOIN epochs e)
SELECT doc_id, domain, language, origin, epoch, tokens, CAST(least(tokens, need - before) AS BIGINT) AS taken FROM ordered WHERE before < need
"""


SQL = _sql()
