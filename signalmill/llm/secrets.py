"""Operator 4: secret scans by corpus-wide ownership frequency.

Patterns give candidates: the base ones always stay, the others are kept if they
look live. Every candidate's value is hashed; per hash the distinct repositories
and owners of the whole corpus are counted. A value that more than
``max_owners`` owners hold is a copied example (documentation, licence keys, test
vectors); one that few hold and that mixes characters like a generated key is
live.

All of it is DataFrame functions: matches and the gaps between them come from
the JVM's regular expressions, and their lengths, summed along the text, give
the positions.

``documents`` has no owner column: the owner is ``source``, a repository is a
source's part in one language. Both are parameters.

Defined results: a null text counts as empty; a null owner or repository counts
as one unknown owner; texts of any length are scanned whole; repeated rows each
give a row, and a value's owners count once; an empty table gives an empty
result; other columns are ignored; a null key stays null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from signalmill.llm.common import materialize, spare, table, text_or_empty

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "token", "quoted")
# Patterns of the base spans, then of the added ones. A run that
# is too short to count can't hold a longer match, so hex asks for its length at
# once; the others are matched first and then measured.
_EITHER = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
ASSIGN = "(" + "|".join(map(_EITHER, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERN = {
    "assign": ASSIGN,
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]{32,}",
    "token": r"(?<![A-Za-z0-9_])(?:gh[pousr]_[A-Za-z0-9]{20,}|xox[baprs]-[A-Za-z0-9-]{10,}|sk_(?:live|test)_[A-Za-z0-9]{10,}|AIza[A-Za-z0-9_-]{30,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})",
    "quoted": r"""["'][A-Za-z0-9+/_=-]{20,}["']""",
}
#: Literals without which a pattern can't match; a search for them is cheaper.
HINTS = {"assign": ("password", "passwd", "secret", "token", "apikey", "api_key"), "access": ("AKIA",), "hex": (), "token": ("gh", "xox", "sk_", "AIza", "eyJ"), "quoted": ()}
MAX_OWNERS = 2
#: Texts with credentials to replace up to which their places are broadcast: some
#: hundred bytes each.
FEW = 200_000
LEAST = {"assign": 8, "access": 16, "hex": 32, "token": 16, "quoted": 22}


def _may_match(text: Column, kind: str) -> Column:
    there = F.lower(text) if kind == "assign" else text
    hint = F.lit(not HINTS[kind])
    for word in HINTS[kind]:
        hint = hint | F.contains(there, F.lit(word))
    return hint & text.rlike(PATTERN[kind])


def _matches(text: Column, kind: str) -> Column:
    """array<struct<kind, place, gap, hit>>: gap is the length of the text since
    the match before; null if there is no match."""
    gaps, hits = F.split(text, PATTERN[kind], -1), F.regexp_extract_all(text, F.lit(PATTERN[kind]), F.lit(0))
    pairs = F.filter(F.zip_with(gaps, hits, lambda gap, hit: F.struct(F.length(gap).alias("gap"), hit.alias("hit"))), lambda p: p["hit"].isNotNull())
    zipped = F.transform(pairs, lambda p, i: F.struct(F.lit(KINDS.index(kind)).alias("kind"), i.alias("place"), p["gap"].alias("gap"), p["hit"].alias("hit")))
    return F.when(_may_match(text, kind), zipped)


def _value(kind: Column, hit: Column) -> Column:
    """What is compared between documents: the credential without its name or quotes."""
    return F.when(kind == KINDS.index("assign"), F.regexp_extract(hit, ASSIGN, 2)).when(kind == KINDS.index("quoted"), F.expr("substring(hit, 2, length(hit) - 2)")).otherwise(hit)


def _looks_live(value: Column) -> Column:
    """Letters and digits mixed, and at least 8 different characters in the whole value."""
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= 8)


def scan(df: DataFrame, key: str = "doc_id", text_column: str = "text", owner: Column | None = None, repository: Column | None = None, named=None) -> DataFrame:
    """(row, key, owner, repository, hits), written once: the only pass over the
    texts; with ``named`` also a name made of the text."""
    unknown = F.lit("")
    owner = F.coalesce((F.col("source") if owner is None else owner).cast("string"), unknown)
    repository = F.coalesce((F.concat_ws("/", "source", "lang") if repository is None else repository).cast("string"), unknown)
    text = F.col("text")
    hits = F.concat(*[F.coalesce(_matches(text, k), F.array().cast("array<struct<kind:int,place:int,gap:int,hit:string>>")) for k in KINDS])
    name = named(text_or_empty(text_column)) if named else F.lit(None).cast("string")
    rows = df.select(F.col(key).cast("long").alias("key"), owner.alias("owner"), repository.alias("repository"), name.alias("name"), text_or_empty(text_column).alias("text"))
    return materialize(rows.select(F.monotonically_increasing_id().alias("row"), "key", "owner", "repository", "name", hits.alias("hits")))


def spans(scanned: DataFrame, max_owners: int = MAX_OWNERS) -> DataFrame:
    """(row, kind, start, end, value_hash, owners, repositories, live, owned), one
    for each span. ``owned`` is what redaction goes by: base spans whose value few
    owners hold, whatever it looks like, and added ones that are live.

    Values are hashed before they are shuffled. Owners are counted by distinct
    (hash, owner, repository) first, so a value in a third of the rows is summed
    where it lies; the counts join back by a join that Spark can split.
    """
    each = scanned.where(F.size("hits") > 0).select("row", "owner", "repository", F.explode("hits").alias("h")).select("row", "owner", "repository", "h.*")
    along = W.partitionBy("row", "kind").orderBy("place")
    end = F.sum(F.col("gap") + F.length("hit")).over(along.rowsBetween(W.unboundedPreceding, 0))
    value = _value(F.col("kind"), F.col("hit"))
    measured = F.when(F.col("kind") == 0, F.length("value")).otherwise(F.length("hit"))
    enough = F.element_at(F.array(*[F.lit(LEAST[k]) for k in KINDS]), F.col("kind") + 1)
    placed = each.withColumn("end", end).withColumn("value", value).where(measured >= enough)
    hashed = placed.select("row", "kind", (F.col("end") - F.length("hit")).alias("start"), "end", F.xxhash64("value").alias("value_hash"), F.length("value").alias("value_length"), _looks_live(F.col("value")).alias("mixed"), "owner", "repository")
    held = hashed.select("value_hash", "owner", "repository").distinct().groupBy("value_hash").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repository").alias("repositories"))
    few = F.col("owners") <= max_owners
    return hashed.join(held, "value_hash").select("row", "kind", "start", "end", "value_hash", "value_length", "owners", "repositories", (F.col("mixed") & few).alias("live"), ((F.col("mixed") | (F.col("kind") < len(BASE_KINDS))) & few).alias("owned"))


def find_secrets(df: DataFrame, key: str = "doc_id", text_column: str = "text", owner: Column | None = None, repository: Column | None = None, max_owners: int = MAX_OWNERS) -> DataFrame:
    """(key, spans): spans by start, then kind, as structs of start, kind, end,
    base, live, owners, repositories and value_hash. Base spans all stay; others
    only if live."""
    scanned = scan(df, key, text_column, owner, repository)
    kept = spans(scanned, max_owners).withColumn("base", F.col("kind") < len(BASE_KINDS)).where("base or live")
    grouped = kept.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "base", "live", "owners", "repositories", "value_hash"))).alias("spans"))
    none = F.array().cast(grouped.schema["spans"].dataType)
    return scanned.select("row", "key").join(grouped, "row", "left").select(F.col("key").alias(key), F.coalesce("spans", none).alias("spans"))


def redact(df: DataFrame, text_column: str = "text", key: str = "doc_id", mark: str = "<SECRET>", max_owners: int = MAX_OWNERS, few: int = FEW) -> DataFrame:
    """The rows with credentials that few owners hold replaced in the text; the
    columns stay.

    The patterns run once over each text. What is left to replace are places:
    those of the credentials (of an assignment its value), joined to the rows by
    key and text. Up to ``few`` texts they are broadcast, so that no text moves;
    beyond, rows without a candidate are passed on and the others are joined.
    """
    text, named, places = F.coalesce(F.col(text_column), F.lit("")), spare(df, "_holder"), spare(df, "_secret")
    name = lambda key_column, t: F.concat_ws("/", F.coalesce(key_column.cast("long").cast("string"), F.lit("none")), F.xxhash64(t).cast("string"), F.length(t).cast("string"))
    scanned = scan(df, key, text_column, named=lambda t: name(F.col(key), t))
    owned = spans(scanned, max_owners).where("owned").join(scanned.select("row", "name"), "row")
    cut = F.struct(F.when(F.col("kind") == KINDS.index("assign"), F.col("end") - F.col("value_length")).otherwise(F.col("start")).alias("start"), "end")
    lists = materialize(owned.groupBy(F.col("name").alias(named)).agg(F.array_sort(F.collect_set(cut)).alias(places)))
    met = lambda rows, found: rows.withColumn(named, name(F.col(key), text)).join(found, named, "left").drop(named)
    changed = F.when(F.col(places).isNotNull(), _without(F.col(text_column), F.col(places), mark)).otherwise(F.col(text_column))
    if lists.count() <= few:
        return met(df, F.broadcast(lists)).withColumn(text_column, changed).drop(places)
    some = F.lit(False)
    for kind in KINDS:
        some = some | _may_match(text, kind)
    return df.where(~some).unionByName(met(df.where(some), lists).withColumn(text_column, changed).drop(places))


def _without(text: Column, places: Column, mark: str) -> Column:
    """The text with sorted places replaced by the mark; overlapping ones are one."""
    start = F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("at"))
    begin = lambda a, p: F.greatest(a["at"], p["start"])
    piece = lambda a, p: F.substring(text, (a["at"] + 1).cast("int"), F.greatest(F.lit(0), begin(a, p) - a["at"]).cast("int"))
    step = lambda a, p: F.when(p["end"] <= a["at"], a).otherwise(F.struct(F.concat(a["text"], piece(a, p), F.when(p["start"] >= a["at"], F.lit(mark)).otherwise(F.lit(""))).alias("text"), F.greatest(a["at"], p["end"]).cast("long").alias("at")))
    return F.aggregate(places, start, step, lambda a: F.concat(a["text"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text))))


def spelled(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    of_kind = lambda i: F.filter("spans", lambda s: s["kind"] == i)
    counts = [F.size(of_kind(i)).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE_KINDS)]
    live = F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live")
    copied = F.size(F.filter("spans", lambda s: s["owners"] > MAX_OWNERS)).cast("long").alias("n_copied")
    return found.select("doc_id", *counts, F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"), live, copied)


def _sql() -> str:
    """The same as one statement. SQL's patterns know no look-behind; a word
    boundary stands for it, which is the same before a letter."""
    pattern = {k: "'" + PATTERN[k].replace("(?<![A-Za-z0-9_])", r"\b").replace("'", "''") + "'" for k in KINDS}
    each = " UNION ALL ".join(f"SELECT r, owner, {i} AS kind, string_split_regex(t, {p}) AS gaps, regexp_extract_all(t, {p}) AS hits FROM d WHERE regexp_matches(t, {p})" for i, p in enumerate(pattern.values()))
    value = f"CASE kind WHEN 0 THEN regexp_extract(hit, {pattern['assign']}, 2) WHEN 4 THEN substr(hit, 2, length(hit) - 2) ELSE hit END"
    least = "CASE kind " + " ".join(f"WHEN {i} THEN {LEAST[k]}" for i, k in enumerate(KINDS)) + " END"
    name = "CASE kind " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS)) + " END"
    listed = "coalesce(string_agg({what}, ',' ORDER BY start, kind), '')"
    return f"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, coalesce(source, '') AS owner, coalesce(text, '') AS t FROM documents),
found AS ({each}),
placed AS (SELECT r, owner, kind, gaps, hits, unnest(range(1, len(hits) + 1)) AS i FROM found),
told AS (SELECT r, owner, kind, hits[i] AS hit, sum(length(gaps[i]) + length(hits[i])) OVER (PARTITION BY r, kind ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stop FROM placed),
valued AS (SELECT *, {value} AS value FROM told),
large AS (SELECT r, owner, kind, CAST(stop - length(hit) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, value FROM valued WHERE (CASE WHEN kind = 0 THEN length(value) ELSE length(hit) END) >= {least}),
held AS (SELECT value, count(DISTINCT owner) AS owners FROM large GROUP BY value),
judged AS (SELECT l.*, h.owners, h.owners <= {MAX_OWNERS} AND regexp_matches(l.value, '[0-9]') AND regexp_matches(l.value, '[A-Za-z]') AND len(list_distinct(string_split(l.value, ''))) >= 8 AS live FROM large l JOIN held h ON l.value = h.value),
kept AS (SELECT *, concat({name}, ':', start, ':', stop) AS span FROM judged WHERE kind < 3 OR live),
spans AS (
  SELECT r, count(CASE WHEN kind = 0 THEN 1 END) AS n_assign, count(CASE WHEN kind = 1 THEN 1 END) AS n_access, count(CASE WHEN kind = 2 THEN 1 END) AS n_hex,
         count(CASE WHEN live THEN 1 END) AS n_live, count(CASE WHEN owners > {MAX_OWNERS} THEN 1 END) AS n_copied, {listed.format(what="span")} AS spans, {listed.format(what="CASE WHEN kind < 3 THEN span END")} AS base
  FROM kept GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM d LEFT JOIN spans s ON d.r = s.r
"""


SQL = _sql()
