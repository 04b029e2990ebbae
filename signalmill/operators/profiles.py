"""Profiles, plans, catalogues and messages around the scores."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalmill.functions.text import amount, normalise
from signalmill.operators.blocking import in_tiles
from signalmill.operators.relational import top
from signalmill.operators.storage import materialize

# Plans from the least to the greatest, and days.
PLANS = ("basic", "plus", "full")
STALE_DAYS, ABANDON_DAYS = 30, 45


def plan_allows(plan: Column, least: Column) -> Column:
    """Whether a plan is the least one or greater; unknown plans allow nothing."""
    place = F.create_map(*[F.lit(x) for i, p in enumerate(PLANS) for x in (p, i)])
    return F.coalesce(place[plan] >= place[least], F.lit(False))


def allowed_fields(fields: Column, allowed: Column) -> Column:
    """The map's entries whose keys a rule (array) allows; all without a rule."""
    return F.when(allowed.isNull(), fields).otherwise(F.map_filter(fields, lambda k, v: F.array_contains(allowed, k)))


def verification(has_name: Column, struck_off: Column, active: Column) -> Column:
    """The first exclusion of a company, in order, or ``passes``."""
    return F.when(~F.coalesce(has_name, F.lit(False)), "no identity").when(F.coalesce(struck_off, F.lit(False)), "struck off").when(F.coalesce(~active, F.lit(False)), "inactive").otherwise("passes")


def subscribed(unsubscribed_at: Column, suspended: Column) -> Column:
    return unsubscribed_at.isNull() & ~F.coalesce(suspended, F.lit(False))


def in_scope(city: Column, region: Column, scope: Column, is_admin: Column) -> Column:
    """An administrator sees all; others their own territory, if they have one."""
    same = lambda c: F.coalesce(F.lower(F.trim(c)) == F.lower(F.trim(scope)), F.lit(False))
    return is_admin | scope.isNull() | same(city) | same(region)


def overridden(values: DataFrame, defaults: dict[str, float], plan: str = "plan") -> DataFrame:
    """Each weight of the greatest plan's profiles replaces its default where given."""
    own = F.col(plan) == PLANS[-1]
    return values.withColumns({k: F.coalesce(F.when(own, F.col(k)), F.lit(v)) for k, v in defaults.items()})


def active_channels(channels: DataFrame) -> DataFrame:
    """Channels in use by their priority; of equal ones by their id."""
    return channels.where("active").orderBy("priority", "channel")


def client_categories(companies: DataFrame, synonyms: DataFrame, k: int = 3) -> DataFrame:
    """(company_id, category, hits, rank): categories of client by the sector's
    label, for companies that have one."""
    named = companies.where("sector is not null").select(F.col("company_id").alias("text_id"), F.col("sector").alias("text"))
    return suggestions(named, synonyms, k).withColumnRenamed("text_id", "company_id")


def new_synonyms(known: DataFrame, fresh: DataFrame) -> DataFrame:
    """Synonyms (category, synonym) that the category lacks in any case; per cent
    signs and underscores stand for themselves, and of equal ones the first in
    order stays."""
    key = lambda: F.lower(F.trim("synonym"))
    missing = fresh.withColumn("_key", key()).join(known.select("category", key().alias("_key")).distinct(), ["category", "_key"], "left_anti")
    return top(missing, ["category", "_key"], [F.col("synonym")], 1, "_rank").select("category", "synonym")


def dashboard(notes: DataFrame, usage: str | None = None, territory: str | None = None, scope: str | None = None) -> DataFrame:
    """Notifications (created_at, usage, city, region, off_profile) as a user sees
    them: by a part of the usage, a territory that is the city or region, and the
    user's own scope; on profile first, then the newest."""
    same = lambda c, v: F.coalesce(F.lower(F.trim(c)) == v.strip().lower(), F.lit(False))
    kept = notes
    if usage:
        kept = kept.where(F.contains(F.lower("usage"), F.lit(usage.lower())))
    for place in (territory, scope):
        if place:
            kept = kept.where(same("city", place) | same("region", place))
    return kept.orderBy("off_profile", F.desc("created_at"))


def stale(enriched_at: Column, as_of: datetime, days: int = STALE_DAYS) -> Column:
    """Whether an enrichment is missing or too old."""
    return enriched_at.isNull() | (enriched_at < F.lit(as_of) - F.make_dt_interval(F.lit(days)))


def run_outcome(started: Column, ended: Column, as_of: datetime, hours: int) -> Column:
    """closed, running, or interrupted if open for too long; undecided without a start."""
    late = started < F.lit(as_of) - F.make_dt_interval(hours=F.lit(hours))
    return F.when(ended.isNotNull(), "closed").when(started.isNull(), "undecided").when(late, "interrupted").otherwise("running")


def dominant_signal(signals: DataFrame, score: str = "base") -> DataFrame:
    """The signal of greatest score of each company, ties to the smaller id."""
    return top(signals, ["company_id"], [F.desc(score), F.col("signal_id")], 1).drop("rank")


def suggestions(texts: DataFrame, synonyms: DataFrame, k: int = 3) -> DataFrame:
    """(text_id, category, hits, rank): categories by how many of their synonyms a
    text has as whole words, up to k. ``synonyms`` is a catalogue (category,
    synonym); words meet it by an equi-join on the synonym's first word."""
    plain = texts.select("text_id", normalise(F.col("text")).alias("plain"))
    spoken = plain.select("text_id", "plain", F.explode(F.array_distinct(F.split("plain", " "))).alias("first"))
    known = synonyms.select("category", normalise(F.col("synonym")).alias("synonym")).distinct().withColumn("first", F.substring_index("synonym", " ", 1))
    whole = F.contains(F.concat(F.lit(" "), "plain", F.lit(" ")), F.concat(F.lit(" "), "synonym", F.lit(" ")))
    hits = spoken.join(known, "first").where(whole).groupBy("text_id", "category").agg(F.count_distinct("synonym").alias("hits"))
    return top(hits, ["text_id"], [F.desc("hits"), F.col("category")], k)


def best_city(signals: DataFrame) -> DataFrame:
    """(company_id, city, source, variants): the city of the best source (least
    ``source_rank``), ties by name, with all spellings."""
    there = signals.where("city is not null and trim(city) <> ''")
    first = F.min(F.struct("source_rank", "city", "source"))
    return there.groupBy("company_id").agg(first.alias("_b"), F.array_sort(F.collect_set("city")).alias("variants")).select("company_id", "_b.city", "_b.source", "variants")


def overlapping_directories(directory: DataFrame, names: DataFrame, separator: str = "//") -> DataFrame:
    """(id, entry): names found in a directory whose cells may hold several. Ids of
    the same names and entries of the same names meet as one, and are dealt out in
    tiles; each is in one class only, so no pair comes twice."""
    each = directory.select("entry", F.explode(F.split("names", separator)).alias("name")).select("entry", normalise(F.col("name")).alias("name")).where("name <> ''")
    own = materialize(names.where("name is not null").groupBy("id").agg(F.array_sort(F.collect_set("name")).alias("_own")))
    theirs = materialize(each.groupBy("entry").agg(F.array_sort(F.collect_set("name")).alias("_theirs")))
    classes = lambda rows, c: rows.select(c).distinct().withColumn("name", F.explode(c)).hint("merge")
    links = classes(own, "_own").join(classes(theirs, "_theirs"), "name").select("_own", "_theirs").distinct()
    return in_tiles(materialize(own.join(links, "_own").select("id", "_theirs")), theirs, "_theirs", "id", "entry", 4096).select("id", "entry")


def reason(kind: Column, value: Column, keywords: Column) -> Column:
    """Why a company was found, with the keywords if there are any."""
    shown = F.when(value > 0, F.concat(F.lit(" of "), amount(value))).otherwise(F.lit(""))
    words = F.when(F.size(keywords) > 0, F.concat(F.lit(" ("), F.array_join(keywords, ", "), F.lit(")"))).otherwise(F.lit(""))
    return F.concat(kind, shown, words)


def opening(kind: Column, name: Column, value: Column) -> Column:
    """A sentence to begin a first contact with, by the signal's type."""
    said = F.when(kind == "tender", F.format_string("%s has just won a contract", name)).when(kind == "financing", F.format_string("%s has just been financed", name)).when(kind == "hiring", F.format_string("%s is hiring", name)).when(kind == "registry", F.format_string("%s is opening or moving", name)).when(kind == "ranking", F.format_string("%s is among the fastest growing", name)).otherwise(F.format_string("%s shows signs of growth", name))
    return F.concat(said, F.when((value > 0) & kind.isin("tender", "financing"), F.concat(F.lit(": "), amount(value))).otherwise(F.lit("")), F.lit("."))


def pages_to_visit(links: DataFrame, categories: dict[str, str], most: int = 6) -> DataFrame:
    """(site, url, category): of each site the first page of each category, links
    of the same host only, up to ``most``; of links at the same place (a site may
    have several pages) the first url. ``links`` has (site, place, url);
    categories are patterns of paths."""
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(categories.items()):
        kind = F.when(F.col("url").rlike(f"(?i){pattern}"), name).otherwise(kind)
    host = lambda c: F.coalesce(F.regexp_extract(c, r"^https?://(?:www\.)?([^/]+)", 1), F.lit(""))
    own = (host(F.col("url")) == "") | (host(F.col("url")) == host(F.col("site")))
    first = top(links.where(own).withColumn("category", kind).where("category is not null"), ["site", "category"], [F.col("place"), F.col("url")], 1).drop("rank")
    return top(first, ["site"], [F.col("place"), F.col("url")], most).select("site", "url", "category")
