"""Dossiers found, created, given ids and undone; replays and ceilings."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalmill.operators import blocking, dedup, diff, dossiers, profiles, relevance, reports, resolution
from signalmill.operators.relational import top
from signalmill.operators.storage import materialize
from signalmill.plans.names import _RANKED
from signalmill.plans.views import EDIT_SCORE, NAMES, SIGNALS, SNAPSHOTS, Query, cities, dirty_names, edit_score, orders_after, orders_before, registry_names, signals, table


def _edits(a, b, city_a, city_b):
    return dedup.pair_score(a, b, city_a, city_b, edit_score)


def _companies(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("company_id"))
    n = registry_names(spark, sf_dir).select(F.col("id").alias("company_id"), "name")
    return s.join(n, "company_id").select("company_id", F.when(F.col("company_id") % 3 == 0, F.concat(F.lit("N"), F.col("company_id").cast("string"))).alias("id"), "name", F.concat(F.lit("city"), (F.col("company_id") % 5).cast("string")).alias("city"))


def _raw(spark, sf_dir):
    """Signals of customers under the names of suppliers' dossiers, some altered."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(k.alias("signal_id"), (F.col("c_nationkey") + 1).alias("of"), "c_mktsegment")
    n = registry_names(spark, sf_dir).select(F.col("id").alias("of"), "name")
    s = F.col("signal_id")
    name = F.concat("name", F.when(s % 16 == 4, F.lit("xyz")).when(s % 4 == 1, F.lit("s")).when(s % 4 == 3, F.concat(F.lit(" of "), F.lower("c_mktsegment"))).otherwise(F.lit("")))
    given = F.when(s % 4 == 2, F.concat(F.lit("N"), F.col("of").cast("string")))
    raw = c.join(n, "of").select("signal_id", "of", name.alias("name"), F.concat(F.lit("city"), (s % 5).cast("string")).alias("city"), given.alias("company_no"), F.make_date(F.lit(2024), (s % 12 + 1).cast("int"), F.lit(1)).alias("detected_at"))
    told = raw.where("company_no is null").select(F.col("signal_id").alias("query_id"), F.when(s % 8 == 1, F.concat(F.lit("N"), F.col("of").cast("string"))).alias("id"), F.when(s % 8 == 1, "retained").when(s % 8 == 3, "ambiguous").otherwise("no candidate").alias("family"))
    return raw.drop("of"), told


def found_dossiers(spark, sf_dir):
    """Where signals go: to a holder, an equal, a similar or a new dossier."""
    raw, told = _raw(spark, sf_dir)
    return dossiers.find_or_create(raw, _companies(spark, sf_dir), told, _edits)[0]


def noted_dossiers(spark, sf_dir):
    """Dossiers alike enough to be looked at, not enough to be the same."""
    raw, told = _raw(spark, sf_dir)
    return dossiers.find_or_create(raw, _companies(spark, sf_dir), told, _edits)[1].select("signal_id", "company_id", F.round("score", 4).alias("score"))


def dossiers_in_order(spark, sf_dir):
    """The same as if signals came one by one: they also find each other's dossiers."""
    raw, told = _raw(spark, sf_dir)
    return dossiers.find_or_create_in_order(raw, _companies(spark, sf_dir), told, _edits)[0]


def captured_fields(spark, sf_dir):
    """Fields of dossiers after a batch: the source first, then the registry."""
    s, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    companies = s.select(F.col("c_custkey").alias("company_id"), F.col("c_custkey").cast("string").alias("id"), F.when(F.col("c_custkey") % 2 == 0, "old street").alias("address"), F.when(F.col("c_custkey") % 3 == 0, "http://old").alias("website"))
    said = o.select(F.col("o_custkey").alias("company_id"), F.col("o_orderdate").alias("detected_at"), F.col("o_orderkey").alias("signal_id"), F.when(F.col("o_orderstatus") == "F", F.concat(F.col("o_orderkey").cast("string"), F.lit(" street"))).alias("address"), F.when(F.col("o_orderpriority").startswith("1"), F.concat(F.lit("http://"), F.col("o_orderkey").cast("string"))).alias("website"))
    registry = s.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("address"))
    return dossiers.captured(said, ["address", "website"], companies, registry=registry)


def _ids(spark, sf_dir):
    c = _companies(spark, sf_dir)
    held = c.select("company_id", "id", F.when(F.col("id").isNull(), "not found").otherwise("resolved").alias("status"), F.when(F.col("company_id") % 2 == 0, F.col("city")).alias("city"))
    placed = c.where("id is null").select("company_id", F.concat(F.lit("N"), F.floor(F.col("company_id") / 2).cast("string")).alias("id"), F.lit("Registered").alias("city"))
    return held, placed


def written_ids(spark, sf_dir):
    """Ids written to companies without one, unless another holds them."""
    after, _, _ = dossiers.write_ids(*_ids(spark, sf_dir), ["city"])
    return after


def undone_ids(spark, sf_dir):
    """Ids undone, but for those that changed since."""
    held, placed = _ids(spark, sf_dir)
    after, before, _ = dossiers.write_ids(held, placed, ["city"])
    moved = after.withColumn("id", F.when((F.col("company_id") % 5 == 0) & F.col("id").isNotNull(), F.concat("id", F.lit("x"))).otherwise(F.col("id")))
    back, _ = dossiers.undo_ids(moved, before, ["city"])
    return back


def undo_outcomes(spark, sf_dir):
    """What undoing did to each id written."""
    held, placed = _ids(spark, sf_dir)
    after, before, _ = dossiers.write_ids(held, placed, ["city"])
    moved = after.where("company_id % 7 <> 1").withColumn("id", F.when(F.col("company_id") % 5 == 0, F.concat("id", F.lit("x"))).otherwise(F.col("id")))
    return dossiers.undo_ids(moved, before, ["city"])[1]


def deciding_forms(spark, sf_dir):
    """The published form that decided, with its provenance."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_brand")
    form = F.when(F.col("id") % 4 == 0, F.col("p_name")).when(F.col("id") % 4 == 3, F.lit("made up")).otherwise(F.concat("p_name", F.lit(" two")))
    matches = p.select(F.col("id").alias("query_id"), "id", form.alias("form"))
    elected = p.select("id", F.upper("p_name").alias("name"))
    forms = p.select("id", F.concat("p_name", F.lit(" two")).alias("form"), F.concat(F.initcap("p_name"), F.lit(" Two")).alias("name"), F.when(F.col("id") % 4 == 1, F.col("p_brand")).alias("provenance"), F.lit("V").alias("status"))
    return dossiers.deciding_forms(matches, elected, forms)


def _best(asked, known):
    return resolution.best_by_prefix(asked, known, score=edit_score(F.col("asked"), F.col("name")))


def _asked_and_known(spark, sf_dir):
    return dirty_names(spark, sf_dir), registry_names(spark, sf_dir).where("not retired").select("id", "name")


def replay_without_city(spark, sf_dir):
    """What decisions become when cities add nothing."""
    asked, known = _asked_and_known(spark, sf_dir)
    best = materialize(_best(asked, known))  # the same for both
    return dossiers.replay(*[resolution.decide(asked, resolution.ranked(asked, best, there)) for there in (cities(spark, sf_dir), None)])


def replay_without_legal_forms(spark, sf_dir):
    """What decisions become when both sides lose their legal forms."""
    from signalmill.functions.text import without_legal_form

    usual = _asked_and_known(spark, sf_dir)
    bare = tuple(x.withColumn("name", without_legal_form(F.col("name"))) for x in usual)
    return dossiers.replay(*[resolution.decide(asked, resolution.ranked(asked, _best(asked, known), cities(spark, sf_dir))) for asked, known in (usual, bare)])


def _compared(spark, sf_dir, before: dict, after: dict, asked=None, known=None):
    """A replay of the detected names under two rules."""
    score = edit_score(F.col("asked"), F.col("name"))
    asked = dirty_names(spark, sf_dir) if asked is None else asked
    known = registry_names(spark, sf_dir).where("not retired").select("id", "name") if known is None else known
    told = [resolution.decisions_under(asked, known, cities(spark, sf_dir), score=score, **rule) for rule in (before, after)]
    return dossiers.replay(*told)


def replay_with_longer_forms(spark, sf_dir):
    """What decisions become when registry names of fewer than 26 letters don't count."""
    return _compared(spark, sf_dir, {}, {"forms": resolution.of_letters(26)})


def replay_without_parentheses(spark, sf_dir):
    """What decisions become when detected names lose what is in parentheses."""
    from signalmill.functions.text import without_parentheses

    asked = dirty_names(spark, sf_dir).withColumn("name", F.when(F.col("query_id") % 2 == 0, F.concat("name", F.lit(" (old)"))).otherwise(F.col("name")))
    return _compared(spark, sf_dir, {}, {"asked": lambda n: F.trim(without_parentheses(n))}, asked)


def replay_without_limit(spark, sf_dir):
    """What decisions become when more than forty candidates of a first word count."""
    return _compared(spark, sf_dir, {"limit": 40}, {})


def replay_of_several_names(spark, sf_dir):
    """What decisions become when a record of several names counts as each of them."""
    k = registry_names(spark, sf_dir).where("not retired")
    known = k.select("id", F.when(F.col("id") % 2 == 0, F.concat("name", F.lit(" // "), F.concat("name", F.lit("s")))).otherwise(F.col("name")).alias("name"))
    return _compared(spark, sf_dir, {}, {"forms": resolution.several_names}, known=known)


def activity_ceiling(spark, sf_dir):
    """Companies whose activity could break a tie."""
    s = table(spark, sf_dir, "supplier")
    companies = s.select(F.col("s_nationkey").alias("company_id"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_name")).alias("fact")).groupBy("company_id").agg(F.sort_array(F.collect_list("fact")).alias("facts"))
    competitors = s.select(F.col("s_nationkey").alias("company_id"), F.when(F.col("s_acctbal") > -500, F.col("s_suppkey")).alias("code"))
    return dossiers.activity_ceiling(companies, competitors)


def competitors(spark, sf_dir):
    """Candidates within eight of the best."""
    asked, known = dirty_names(spark, sf_dir), registry_names(spark, sf_dir).where("not retired").select("id", "name")
    best = resolution.best_names(asked, blocking.by_prefix(known, asked).select("query_id", "id", "name"), edit_score(F.col("asked"), F.col("name")))
    return resolution.competitors(resolution.ranked(asked, best, cities(spark, sf_dir))).select("query_id", "id", F.round("score", 4).alias("score"))


def preset_grades(spark, sf_dir):
    """Grades of days of signals under the three presets and the usual weighting."""
    s = signals(spark, sf_dir).groupBy("company_id", F.to_date("detected_at").alias("day")).agg(F.count("*").alias("n"), F.bool_or(F.col("signal_type") == "financing").alias("financed"))
    out = None
    for name, w in (("usual", relevance.Weighting()), *relevance.PRESETS.items()):
        raw = F.least(F.lit(100.0), F.lit(w.main) + F.when(F.col("financed"), 0.0).otherwise(w.absence) + F.least(F.lit(w.most_velocity), w.per_signal * (F.col("n") - 1)))
        one = s.groupBy(F.lit(name).alias("preset"), relevance.grade(raw).alias("grade")).agg(F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def needs_in_territory(spark, sf_dir):
    """Needs that a customer's nation and region may serve."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    needs = spark.createDataFrame([(1, None), (2, " asia"), (3, "NATION_3")], "need_id int, territory string")
    met = c.crossJoin(F.broadcast(needs)).where(relevance.in_territory(F.col("n_name"), F.col("r_name"), F.col("territory")))
    return met.groupBy("need_id").agg(F.count("*").alias("n"))


def listed_channels(spark, sf_dir):
    """Nations' channels in use by priority."""
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("channel"), (F.col("n_regionkey") * 10).alias("priority"), (F.col("n_nationkey") % 2 == 0).alias("active"))
    return profiles.active_channels(n)


_SYNONYMS = [("paint", "Brushed"), ("paint", "polished"), ("metal", "steel"), ("metal", "copper nickel"), ("cheap", "economy")]


def client_categories(spark, sf_dir):
    """Categories of client by parts' labels."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("company_id"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_type")).alias("sector"))
    return profiles.client_categories(p, spark.createDataFrame(_SYNONYMS, "category string, synonym string"))


def new_synonyms(spark, sf_dir):
    """Labels that a catalogue lacks in any case; % and _ stand for themselves."""
    p = table(spark, sf_dir, "part")
    fresh = p.select("p_brand", F.explode(F.array(F.upper("p_type"), F.lit("100%"), F.lit("a_b"))).alias("synonym")).select(F.col("p_brand").alias("category"), "synonym").distinct()
    known = p.where("p_size < 25").select(F.col("p_brand").alias("category"), F.lower("p_type").alias("synonym")).unionByName(p.select(F.col("p_brand").alias("category"), F.lit("100X").alias("synonym"))).distinct()
    return profiles.new_synonyms(known, fresh)


def dashboard_rows(spark, sf_dir):
    """What a user of a territory sees, on profile first."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    notes = c.select("c_custkey", F.col("c_acctbal").alias("created_at"), F.col("c_mktsegment").alias("usage"), F.col("n_name").alias("city"), F.col("r_name").alias("region"), (F.col("c_custkey") % 4 == 0).alias("off_profile"))
    return profiles.dashboard(notes, usage="uil", territory="asia ").select("c_custkey", "off_profile")


def subscribers(spark, sf_dir):
    """Customers who get messages."""
    c = table(spark, sf_dir, "customer")
    return c.where(profiles.subscribed(F.when(F.col("c_mktsegment") == "BUILDING", F.lit("2024-01-01")), F.when(F.col("c_acctbal") < 0, F.lit(True)))).select("c_custkey")


def reasons(spark, sf_dir):
    """Why companies were found, in a sentence."""
    o = table(spark, sf_dir, "orders")
    words = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("erp"), F.lit("audit"))).otherwise(F.array().cast("array<string>"))
    value = F.when(F.col("o_orderkey") % 2 == 0, F.floor("o_totalprice").cast("double"))
    return o.select("o_orderkey", profiles.reason(F.lower("o_orderpriority"), value, words).alias("said"))


def bands_that_overlap(spark, sf_dir):
    """Size bands of companies within the range that a profile asks for."""
    c = table(spark, sf_dir, "customer").select("c_custkey", reports.size_band(F.when(F.col("c_custkey") % 6 != 0, F.col("c_custkey") % 150)).alias("band"))
    least, most = F.when(F.col("c_custkey") % 4 != 0, F.lit(10)), F.when(F.col("c_custkey") % 2 == 0, F.lit(60))
    return c.groupBy("band").agg(F.count_if(reports.band_overlaps(F.col("band"), least, most)).alias("kept"), F.count("*").alias("n"))


def absent_profile(spark, sf_dir):
    """Priorities among orders of customers with and without a balance."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    o = table(spark, sf_dir, "orders").join(c, "o_custkey").select("o_orderpriority", (F.col("c_acctbal") < 0).alias("absent"))
    told = reports.absent_profile(o, "o_orderpriority", F.col("absent"))
    return told.select("bucket", *[F.round(x, 4).alias(x) for x in ("absent_share", "present_share", "difference")])


def commonest_brands(spark, sf_dir):
    """The five most frequent brands, ties by name."""
    return reports.most_common(table(spark, sf_dir, "part"), "p_brand", 5)


def calibration_alarms(spark, sf_dir):
    """Sources of which a filter kept nothing."""
    s = signals(spark, sf_dir)
    return reports.calibration_alarm(s, (F.col("source") != "source3") & (F.col("value") > 500000))


def ingested_signals(spark, sf_dir):
    """New signals by source and reference, the first of each."""
    from signalmill.plans.views import AS_OF
    from signalmill.sources.signals import ingest

    s = signals(spark, sf_dir).select("source", F.concat_ws("-", F.col("company_id").cast("string"), "signal_type").alias("source_ref"), F.col("signal_id").cast("string").alias("name"), F.when(F.col("k") % 2 == 0, F.col("detected_at")).alias("detected_at"))
    known = s.where("source = 'source1'").select("source", "source_ref")
    return ingest(known, s, AS_OF).groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("detected_at") == F.lit(AS_OF)).alias("undated"))


def nearest_names(spark, sf_dir):
    """Ids of all names, the first writer of a name first."""
    p = table(spark, sf_dir, "part")
    own = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit("own").alias("from_"))
    other = p.select((F.col("p_partkey") - F.col("p_partkey") % 2).alias("id"), F.col("p_name").alias("name"), F.lit("other").alias("from_"))
    return resolution.all_names([own, other]).groupBy("from_").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def retired_names(spark, sf_dir):
    """Statuses of names that count as retired."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderkey") % 5 == 0, F.lit(None)).when(F.col("o_orderkey") % 5 == 1, "").when(F.col("o_orderkey") % 5 == 2, "?").when(F.col("o_orderkey") % 5 == 3, "V").otherwise("A")
    return o.groupBy(resolution.retired(status).alias("retired")).agg(F.count("*").alias("n"))


def decoded_statuses(spark, sf_dir):
    """Legal states of codes."""
    from signalmill.sources.readers import decode_status

    o = table(spark, sf_dir, "orders")
    code = F.element_at(F.array(*[F.lit(c) for c in (" rd", "RO", "rx ", "IM", "Zz", "", None)]), (F.col("o_orderkey") % 7 + 1).cast("int"))
    return o.groupBy(decode_status(code).alias("status")).agg(F.count("*").alias("n"))


# --- guarded snapshots -------------------------------------------------------

_KEYS, _RELEVANT = ["key"], ["holder", "priority", "status"]


def guarded_runs(spark, sf_dir):
    """The journal of runs that end in every way: a reference, accepted, careful,
    too many gone or changed, unreadable rows, columns lost or of another type."""
    old, new = orders_before(spark, sf_dir), orders_after(spark, sf_dir)
    tight = diff.Limits.of({"disappeared": {"percent": 1.0, "count": 5}, "modified": {"count": 10**9}})
    loose = diff.Limits.of({"disappeared": {"percent": 90.0}, "appeared": {"percent": 90.0}, "modified": {"percent": 90.0}})
    only_modified = diff.Limits.of({"disappeared": {"percent": 90.0}, "appeared": {"percent": 90.0}, "modified": {"percent": 0.1, "count": 1}})
    seen = dict(old.dtypes)
    runs = {
        "a reference": diff.run(None, new, _KEYS, _RELEVANT), "b accepted": diff.run(old, new, _KEYS, _RELEVANT, earlier_runs=9, limits=loose), "c gone": diff.run(old, new, _KEYS, _RELEVANT, earlier_runs=9, limits=tight), "d changed": diff.run(old, new, _KEYS, _RELEVANT, limits=only_modified),
        "e unreadable": diff.run(old, new, _KEYS, _RELEVANT, unreadable=6, read=100), "f lost": diff.run(old, new.drop("priority"), _KEYS, _RELEVANT, seen_schema=seen), "g retyped": diff.run(old, new.withColumn("holder", F.col("holder").cast("string")), _KEYS, _RELEVANT, seen_schema=seen), "h added": diff.run(old, new.withColumn("more", F.lit(1)), _KEYS, _RELEVANT, seen_schema=seen, earlier_runs=9, limits=loose),
    }
    path = _folder(spark, "journal")
    diff.write_journal(spark, [diff.journal_row(r, "orders", name) for name, r in runs.items()], path)
    told = diff.read_journal(spark, path)
    return told.select("run_id", "status", "motive", "rows", "disappeared", F.round("disappeared_percent", 4).alias("disappeared_percent"), "disappeared_limit_count", "modified_limit_percent", "careful", F.array_join("warnings", ";").alias("warnings"))


def _folder(spark, kind: str) -> str:
    import uuid

    from signalmill.operators.storage import shared_folder

    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def settled_quarantine(spark, sf_dir):
    """The state after a quarantine's stored changes are applied."""
    old, new = orders_before(spark, sf_dir), orders_after(spark, sf_dir)
    out = diff.run(old, new, _KEYS, _RELEVANT, earlier_runs=9, limits=diff.Limits.of({"disappeared": {"percent": 0.1, "count": 1}}))
    state, _ = diff.settle(old, out, _KEYS, True)
    return state.select("key", "status", "priority", "holder")


def rejected_quarantine(spark, sf_dir):
    """The state after a quarantine is rejected: as it was."""
    old, new = orders_before(spark, sf_dir), orders_after(spark, sf_dir)
    out = diff.run(old, new, _KEYS, _RELEVANT, earlier_runs=9, limits=diff.Limits.of({"disappeared": {"percent": 0.1, "count": 1}}))
    return diff.settle(old, out, _KEYS, False)[0].groupBy("status").agg(F.count("*").alias("n"), F.lit(out.motive).alias("motive"))


def moved_companies(spark, sf_dir):
    """Addresses that changed, of active companies only."""
    old = orders_before(spark, sf_dir).select(F.col("key"), F.when(F.col("key") % 3 != 0, F.col("holder").cast("string")).alias("address"), F.lit("Active").alias("status"))
    new = old.withColumn("address", F.when(F.col("key") % 5 == 0, F.concat(F.lit("moved "), F.col("key").cast("string"))).otherwise(F.col("address"))).withColumn("status", F.when(F.col("key") % 10 == 0, "Dissolved").otherwise("Active"))
    found = diff.changes(old, new, ["key"], ["address", "status"])
    return diff.registry_signals(found, "key", status="status", active=("active", "actif", "active corporation"))


def joint_runs(spark, sf_dir):
    """Whether the grains of a diff together let what follows go on."""
    old, new = orders_before(spark, sf_dir), orders_after(spark, sf_dir)
    loose = diff.Limits.of({k: {"percent": 90.0} for k in diff.KINDS})
    good = diff.run(old, new, _KEYS, _RELEVANT, earlier_runs=9, limits=loose)
    bad = diff.run(old, new, _KEYS, _RELEVANT, earlier_runs=9, limits=diff.Limits.of({"disappeared": {"percent": 0.1, "count": 1}}))
    told = [("both accepted", diff.run_together([good, good])), ("one quarantined", diff.run_together([good, bad])), ("one reference", diff.run_together([good, diff.run(None, new, _KEYS, _RELEVANT)]))]
    return spark.createDataFrame(told, "grains string, goes_on boolean")


def new_sites(spark, sf_dir):
    """Secondary sites that appeared at companies that didn't."""
    o = table(spark, sf_dir, "orders")
    old = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("company"), "o_orderkey", (F.col("o_orderkey") % 2 == 0).alias("is_main"))
    new = o.select(F.col("o_custkey").alias("company"), "o_orderkey", (F.col("o_orderkey") % 2 == 0).alias("is_main"))
    sites = diff.changes(old, new, ["company", "o_orderkey"], ["is_main"])
    companies = diff.changes(old.select("company").distinct(), new.select("company").distinct(), ["company"], ["company"])
    return diff.new_secondary_sites(sites, companies, "company").select("company", "o_orderkey", "change_kind")


def fingerprints(spark, sf_dir):
    """Digests of rows, equal for equal relevant values."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return o.select("o_orderkey", diff.fingerprint(["o_orderstatus", "o_orderpriority"]).alias("digest"))


def best_of_each(spark, sf_dir):
    """The best customer of each nation by balance."""
    return top(table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal"), ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")], 1).drop("rank")


QUERIES: dict[str, Query] = {f.__name__: f for f in (found_dossiers, noted_dossiers, dossiers_in_order, captured_fields, written_ids, undone_ids, undo_outcomes, deciding_forms, replay_without_city, replay_without_legal_forms, replay_with_longer_forms, replay_without_parentheses, replay_without_limit, replay_of_several_names, activity_ceiling, competitors, preset_grades, needs_in_territory, listed_channels, client_categories, new_synonyms, dashboard_rows, subscribers, reasons, bands_that_overlap, absent_profile, commonest_brands, calibration_alarms, ingested_signals, nearest_names, retired_names, decoded_statuses, guarded_runs, settled_quarantine, rejected_quarantine, moved_companies, joint_runs, new_sites, fingerprints, best_of_each)}

_DOSSIERS = f"""WITH {NAMES},
companies AS (SELECT s_suppkey AS company_id, CASE WHEN s_suppkey % 3 = 0 THEN concat('N', s_suppkey) END AS id, n.name, concat('city', s_suppkey % 5) AS city FROM supplier JOIN names n ON n.id = s_suppkey),
raw AS (SELECT c_custkey AS signal_id, concat(n.name, CASE WHEN c_custkey % 16 = 4 THEN 'xyz' WHEN c_custkey % 4 = 1 THEN 's' WHEN c_custkey % 4 = 3 THEN concat(' of ', lower(c_mktsegment)) ELSE '' END) AS name, concat('city', c_custkey % 5) AS city, make_date(2024, CAST(c_custkey % 12 + 1 AS INTEGER), 1) AS since,
  CASE WHEN c_custkey % 4 = 2 OR c_custkey % 8 = 1 THEN concat('N', c_nationkey + 1) END AS id, c_custkey % 8 IN (1, 3) AND c_custkey % 4 <> 2 AS had FROM customer JOIN names n ON n.id = c_nationkey + 1),
claims AS (SELECT *, first_value(name) OVER (PARTITION BY id ORDER BY since, signal_id) AS first FROM raw WHERE id IS NOT NULL),
judged AS (SELECT c.signal_id, c.id, h.company_id AS holder, coalesce(h.name, c.first) = c.name AS kept FROM claims c LEFT JOIN companies h ON h.id = c.id),
rest AS (SELECT r.*, CASE WHEN j.signal_id IS NOT NULL OR r.had THEN 'ambiguous' ELSE 'not found' END AS status FROM raw r LEFT JOIN judged j ON j.signal_id = r.signal_id WHERE coalesce(NOT j.kept, TRUE)),
equal AS (SELECT r.signal_id, min(c.company_id) AS company_id FROM rest r JOIN companies c ON c.id IS NULL AND c.name = r.name GROUP BY r.signal_id),
scored AS (SELECT r.signal_id, c.company_id, least(100.0, {EDIT_SCORE.format(a="r.name", b="c.name")} + CASE WHEN r.city = c.city THEN 5 ELSE 0 END) AS score FROM rest r JOIN companies c ON c.id IS NULL AND starts_with(c.name, split_part(r.name, ' ', 1)) WHERE r.signal_id NOT IN (SELECT signal_id FROM equal)),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY score DESC, company_id) AS place FROM scored WHERE score >= 90) WHERE place = 1)"""
_IDS = """WITH c AS (SELECT s_suppkey AS company_id, CASE WHEN s_suppkey % 3 = 0 THEN concat('N', s_suppkey) END AS id, CASE WHEN s_suppkey % 2 = 0 THEN concat('city', s_suppkey % 5) END AS city FROM supplier JOIN part ON p_partkey = s_suppkey),
asked AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY company_id) AS r FROM (SELECT company_id, concat('N', CAST(floor(company_id / 2) AS BIGINT)) AS place FROM c WHERE id IS NULL)),
free AS (SELECT company_id, place FROM asked WHERE r = 1 AND place NOT IN (SELECT id FROM c WHERE id IS NOT NULL)),
w AS (SELECT c.company_id, coalesce(f.place, c.id) AS id, CASE WHEN f.place IS NOT NULL OR c.id IS NOT NULL THEN 'resolved' ELSE 'not found' END AS status, CASE WHEN f.place IS NOT NULL THEN coalesce(c.city, 'Registered') ELSE c.city END AS city, c.id AS id_before, c.city AS city_before, f.place FROM c LEFT JOIN free f ON c.company_id = f.company_id)"""
_GRADE = "CASE WHEN raw >= 80 THEN 'AAA' WHEN raw >= 50 THEN 'AA' ELSE 'A' END"
_PRESET = "SELECT '{name}' AS preset, " + _GRADE + " AS grade, count(*) AS n FROM (SELECT least(100.0, {w.main} + CASE WHEN financed THEN 0.0 ELSE {w.absence} END + least({w.most_velocity}, {w.per_signal} * (n - 1))) AS raw FROM d) GROUP BY 2"
_SOURCES = "source <> 'source3' AND value > 500000"
_REPLAY = """a AS (SELECT * FROM ({before})), b AS (SELECT * FROM ({after}))
SELECT a.query_id, CASE WHEN b.best >= 92 AND b.gap < 8 THEN 'sure but ambiguous' WHEN b.best >= 92 AND a.best < 92 THEN 'gained' WHEN a.best >= 92 AND b.best < 92 THEN 'lost' WHEN a.best >= 92 THEN 'sure before' ELSE 'not sure' END AS outcome, a.id IS NOT DISTINCT FROM b.id AS same_id FROM a JOIN b ON a.query_id = b.query_id"""


def _decision(ranked: str) -> str:
    """SQL of decisions (query_id, id, best, gap; zero without candidates) from ranked candidates."""
    return f"""SELECT asked.query_id, CASE WHEN t.best >= 92 AND (t.best - coalesce(t.second, 0) >= 8 OR t.n = 1) THEN t.top END AS id, coalesce(t.best, 0) AS best, coalesce(t.best - coalesce(t.second, 0), 0) AS gap
FROM asked LEFT JOIN (SELECT query_id, max(CASE WHEN rank = 1 THEN id END) AS top, max(CASE WHEN rank = 1 THEN score END) AS best, max(CASE WHEN rank = 2 THEN score END) AS second, count(*) AS n FROM {ranked} GROUP BY query_id) t ON t.query_id = asked.query_id"""


def _ranked_of(p: str, asked: str, names: str, limit: int | None = None) -> str:
    """SQL of ranked candidates of ``asked`` among ``names``, as ``{p}ranked``."""
    return f"""{p}found AS (SELECT * FROM (SELECT a.query_id, a.name AS asked, a.city, n.id, n.name, row_number() OVER (PARTITION BY a.query_id ORDER BY n.name, n.id) AS place FROM {asked} a JOIN {names} n ON n.name <> '' AND starts_with(n.name, split_part(a.name, ' ', 1))) {f"WHERE place <= {limit}" if limit else ""}),
{p}best AS (SELECT query_id, id, city, max({EDIT_SCORE.format(a="asked", b="name")}) AS edits FROM {p}found GROUP BY 1, 2, 3),
{p}cut AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY edits DESC, id) AS c FROM {p}best) WHERE c <= 5),
{p}ranked AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT query_id, id, CASE WHEN city = concat('city', id % 5) THEN least(100.0, edits + 5) ELSE edits END AS score FROM {p}cut))"""


def _replayed(tables: str, before: tuple, after: tuple) -> str:
    both = _REPLAY.format(before=_decision("x_ranked"), after=_decision("y_ranked"))
    return f"WITH {NAMES}, known AS (SELECT id, name FROM names WHERE NOT retired){tables}, {_ranked_of('x_', *before)}, {_ranked_of('y_', *after)}, {both}"


_FULL = _RANKED.replace("WHERE place <= 2000", "")
_PLAIN_CITY = "plain AS (SELECT query_id, id, edits AS score, row_number() OVER (PARTITION BY query_id ORDER BY edits DESC, id) AS rank FROM cut)"
_BARE = """bare AS (SELECT a.query_id, regexp_replace(a.name, '( (inc|co))+$', '') AS asked, a.city, n.id, regexp_replace(n.name, '( (inc|co))+$', '') AS name FROM asked a JOIN names n ON starts_with(n.name, split_part(a.name, ' ', 1)) WHERE NOT n.retired),
bare_cut AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY edits DESC, id) AS c FROM (SELECT *, """ + EDIT_SCORE.format(a="asked", b="name") + """ AS edits FROM bare)) WHERE c <= 5),
bare_ranked AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT query_id, id, CASE WHEN city = concat('city', id % 5) THEN least(100.0, edits + 5) ELSE edits END AS score FROM bare_cut))"""
_NO = "CAST(NULL AS {t})"
_COUNTS = f"WITH {SNAPSHOTS}, o AS (SELECT count(*) AS n, count(CASE WHEN key % 97 = 0 THEN 1 END) AS gone FROM before_), m AS (SELECT count(*) AS n FROM after_)"


def _run_row(name: str, status: str, motive: str, rows: str, compared: bool, count: str = "NULL", percent: str = "NULL", careful: str = "FALSE", warnings: str = "") -> str:
    gone, share = ("o.gone", "round(100.0 * o.gone / o.n, 4)") if compared else ("NULL", "NULL")
    return f"SELECT '{name}' AS run_id, '{status}' AS status, {motive} AS motive, {rows} AS rows, CAST({gone} AS BIGINT) AS disappeared, CAST({share} AS DOUBLE) AS disappeared_percent, CAST({count} AS BIGINT) AS disappeared_limit_count, CAST({percent} AS DOUBLE) AS modified_limit_percent, {careful} AS careful, '{warnings}' AS warnings FROM o, m"


SQL = {
    "found_dossiers": f"""{_DOSSIERS}
SELECT signal_id, holder AS company_id, CAST(NULL AS VARCHAR) AS new_name, id, CASE WHEN holder IS NOT NULL THEN 'holder' ELSE 'created with id' END AS how, 'resolved' AS status FROM judged WHERE kept
UNION ALL SELECT r.signal_id, coalesce(e.company_id, n.company_id), CASE WHEN e.company_id IS NULL AND n.company_id IS NULL THEN r.name END, NULL, CASE WHEN e.company_id IS NOT NULL THEN 'equal name' WHEN n.company_id IS NOT NULL THEN 'similar name' ELSE 'created' END, r.status
FROM rest r LEFT JOIN equal e ON e.signal_id = r.signal_id LEFT JOIN near n ON n.signal_id = r.signal_id AND n.score >= 95""",
    "noted_dossiers": f"{_DOSSIERS} SELECT signal_id, company_id, round(score, 4) AS score FROM near WHERE score < 95",
    "dossiers_in_order": f"""{_DOSSIERS.replace("WITH", "WITH RECURSIVE", 1)},
seq AS (SELECT r.signal_id, r.name, r.city, r.status, row_number() OVER (ORDER BY r.since, r.signal_id) AS i, n.company_id AS pool_id, coalesce(n.score, 0) AS pool_score FROM rest r LEFT JOIN near n ON n.signal_id = r.signal_id WHERE r.signal_id NOT IN (SELECT signal_id FROM equal)),
walk AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(name VARCHAR, city VARCHAR, i BIGINT)[]) AS made
  UNION ALL SELECT q.i, CASE WHEN q.pool_score < 95 AND len(list_filter(w.made, lambda m: m.name = q.name OR (starts_with(m.name, split_part(q.name, ' ', 1)) AND least(100.0, {EDIT_SCORE.format(a="q.name", b="m.name")} + CASE WHEN m.city = q.city THEN 5 ELSE 0 END) >= 95))) = 0 THEN list_append(w.made, struct_pack(name := q.name, city := q.city, i := q.i)) ELSE w.made END FROM walk w JOIN seq q ON q.i = w.i + 1),
made AS (SELECT unnest(made, recursive := true) FROM (SELECT made FROM walk ORDER BY i DESC LIMIT 1)),
likes AS (SELECT q.i, m.name AS other, m.i AS since, least(100.0, {EDIT_SCORE.format(a="q.name", b="m.name")} + CASE WHEN m.city = q.city THEN 5 ELSE 0 END) AS score FROM seq q JOIN made m ON m.i < q.i AND m.name <> q.name AND starts_with(m.name, split_part(q.name, ' ', 1))),
likest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, since) AS place FROM likes WHERE score >= 90) WHERE place = 1)
SELECT signal_id, holder AS company_id, CAST(NULL AS VARCHAR) AS new_name, id, CASE WHEN holder IS NOT NULL THEN 'holder' ELSE 'created with id' END AS how, 'resolved' AS status FROM judged WHERE kept
UNION ALL SELECT r.signal_id, e.company_id, NULL, NULL, 'equal name', r.status FROM rest r JOIN equal e ON e.signal_id = r.signal_id
UNION ALL SELECT q.signal_id, CASE WHEN m.i IS NULL AND q.pool_score >= coalesce(l.score, 0) THEN q.pool_id END, CASE WHEN m.i IS NOT NULL THEN q.name WHEN q.pool_score < coalesce(l.score, 0) THEN l.other END, NULL,
  CASE WHEN m.i = q.i THEN 'created' WHEN m.i IS NOT NULL THEN 'equal name' ELSE 'similar name' END, q.status
FROM seq q LEFT JOIN made m ON m.name = q.name AND m.i <= q.i LEFT JOIN likest l ON l.i = q.i""",
    "captured_fields": """WITH s AS (SELECT o_custkey, arg_max(concat(o_orderkey, ' street'), row(o_orderdate, o_orderkey)) FILTER (o_orderstatus = 'F') AS address, arg_max(concat('http://', o_orderkey), row(o_orderdate, o_orderkey)) FILTER (starts_with(o_orderpriority, '1')) AS website FROM orders GROUP BY o_custkey)
SELECT c_custkey AS company_id, coalesce(s.address, CASE WHEN c_custkey % 2 = 0 THEN 'old street' END, CASE WHEN c_mktsegment = 'BUILDING' THEN c_name END) AS address, coalesce(CASE WHEN c_custkey % 3 = 0 THEN 'http://old' END, s.website) AS website FROM customer LEFT JOIN s ON o_custkey = c_custkey""",
    "written_ids": f"{_IDS} SELECT company_id, id, status, city FROM w",
    "undone_ids": f"{_IDS} SELECT company_id, CASE WHEN company_id % 5 = 0 AND id IS NOT NULL THEN concat(id, 'x') WHEN place IS NOT NULL THEN id_before ELSE id END AS id, CASE WHEN place IS NOT NULL AND company_id % 5 <> 0 THEN 'not found' ELSE status END AS status, CASE WHEN place IS NOT NULL AND company_id % 5 <> 0 THEN city_before ELSE city END AS city FROM w",
    "undo_outcomes": f"{_IDS} SELECT company_id, CASE WHEN company_id % 7 = 1 THEN 'missing' WHEN company_id % 5 = 0 THEN 'ignored' ELSE 'undone' END AS outcome FROM w WHERE place IS NOT NULL",
    "deciding_forms": """SELECT p_partkey AS query_id, p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 3 THEN 'made up' ELSE concat(p_name, ' two') END AS form,
CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 3 THEN NULL ELSE array_to_string(list_transform(string_split(concat(p_name, ' two'), ' '), lambda w: concat(upper(w[1]), w[2:])), ' ') END AS published,
CASE p_partkey % 4 WHEN 0 THEN 'elected name' WHEN 1 THEN p_brand WHEN 2 THEN 'before provenances' END AS provenance, CASE WHEN p_partkey % 4 IN (1, 2) THEN 'V' END AS status FROM part""",
    "replay_without_city": f"WITH {NAMES}, {_FULL}, {_PLAIN_CITY}, " + _REPLAY.format(before=_decision("ranked"), after=_decision("plain")),
    "replay_with_longer_forms": _replayed(", longer AS (SELECT * FROM known WHERE length(replace(name, ' ', '')) >= 26)", ("asked", "known"), ("asked", "longer")),
    "replay_without_parentheses": _replayed(", told AS (SELECT query_id, city, CASE WHEN query_id % 2 = 0 THEN concat(name, ' (old)') ELSE name END AS name FROM asked)", ("told", "known"), ("asked", "known")),
    "replay_without_limit": _replayed("", ("asked", "known", 40), ("asked", "known")),
    "replay_of_several_names": _replayed(", whole AS (SELECT id, CASE WHEN id % 2 = 0 THEN concat(name, ' // ', name, 's') ELSE name END AS name FROM known), each AS (SELECT * FROM known UNION ALL SELECT id, concat(name, 's') FROM known WHERE id % 2 = 0)", ("asked", "whole"), ("asked", "each")),
    "replay_without_legal_forms": f"WITH {NAMES}, {_FULL}, {_BARE}, " + _REPLAY.format(before=_decision("ranked"), after=_decision("bare_ranked")),
    "activity_ceiling": "SELECT s_nationkey AS company_id, count(CASE WHEN s_suppkey % 3 <> 0 THEN 1 END) > 0 AS own, count(CASE WHEN s_acctbal > -500 THEN 1 END) AS theirs, count(CASE WHEN s_suppkey % 3 <> 0 THEN 1 END) > 0 AND count(CASE WHEN s_acctbal > -500 THEN 1 END) = count(*) AND count(*) > 1 AS breakable FROM supplier GROUP BY s_nationkey",
    "competitors": f"WITH {NAMES}, {_RANKED} SELECT query_id, id, round(score, 4) AS score FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM ranked) WHERE best - score < 8",
    "preset_grades": f"WITH {SIGNALS}, d AS (SELECT company_id, CAST(detected_at AS DATE) AS day, count(*) AS n, bool_or(signal_type = 'financing') AS financed FROM signals GROUP BY 1, 2) " + " UNION ALL ".join(_PRESET.format(name=name, w=w) for name, w in (("usual", relevance.Weighting()), *relevance.PRESETS.items())),
    "needs_in_territory": "SELECT need_id, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN (VALUES (1, NULL), (2, 'asia'), (3, 'nation_3')) t(need_id, territory) ON territory IS NULL OR lower(trim(n_name)) = territory OR lower(trim(r_name)) = territory GROUP BY need_id",
    "listed_channels": "SELECT n_name AS channel, n_regionkey * 10 AS priority, TRUE AS active FROM nation WHERE n_nationkey % 2 = 0",
    "client_categories": """WITH p AS (SELECT p_partkey AS company_id, concat(' ', lower(p_type), ' ') AS t FROM part WHERE p_partkey % 5 <> 0),
h AS (SELECT company_id, category, count(*) AS hits FROM p JOIN (VALUES ('paint', 'brushed'), ('paint', 'polished'), ('metal', 'steel'), ('metal', 'copper nickel'), ('cheap', 'economy')) s(category, word) ON contains(t, concat(' ', word, ' ')) GROUP BY 1, 2)
SELECT * FROM (SELECT company_id, category, hits, row_number() OVER (PARTITION BY company_id ORDER BY hits DESC, category) AS rank FROM h) WHERE rank <= 3""",
    "new_synonyms": "SELECT DISTINCT p_brand AS category, upper(p_type) AS synonym FROM part f WHERE NOT EXISTS (SELECT 1 FROM part k WHERE k.p_size < 25 AND k.p_brand = f.p_brand AND lower(k.p_type) = lower(f.p_type)) UNION ALL SELECT DISTINCT p_brand, unnest(['100%', 'a_b']) FROM part",
    "dashboard_rows": "SELECT c_custkey, c_custkey % 4 = 0 AS off_profile FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE contains(lower(c_mktsegment), 'uil') AND (lower(r_name) = 'asia' OR lower(n_name) = 'asia')",
    "subscribers": "SELECT c_custkey FROM customer WHERE c_mktsegment IS DISTINCT FROM 'BUILDING' AND coalesce(c_acctbal, 0) >= 0",
    "reasons": "SELECT o_orderkey, concat(lower(o_orderpriority), CASE WHEN o_orderkey % 2 = 0 AND floor(o_totalprice) > 0 THEN concat(' of ', replace(format('{:,}', CAST(floor(o_totalprice) AS BIGINT)), ',', ' '), ' $') ELSE '' END, CASE WHEN o_orderkey % 3 = 0 THEN ' (erp, audit)' ELSE '' END) AS said FROM orders",
    "bands_that_overlap": """WITH c AS (SELECT *, c_custkey % 150 AS total, CASE WHEN c_custkey % 4 <> 0 THEN 10 ELSE NULL END AS least, CASE WHEN c_custkey % 2 = 0 THEN 60 ELSE NULL END AS most FROM customer),
b AS (SELECT *, CASE WHEN c_custkey % 6 = 0 THEN NULL WHEN total < 5 THEN '1-4' WHEN total < 20 THEN '5-19' WHEN total < 100 THEN '20-99' ELSE '100+' END AS band FROM c),
r AS (SELECT *, CASE band WHEN '1-4' THEN 1 WHEN '5-19' THEN 5 WHEN '20-99' THEN 20 WHEN '100+' THEN 100 END AS low, CASE band WHEN '1-4' THEN 4 WHEN '5-19' THEN 19 WHEN '20-99' THEN 99 ELSE 1000000 END AS high FROM b)
SELECT band, count(CASE WHEN (least IS NULL AND most IS NULL) OR (band IS NOT NULL AND (least IS NULL OR high >= least) AND (most IS NULL OR low <= most)) THEN 1 END) AS kept, count(*) AS n FROM r GROUP BY band""",
    "absent_profile": "WITH b AS (SELECT o_orderpriority AS bucket, count(CASE WHEN c_acctbal < 0 THEN 1 END) AS a, count(CASE WHEN NOT c_acctbal < 0 THEN 1 END) AS p FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1), s AS (SELECT bucket, coalesce(100.0 * a / nullif(sum(a) OVER (), 0), 0) AS absent_share, coalesce(100.0 * p / nullif(sum(p) OVER (), 0), 0) AS present_share FROM b) SELECT bucket, round(absent_share, 4) AS absent_share, round(present_share, 4) AS present_share, round(absent_share - present_share, 4) AS difference FROM s",
    "commonest_brands": "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 5",
    "calibration_alarms": f"WITH {SIGNALS} SELECT source, count(CASE WHEN {_SOURCES} THEN 1 END) AS kept, count(CASE WHEN NOT ({_SOURCES}) THEN 1 END) AS dropped, count(CASE WHEN {_SOURCES} THEN 1 END) = 0 AND count(*) > 0 AS alarm FROM signals GROUP BY source",
    "ingested_signals": f"WITH {SIGNALS}, s AS (SELECT source, concat(company_id, '-', signal_type) AS ref, bool_or(k % 2 = 0) AS dated FROM signals WHERE source <> 'source1' GROUP BY 1, 2) SELECT source, count(*) AS n, count(CASE WHEN NOT dated THEN 1 END) AS undated FROM s GROUP BY source",
    "nearest_names": "WITH o AS (SELECT DISTINCT p_partkey AS id, p_name AS name FROM part), t AS (SELECT DISTINCT p_partkey - p_partkey % 2 AS id, p_name AS name FROM part) SELECT 'own' AS from_, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM o UNION ALL SELECT 'other', count(*), CAST(sum(id) AS BIGINT) FROM t WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.id = t.id AND o.name = t.name)",
    "retired_names": "SELECT o_orderkey % 5 = 4 AS retired, count(*) AS n FROM orders GROUP BY 1",
    "decoded_statuses": "SELECT CASE WHEN o_orderkey % 7 < 3 THEN 'struck_off' WHEN o_orderkey % 7 = 3 THEN 'registered' WHEN o_orderkey % 7 = 4 THEN 'zz' ELSE 'unknown' END AS status, count(*) AS n FROM orders GROUP BY 1",
    "settled_quarantine": f"WITH {SNAPSHOTS} SELECT key, status, priority, holder FROM after_",
    "rejected_quarantine": f"WITH {SNAPSHOTS} SELECT status, count(*) AS n, 'disappeared' AS motive FROM before_ GROUP BY status",
    "moved_companies": "SELECT o_orderkey AS key, 'address_change' AS change_kind, CAST(o_custkey AS VARCHAR) AS before, concat('moved ', o_orderkey) AS after FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey % 3 <> 0 AND o_orderkey % 10 <> 0",
    "joint_runs": "SELECT * FROM (VALUES ('both accepted', TRUE), ('one quarantined', FALSE), ('one reference', FALSE)) t(grains, goes_on)",
    "new_sites": "SELECT o_custkey AS company, o_orderkey, 'new_site' AS change_kind FROM orders o WHERE o_orderstatus <> 'F' AND o_orderkey % 2 = 1 AND EXISTS (SELECT 1 FROM orders f WHERE f.o_custkey = o.o_custkey AND f.o_orderstatus = 'F')",
    "fingerprints": """SELECT o_orderkey, sha256(concat('{"o_orderpriority":"', o_orderpriority, '","o_orderstatus":"', o_orderstatus, '"}')) AS digest FROM orders""",
    "best_of_each": "SELECT c_nationkey, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r = 1",
    "guarded_runs": f"{_COUNTS} "
    + " UNION ALL ".join(
        [
            _run_row("a reference", "reference", "NULL", "m.n", False), _run_row("b accepted", "accepted", "NULL", "m.n", True, "300", "90.0"), _run_row("c gone", "quarantined", "'disappeared'", "m.n", True, "5", "50.0"),
            _run_row("d changed", "quarantined", "'modified'", "m.n", True, "150", "0.05", "TRUE"), _run_row("e unreadable", "quarantined", "'unreadable'", "100", False), _run_row("f lost", "quarantined", "'columns removed'", "0", False),
            _run_row("g retyped", "quarantined", "'types changed'", "0", False), _run_row("h added", "accepted", "NULL", "m.n", True, "300", "90.0", "FALSE", "column added: more"),
        ]
    ),
}
