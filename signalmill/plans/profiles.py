"""Plans, catalogues, cities and messages."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from signalmill.functions import text
from signalmill.operators import profiles, scores
from signalmill.plans.scores import _SCORED
from signalmill.plans.views import AS_OF, SIGNALS, Query, signals, table


def allowed_by_plan(spark, sf_dir):
    """Customers by the plan that their balance buys and the sources it opens."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 6000, "full").when(F.col("c_acctbal") > 2000, "plus").otherwise("basic").alias("plan"))
    least = F.explode(F.array(*[F.lit(p) for p in profiles.PLANS]))
    return c.withColumn("least", least).where(profiles.plan_allows(F.col("plan"), F.col("least"))).groupBy("plan", "least").agg(F.count("*").alias("n"))


def kept_fields(spark, sf_dir):
    """Fields left to each type of signal by its rule."""
    s = signals(spark, sf_dir)
    rule = F.when(F.col("signal_type") == "tender", F.array(F.lit("k"), F.lit("goods"))).when(F.col("signal_type") == "ranking", F.array(F.lit("rank")))
    left = F.array_join(F.array_sort(F.map_keys(profiles.allowed_fields(F.col("fields"), rule))), ",")
    return s.groupBy("signal_type", left.alias("fields")).agg(F.count("*").alias("n"))


def verified_orders(spark, sf_dir):
    """Orders by the first exclusion that applies."""
    o = table(spark, sf_dir, "orders")
    outcome = profiles.verification(F.col("o_custkey") % 10 != 0, F.col("o_orderstatus") == "F", F.col("o_totalprice") > 50000)
    return o.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def scoped_customers(spark, sf_dir):
    """What accounts of two territories and an administrator see."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey").join(table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
    each = c.withColumn("account", F.explode(F.array(F.lit("asia"), F.lit(" nation_3"), F.lit("admin"))))
    seen = profiles.in_scope(F.col("n_name"), F.col("r_name"), F.col("account"), F.col("account") == "admin")
    return each.where(seen).groupBy("account").agg(F.count("*").alias("n"))


def overridden_weights(spark, sf_dir):
    """Weights of profiles: their own only with the greatest plan."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "full").otherwise("plus").alias("plan"), F.when(F.col("c_custkey") % 2 == 0, 45.0).alias("main"), F.lit(10.0).alias("absence"))
    return profiles.overridden(c, {"main": 60.0, "absence": 15.0}).groupBy("plan", "main", "absence").agg(F.count("*").alias("n"))


def stale_customers(spark, sf_dir):
    """Customers whose last order is missing or older than 400 days."""
    last = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").join(last, "c_custkey", "left")
    return c.groupBy("c_mktsegment").agg(F.count_if(profiles.stale(F.col("last"), datetime(2001, 8, 1), 400)).alias("stale"), F.count("*").alias("n"))


def run_outcomes(spark, sf_dir):
    """Runs closed, running, interrupted and undecided."""
    o = table(spark, sf_dir, "orders")
    started = F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderdate"))
    ended = F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))
    return o.groupBy(profiles.run_outcome(started, ended, datetime(2001, 8, 1), 24 * 365).alias("outcome")).agg(F.count("*").alias("n"))


def dominant_signals(spark, sf_dir):
    """The signal of greatest base score of each company, with its opening."""
    s = profiles.dominant_signal(scores.signal_scores(signals(spark, sf_dir), AS_OF))
    said = profiles.opening(F.col("signal_type"), F.concat(F.lit("Company "), F.col("company_id").cast("string")), F.when(F.col("k") < 0, F.col("value")))
    return s.select("company_id", "signal_id", "base", said.alias("opening"))


_SYNONYMS = [("english", "the"), ("english", "of the"), ("english", "and"), ("french", "le"), ("french", "de la"), ("french", "et"), ("german", "und"), ("german", "der"), ("spanish", "el"), ("spanish", "los")]


def suggested_categories(spark, sf_dir):
    """The three likeliest categories of each document by a catalogue of synonyms."""
    catalogue = spark.createDataFrame(_SYNONYMS, "category string, synonym string")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text")
    return profiles.suggestions(d, F.broadcast(catalogue))


def company_cities(spark, sf_dir):
    """The city of each customer's best supplier, with all spellings."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("company_id"))
    l = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select("l_orderkey", "l_suppkey")  # noqa: E741
    met = o.join(l, "l_orderkey").select("company_id", (F.col("l_suppkey") % 4).alias("source_rank"), F.concat(F.lit("City"), (F.col("l_suppkey") % 7).cast("string")).alias("city"), F.concat(F.lit("s"), (F.col("l_suppkey") % 4).cast("string")).alias("source"))
    b = profiles.best_city(met)
    return b.select("company_id", "city", "source", F.array_join("variants", ",").alias("variants"))


def directory_overlap(spark, sf_dir):
    """Part names found in a directory whose cells hold two."""
    p = table(spark, sf_dir, "part")
    listed = p.join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("p_partkey")), "p_partkey", "left_semi")
    directory = listed.select(F.col("p_partkey").alias("entry"), F.concat(F.upper("p_name"), F.lit(" // "), "p_brand").alias("names"))
    return profiles.overlapping_directories(directory, p.select(F.col("p_partkey").alias("id"), text.normalise(F.col("p_name")).alias("name")))


def site_pages(spark, sf_dir):
    """The first link of each kind on each page."""
    p = table(spark, sf_dir, "pages").select(F.col("url").alias("site"), F.posexplode(text.links(F.col("html"))).alias("place", "url"))
    return profiles.pages_to_visit(p, {"t": "^/t", "a": "^/a", "vowel": "^/[eiou]"}, 2)


QUERIES: dict[str, Query] = {f.__name__: f for f in (allowed_by_plan, kept_fields, verified_orders, scoped_customers, overridden_weights, stale_customers, run_outcomes, dominant_signals, suggested_categories, company_cities, directory_overlap, site_pages)}

_SAYS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in (("tender", "has just won a contract"), ("financing", "has just been financed"), ("hiring", "is hiring"), ("registry", "is opening or moving"), ("ranking", "is among the fastest growing")))

SQL = {
    "site_pages": r"""WITH l AS (SELECT url AS site, regexp_extract_all(html, '(?i)<a\b[^>]*?\bhref\s*=\s*["\x27]([^"\x27#]+)', 1) AS all_ FROM pages), e AS (SELECT site, unnest(all_) AS url, unnest(range(len(all_))) AS place FROM l),
f AS (SELECT site, url, min(place) AS place FROM e GROUP BY 1, 2), o AS (SELECT *, regexp_extract(site, '^https?://(?:www\.)?([^/]+)', 1) AS h, regexp_extract(url, '^https?://(?:www\.)?([^/]+)', 1) AS g FROM f),
k AS (SELECT site, url, place, CASE WHEN regexp_matches(url, '(?i)^/t') THEN 't' WHEN regexp_matches(url, '(?i)^/a') THEN 'a' WHEN regexp_matches(url, '(?i)^/[eiou]') THEN 'vowel' END AS category FROM o WHERE g = '' OR g = h),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site, category ORDER BY place) AS r FROM k WHERE category IS NOT NULL) WHERE r = 1)
SELECT site, url, category FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY place) AS q FROM p) WHERE q <= 2""",
    "allowed_by_plan": "WITH p AS (SELECT CASE WHEN c_acctbal > 6000 THEN 2 WHEN c_acctbal > 2000 THEN 1 ELSE 0 END AS i FROM customer), names(i, plan) AS (VALUES (0, 'basic'), (1, 'plus'), (2, 'full')) SELECT a.plan, b.plan AS least, count(*) AS n FROM p JOIN names a ON p.i = a.i JOIN names b ON b.i <= p.i GROUP BY a.plan, b.plan",
    "kept_fields": f"WITH {SIGNALS} SELECT signal_type, CASE signal_type WHEN 'tender' THEN 'goods,k' WHEN 'ranking' THEN 'rank' ELSE 'change,goods,growth,k,nature,rank' END AS fields, count(*) AS n FROM signals GROUP BY signal_type",
    "verified_orders": "SELECT CASE WHEN o_custkey % 10 = 0 THEN 'no identity' WHEN o_orderstatus = 'F' THEN 'struck off' WHEN NOT o_totalprice > 50000 THEN 'inactive' ELSE 'passes' END AS outcome, count(*) AS n FROM orders GROUP BY 1",
    "scoped_customers": "WITH a(account) AS (VALUES ('asia'), (' nation_3'), ('admin')) SELECT account, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN a ON account = 'admin' OR lower(n_name) = trim(account) OR lower(r_name) = trim(account) GROUP BY account",
    "overridden_weights": "SELECT plan, CASE WHEN plan = 'full' AND c_custkey % 2 = 0 THEN 45.0 ELSE 60.0 END AS main, CASE WHEN plan = 'full' THEN 10.0 ELSE 15.0 END AS absence, count(*) AS n FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'full' ELSE 'plus' END AS plan FROM customer) GROUP BY 1, 2, 3",
    "stale_customers": "SELECT c_mktsegment, count(CASE WHEN last IS NULL OR last < TIMESTAMP '2001-08-01' - INTERVAL 400 DAYS THEN 1 END) AS stale, count(*) AS n FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey GROUP BY c_mktsegment",
    "run_outcomes": "SELECT CASE WHEN o_orderstatus = 'F' THEN 'closed' WHEN o_orderkey % 11 = 0 THEN 'undecided' WHEN o_orderdate < TIMESTAMP '2001-08-01' - INTERVAL 365 DAYS THEN 'interrupted' ELSE 'running' END AS outcome, count(*) AS n FROM orders GROUP BY 1",
    "dominant_signals": f"WITH {SIGNALS},{_SCORED} SELECT company_id, signal_id, base, concat('Company ', company_id, ' ', CASE signal_type {_SAYS} END, '.') AS opening FROM (SELECT s.company_id, s.signal_id, s.base, s.signal_type, row_number() OVER (PARTITION BY s.company_id ORDER BY s.base DESC, s.signal_id) AS r FROM scored s) WHERE r = 1",
    "suggested_categories": "WITH known(category, synonym) AS (VALUES " + ", ".join(f"('{c}', '{s}')" for c, s in _SYNONYMS) + "), plain AS (SELECT doc_id, concat(' ', trim(regexp_replace(lower(regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9]+', ' ', 'g')), ' ') AS t FROM documents), hits AS (SELECT doc_id AS text_id, category, count(*) AS hits FROM plain JOIN known ON contains(t, concat(' ', synonym, ' ')) GROUP BY doc_id, category) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY hits DESC, category) AS rank FROM hits) WHERE rank <= 3",
    "company_cities": "WITH m AS (SELECT o_custkey AS company_id, l_suppkey % 4 AS source_rank, concat('City', l_suppkey % 7) AS city FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber = 1), f AS (SELECT company_id, city, concat('s', source_rank) AS source, row_number() OVER (PARTITION BY company_id ORDER BY source_rank, city) AS r FROM m), v AS (SELECT company_id, string_agg(city, ',' ORDER BY city) AS variants FROM (SELECT DISTINCT company_id, city FROM m) GROUP BY company_id) SELECT f.company_id, city, source, variants FROM f JOIN v ON f.company_id = v.company_id WHERE r = 1",
    "directory_overlap": "WITH d AS (SELECT p_partkey AS entry, p_name AS name FROM part WHERE p_partkey IN (SELECT s_suppkey FROM supplier)) SELECT DISTINCT p_partkey AS id, entry FROM part JOIN d ON p_name = name",
}
