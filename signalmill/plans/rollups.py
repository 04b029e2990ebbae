"""Reports: roll-ups, provenance, funnels, hierarchies and histograms."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from signalmill.functions.numbers import band
from signalmill.operators import reports, sketches
from signalmill.operators.storage import shared_folder
from signalmill.plans.views import SIGNALS, Query, signals, table


def synthesis(spark, sf_dir):
    """Companies along several dimensions, each by its first signal."""
    s = signals(spark, sf_dir).select("company_id", "signal_id", "signal_type", "source", F.element_at("fields", "goods").alias("goods"))
    return reports.synthesis(s, ["signal_type", "source", "goods"], [F.col("signal_id")])


_CLASSES = [("licence", "licen[cs]e"), ("contact", "@"), ("secret", "password|token"), ("short word", r"\bthe\b")]


def classified_documents(spark, sf_dir):
    """Documents by the first class whose pattern they hold, and language."""
    d = table(spark, sf_dir, "documents")
    return d.groupBy("lang", reports.classify(F.col("text"), _CLASSES).alias("class")).agg(F.count("*").alias("n"))


def scan_report(spark, sf_dir):
    """New rows, repeats and errors by category."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("category"), (F.col("o_orderkey") % 13).alias("new"), (F.col("o_orderkey") % 5).alias("duplicates"), F.when(F.col("o_orderkey") % 17 == 0, "timeout").alias("error"))
    return reports.scan_report(o)


def provenance(spark, sf_dir):
    """Companies that each source touches, and has to itself."""
    return reports.provenance(signals(spark, sf_dir).where("k < 30 and value > 600000"))


def exclusive_companies(spark, sf_dir):
    """Companies whose large signals all come from five sources."""
    return reports.exclusive_to(signals(spark, sf_dir).where("value > 900000"), ["source0", "source1", "source2", "source3", "source4"])


def field_inventory(spark, sf_dir):
    """How often each field of each source is filled, and with how many values."""
    return reports.field_inventory(signals(spark, sf_dir), "source", "fields")


def order_funnel(spark, sf_dir):
    """Orders that pass one condition after another."""
    o = table(spark, sf_dir, "orders")
    return reports.funnel(o, [("large", F.col("o_totalprice") > 100000), ("open", F.col("o_orderstatus") == "O"), ("urgent", F.col("o_orderpriority") == "1-URGENT"), ("recent", F.col("o_orderdate") >= F.lit("1999-01-01").cast("timestamp"))])


def buyer_coverage(spark, sf_dir):
    """Orders by nation: how many, with a large amount, and the buyers."""
    o = table(spark, sf_dir, "orders").withColumn("large", F.when(F.col("o_totalprice") > 300000, F.col("o_totalprice")))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation"))
    per = o.join(c, "o_custkey").groupBy("nation").agg(F.count("*").alias("orders"), F.count("large").alias("with_large"), F.count_distinct("o_custkey").alias("buyers"))
    return per


def code_hierarchy(spark, sf_dir):
    """Codes of eight digits cut to each width."""
    p = table(spark, sf_dir, "part").select(F.lpad((F.col("p_partkey") * 7919 % 100000000).cast("string"), 8, "0").alias("code"))
    return reports.hierarchy(p, "code", [2, 4, 6, 8])


def code_pareto(spark, sf_dir):
    """Part names by frequency with their running share within a type."""
    n = table(spark, sf_dir, "part").groupBy("p_type", "p_name").agg(F.count("*").alias("n"))
    return reports.pareto(n, ["p_type"], "p_name")


def names_for_share(spark, sf_dir):
    """How many part names make up 80 % of each type."""
    n = table(spark, sf_dir, "part").groupBy("p_type", "p_name").agg(F.count("*").alias("n"))
    return reports.names_for_share(n, ["p_type"], "p_name", 80.0)


def order_rollup(spark, sf_dir):
    """Orders by status, by status and priority, and in all."""
    return table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def compared_populations(spark, sf_dir):
    """Segments among rich and other customers."""
    return reports.compare_populations(table(spark, sf_dir, "customer"), "c_mktsegment", F.col("c_acctbal") > 5000)


def status_crosstab(spark, sf_dir):
    """Statuses within each priority, in hundredths."""
    return reports.crosstab(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


def names_per_id(spark, sf_dir):
    """How many brands a part's name has, and how many names have so many."""
    per = table(spark, sf_dir, "part").groupBy("p_name").agg(F.count_distinct("p_brand").alias("brands"))
    return per.groupBy("brands").agg(F.count("*").alias("names"))


def price_histogram(spark, sf_dir):
    """Order prices in twenty bins."""
    return reports.histogram(table(spark, sf_dir, "orders"), "o_totalprice", 0.0, 500000.0, 20)


def quantity_plateaus(spark, sf_dir):
    """Quantities that at least a fiftieth of the usual number of lines have."""
    return reports.plateaus(table(spark, sf_dir, "lineitem"), "l_quantity", 100)


def read_cost(spark, sf_dir):
    """Rows that each access path reads, and its yield."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("path")).agg(F.count("*").alias("calls"), F.count_if(F.col("o_orderstatus") == "F").alias("hits"))
    return reports.read_cost(o.select("path", "calls", "hits", F.lit(0.25).alias("share"), F.lit(1000).alias("population"), F.lit(2).alias("fixed")))


def company_sizes(spark, sf_dir):
    """Companies by the size that their postings tell."""
    s = signals(spark, sf_dir).where("signal_type = 'hiring' and k < 8")
    total = s.groupBy("company_id").agg(F.sum(F.coalesce(F.when(F.col("k") > 0, F.col("k")), F.lit(1))).alias("posts"))
    return total.select("company_id", "posts", reports.size_band(F.col("posts")).alias("size"))


def age_bands(spark, sf_dir):
    """Signals by age at the end of January."""
    age = F.datediff(F.lit("2024-01-31").cast("date"), F.to_date("detected_at"))
    return signals(spark, sf_dir).groupBy(band(age, [(7, "week"), (14, "fortnight"), (21, "three weeks")], "older").alias("age")).agg(F.count("*").alias("n"))


def sources_per_company(spark, sf_dir):
    """How many companies have so many sources, over large signals."""
    s = signals(spark, sf_dir).where("value > 800000")
    return s.groupBy("company_id").agg(F.count_distinct("source").alias("sources")).groupBy("sources").agg(F.count("*").alias("companies"))


def text_coverage(spark, sf_dir):
    """Documents of each source with a label, and with a toxic one."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.groupBy("source").agg(F.count("*").alias("documents"), F.count("quality").alias("labelled"), F.count_if(F.col("toxic") == 1).alias("toxic"))


def delivery_outcomes(spark, sf_dir):
    """Deliveries by what became of them: done, failed, waiting or given up."""
    o = table(spark, sf_dir, "orders")
    outcome = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "failed").when(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp"), "given up").otherwise("waiting")
    return o.groupBy(outcome.alias("outcome"), F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))


def revenue_by_nation(spark, sf_dir):
    """Discounted revenue of suppliers by nation and region."""
    l = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))  # noqa: E741
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey"))
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
    per = l.groupBy("l_suppkey").agg(F.sum("revenue").alias("revenue")).join(s, "l_suppkey").join(n, "n_nationkey")
    return per.groupBy("r_name", "n_name").agg(F.round(F.sum("revenue"), 0).alias("revenue"))


RANKS = (0.1, 0.5, 0.9)


def merged_sketches(spark, sf_dir):
    """Users and values of each type from sketches stored by day: whether they lie
    within the stated errors of what all rows give, for all days and for half of them."""
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts")).withColumn("item", F.concat_ws("-", "user_id", F.get_json_object("props", "$.k")))
    folder = f"{shared_folder(spark)}/sketches-{uuid.uuid4().hex}"
    sketches.sketched(e, ["event_type", "day"], F.col("item"), F.col("value")).write.parquet(folder)
    told = None
    for part, days in (("all", "true"), ("odd days", "day(day) % 2 = 1")):
        kept = e.where(days)
        found = sketches.merged(spark.read.parquet(folder).where(days), ["event_type"], RANKS)
        exact = kept.groupBy("event_type").agg(F.countDistinct("item").alias("items"))
        below = kept.join(F.broadcast(found.select("event_type", "quantiles")), "event_type")  # a row for each type
        share = lambda i, op: F.avg((F.col("value") < F.col("quantiles")[i] if op == "<" else F.col("value") <= F.col("quantiles")[i]).cast("double"))
        ranks = below.groupBy("event_type").agg(*[share(i, op).alias(f"{name}{i}") for i in range(len(RANKS)) for name, op in (("low", "<"), ("high", "<="))])
        within = F.lit(True)
        for i, rank in enumerate(RANKS):
            within = within & (F.col(f"low{i}") <= rank + sketches.rank_error()) & (F.col(f"high{i}") >= rank - sketches.rank_error())
        one = found.join(exact, "event_type").join(ranks, "event_type").select(F.lit(part).alias("part"), "event_type", "n", "items", (F.abs(F.col("distinct") - F.col("items")) <= F.ceil(F.col("items") * sketches.distinct_error())).alias("items_within"), within.alias("ranks_within"))
        told = one if told is None else told.unionByName(one)
    return told


QUERIES: dict[str, Query] = {f.__name__: f for f in (synthesis, classified_documents, scan_report, provenance, exclusive_companies, field_inventory, order_funnel, buyer_coverage, code_hierarchy, code_pareto, names_for_share, order_rollup, compared_populations, status_crosstab, names_per_id, price_histogram, quantity_plateaus, read_cost, company_sizes, age_bands, sources_per_company, text_coverage, delivery_outcomes, revenue_by_nation, merged_sketches)}

_FIRST = "firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY signal_id) AS r FROM signals) WHERE r = 1)"
_PARTS = "counts AS (SELECT p_type, p_name, count(*) AS n FROM part GROUP BY p_type, p_name), told AS (SELECT *, sum(n) OVER (PARTITION BY p_type ORDER BY n DESC, p_name ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running, sum(n) OVER (PARTITION BY p_type) AS total FROM counts)"
_STAGES = ["o_totalprice > 100000", "o_orderstatus = 'O'", "o_orderpriority = '1-URGENT'", "o_orderdate >= TIMESTAMP '1999-01-01'"]
_FUNNEL = " UNION ALL ".join(f"SELECT '{n}' AS stage, {i} AS place, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM orders), 2) AS percent FROM orders WHERE {' AND '.join(_STAGES[: i + 1])}" for i, n in enumerate(("large", "open", "urgent", "recent")))
_FIELDS = " UNION ALL ".join(f"SELECT source, '{name}' AS field, CAST({value} AS VARCHAR) AS value FROM signals" for name, value in (("k", "k"), ("goods", "goods"), ("change", "change"), ("nature", "nature"), ("rank", "k * 10"), ("growth", "k * 3")))

SQL = {
    "merged_sketches": "WITH e AS (SELECT *, concat(user_id, '-', json_extract_string(props, '$.k')) AS item FROM events) SELECT 'all' AS part, event_type, count(*) AS n, count(DISTINCT item) AS items, TRUE AS items_within, TRUE AS ranks_within FROM e GROUP BY event_type UNION ALL SELECT 'odd days', event_type, count(*), count(DISTINCT item), TRUE, TRUE FROM e WHERE day(ts) % 2 = 1 GROUP BY event_type",
    "synthesis": f"WITH {SIGNALS}, {_FIRST} SELECT 'signal_type' AS dimension, signal_type AS bucket, count(*) AS companies FROM firsts GROUP BY signal_type UNION ALL SELECT 'source', source, count(*) FROM firsts GROUP BY source UNION ALL SELECT 'goods', goods, count(*) FROM firsts GROUP BY goods",
    "classified_documents": "SELECT lang, CASE WHEN trim(coalesce(text, '')) = '' THEN '(unstated)' WHEN regexp_matches(text, '(?i)licen[cs]e') THEN 'licence' WHEN contains(text, '@') THEN 'contact' WHEN regexp_matches(text, '(?i)password|token') THEN 'secret' WHEN regexp_matches(text, '(?i)\\bthe\\b') THEN 'short word' ELSE '(unclassed)' END AS class, count(*) AS n FROM documents GROUP BY 1, 2",
    "scan_report": "SELECT o_orderpriority AS category, CAST(sum(CASE WHEN o_orderkey % 17 <> 0 THEN o_orderkey % 13 ELSE 0 END) AS BIGINT) AS new, CAST(sum(CASE WHEN o_orderkey % 17 <> 0 THEN o_orderkey % 5 ELSE 0 END) AS BIGINT) AS duplicates, count(CASE WHEN o_orderkey % 17 = 0 THEN 1 END) AS errors FROM orders GROUP BY o_orderpriority",
    "provenance": f"WITH {SIGNALS}, pairs AS (SELECT DISTINCT company_id, source FROM signals WHERE k < 30 AND value > 600000), alone AS (SELECT company_id, count(*) AS n FROM pairs GROUP BY company_id) SELECT source, count(*) AS touched, count(CASE WHEN n = 1 THEN 1 END) AS exclusive FROM pairs JOIN alone ON pairs.company_id = alone.company_id GROUP BY source",
    "exclusive_companies": f"WITH {SIGNALS} SELECT company_id FROM signals WHERE value > 900000 GROUP BY company_id HAVING min(CASE WHEN source IN ('source0', 'source1', 'source2', 'source3', 'source4') THEN 1 ELSE 0 END) = 1",
    "field_inventory": f'WITH {SIGNALS}, each_ AS ({_FIELDS}) SELECT source, field, count(*) AS filled, count(DISTINCT substr(value, 1, 200)) AS "values" FROM each_ GROUP BY source, field',
    "order_funnel": _FUNNEL,
    "buyer_coverage": "SELECT c_nationkey AS nation, count(*) AS orders, count(CASE WHEN o_totalprice > 300000 THEN 1 END) AS with_large, count(DISTINCT o_custkey) AS buyers FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey",
    "code_hierarchy": "WITH c AS (SELECT lpad(CAST(p_partkey * 7919 % 100000000 AS VARCHAR), 8, '0') AS code FROM part) " + " UNION ALL ".join(f"SELECT {w} AS width, substr(code, 1, {w}) AS code, count(*) AS n FROM c GROUP BY substr(code, 1, {w})" for w in (2, 4, 6, 8)),
    "code_pareto": f"WITH {_PARTS} SELECT p_type, p_name, n, CAST(running AS BIGINT) AS running, round(100.0 * running / total, 2) AS share FROM told",
    "names_for_share": f"WITH {_PARTS} SELECT p_type, count(*) AS names FROM told WHERE 100.0 * (running - n) / total < 80 GROUP BY p_type",
    "order_rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "compared_populations": "WITH p AS (SELECT c_mktsegment, count(CASE WHEN c_acctbal > 5000 THEN 1 END) AS inside, count(CASE WHEN NOT c_acctbal > 5000 THEN 1 END) AS outside FROM customer GROUP BY c_mktsegment), s AS (SELECT *, round(100.0 * inside / sum(inside) OVER (), 4) AS inside_share, round(100.0 * outside / sum(outside) OVER (), 4) AS outside_share FROM p) SELECT *, round(inside_share - outside_share, 4) AS difference, round(inside_share / nullif(outside_share, 0), 4) AS times FROM s",
    "status_crosstab": "SELECT o_orderpriority, " + ", ".join(f"round(100.0 * count(CASE WHEN o_orderstatus = '{v}' THEN 1 END) / count(*), 4) AS \"{v}\"" for v in "FOP") + " FROM orders GROUP BY o_orderpriority",
    "names_per_id": "SELECT brands, count(*) AS names FROM (SELECT p_name, count(DISTINCT p_brand) AS brands FROM part GROUP BY p_name) GROUP BY brands",
    "price_histogram": "SELECT CAST(CASE WHEN o_totalprice < 0 THEN 0 WHEN o_totalprice >= 500000 THEN 21 ELSE floor(o_totalprice / 25000) + 1 END AS BIGINT) AS bin, count(*) AS n FROM orders GROUP BY 1",
    "quantity_plateaus": "SELECT l_quantity, count(*) AS n FROM lineitem GROUP BY l_quantity HAVING count(*) >= 100",
    "read_cost": "SELECT o_orderpriority AS path, count(*) * (0.25 * 1000 + 2) AS rows_read, round(100.0 * count(CASE WHEN o_orderstatus = 'F' THEN 1 END) / count(*), 2) AS percent FROM orders GROUP BY o_orderpriority",
    "company_sizes": f"WITH {SIGNALS}, t AS (SELECT company_id, CAST(sum(CASE WHEN k > 0 THEN k ELSE 1 END) AS BIGINT) AS posts FROM signals WHERE signal_type = 'hiring' AND k < 8 GROUP BY company_id) SELECT company_id, posts, CASE WHEN posts < 5 THEN '1-4' WHEN posts < 20 THEN '5-19' WHEN posts < 100 THEN '20-99' ELSE '100+' END AS size FROM t",
    "age_bands": f"WITH {SIGNALS} SELECT CASE WHEN d <= 7 THEN 'week' WHEN d <= 14 THEN 'fortnight' WHEN d <= 21 THEN 'three weeks' ELSE 'older' END AS age, count(*) AS n FROM (SELECT date_diff('day', CAST(detected_at AS DATE), DATE '2024-01-31') AS d FROM signals) GROUP BY 1",
    "sources_per_company": f"WITH {SIGNALS} SELECT sources, count(*) AS companies FROM (SELECT company_id, count(DISTINCT source) AS sources FROM signals WHERE value > 800000 GROUP BY company_id) GROUP BY sources",
    "text_coverage": "SELECT source, count(*) AS documents, count(quality) AS labelled, count(CASE WHEN toxic = 1 THEN 1 END) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source",
    "delivery_outcomes": "SELECT CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'P' THEN 'failed' WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'given up' ELSE 'waiting' END AS outcome, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders GROUP BY 1, 2",
    "revenue_by_nation": "SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 0) AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name",
}
