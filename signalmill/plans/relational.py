"""Lookups, state changes, set operations and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalmill.operators import blocking, graph, ranges, relational, resolution
from signalmill.plans.views import NAMES, SIGNALS, SNAPSHOTS, Query, dirty_names, orders_after, orders_before, registry_names, signals, table


def exact_names(spark, sf_dir):
    """Detected names that the registry has letter by letter."""
    n = registry_names(spark, sf_dir)
    asked = dirty_names(spark, sf_dir).select(F.regexp_replace("name", " inc$", "").alias("name"), "query_id")
    return asked.join(n.where("not retired"), "name").select("query_id", "id", "name")


def prefix_lookup(spark, sf_dir):
    """The first 50 registry names from each detected name's first word on."""
    return blocking.by_prefix(registry_names(spark, sf_dir).select("id", "name"), dirty_names(spark, sf_dir), 50)


def fragment_lookup(spark, sf_dir):
    """The same by the first six characters anywhere in the name."""
    return blocking.by_fragment(registry_names(spark, sf_dir).select("id", "name"), dirty_names(spark, sf_dir), 50)


def big_orders_of_known(spark, sf_dir):
    """Customers with an order of over 450 000, by a semi-join."""
    o = table(spark, sf_dir, "orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(o, "c_custkey", "left_semi").select("c_custkey", "c_name", "c_nationkey")


def without_orders(spark, sf_dir):
    """Customers that ordered nothing after 2000, by an anti-join."""
    o = table(spark, sf_dir, "orders").where("o_orderdate >= timestamp '2000-01-01'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(o, "c_custkey", "left_anti").select("c_custkey", "c_acctbal")


def both_words(spark, sf_dir):
    """Ids whose names hold both of two words: an intersection of postings."""
    index = blocking.word_index(registry_names(spark, sf_dir))
    return index.where("word = 'red'").select("id").intersect(index.where("word = 'economy'").select("id"))


def name_words(spark, sf_dir):
    """The inverted index of the registry's words."""
    return blocking.word_index(registry_names(spark, sf_dir))


def word_counts(spark, sf_dir):
    """How many ids each word has."""
    return blocking.word_frequency(blocking.word_index(registry_names(spark, sf_dir)))


def all_values(spark, sf_dir):
    """Amounts of both kinds one after the other."""
    a = table(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_acctbal").alias("amount"))
    return a.unionByName(table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_acctbal").alias("amount")))


def upserted_state(spark, sf_dir):
    """State after the next snapshot's rows are written over it."""
    return relational.upsert(orders_before(spark, sf_dir), orders_after(spark, sf_dir), ["key"], [F.col("holder")]).groupBy("status").agg(F.count("*").alias("n"), F.sum("key").alias("keys"))


def inserted_state(spark, sf_dir):
    """State with only the new keys added: the first writer wins."""
    return relational.insert_absent(orders_before(spark, sf_dir), orders_after(spark, sf_dir), ["key"], [F.col("holder")]).groupBy("status").agg(F.count("*").alias("n"), F.sum("key").alias("keys"))


def deleted_state(spark, sf_dir):
    """State without the keys that the next snapshot lacks."""
    gone = orders_before(spark, sf_dir).join(orders_after(spark, sf_dir).select("key"), "key", "left_anti")
    return relational.delete(orders_before(spark, sf_dir), gone, ["key"]).groupBy("priority").agg(F.count("*").alias("n"))


def greatest_order_value(spark, sf_dir):
    """Each customer with its greatest order, null without one; nulls last."""
    most = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("most"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(most, "c_custkey", "left").orderBy("c_nationkey", F.desc_nulls_last("most"), "c_custkey").limit(100)


def uncovered_signals(spark, sf_dir):
    """Signals that no notification (here: of value over a million) covers."""
    s = signals(spark, sf_dir)
    covered = s.where("value > 1000000").select("company_id", F.to_date("detected_at").alias("day"))
    return s.select("signal_id", "company_id", F.to_date("detected_at").alias("day")).join(covered, ["company_id", "day"], "left_anti")


def links_both_ways(spark, sf_dir):
    """Number of partners of each part: pairs of parts and suppliers seen from both sides."""
    pairs = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("a"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("b")).distinct()
    return graph.both_ways(pairs, "a", "b").groupBy("a").agg(F.count("*").alias("partners"))


def latest_signal(spark, sf_dir):
    """The latest signal of each company and type."""
    s = signals(spark, sf_dir).select("company_id", "signal_type", "signal_id", "value", "detected_at")
    return relational.latest(s, ["company_id", "signal_type"], [F.col("detected_at").desc(), F.col("signal_id").desc()])


def counts_by_condition(spark, sf_dir):
    """Several counts of one pass."""
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count_if(F.col("o_totalprice") > 250000).alias("large"))


def repeated_names(spark, sf_dir):
    """Names that several parts have."""
    return table(spark, sf_dir, "part").groupBy("p_name").agg(F.count("*").alias("n")).where("n > 1")


def prefix_by_status(spark, sf_dir):
    """Orders by the first digits of their key and by status."""
    return table(spark, sf_dir, "orders").groupBy(F.substring(F.lpad(F.col("o_orderkey").cast("string"), 8, "0"), 1, 5).alias("prefix"), "o_orderstatus").agg(F.count("*").alias("n"))


def date_range(spark, sf_dir):
    """First and last order of each status."""
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))


def same_in_any_case(spark, sf_dir):
    """Segments that equal a part's type in any case, with parts and customers."""
    c = table(spark, sf_dir, "customer").groupBy(F.lower("c_mktsegment").alias("word")).agg(F.count("*").alias("customers"))
    p = table(spark, sf_dir, "part").groupBy(F.lower("p_type").alias("word")).agg(F.count("*").alias("parts"))
    return c.join(p, "word", "full_outer").select("word", "customers", "parts")


def previous_state(spark, sf_dir):
    """Statuses before and after of the keys that both snapshots have."""
    old = orders_before(spark, sf_dir).select("key", F.col("status").alias("before"))
    return orders_after(spark, sf_dir).select("key", F.col("status").alias("after")).join(old, "key").groupBy("before", "after").agg(F.count("*").alias("n"))


def distinct_pairs(spark, sf_dir):
    """Different pairs of status and priority."""
    return table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority").distinct()


def out_of_territory(spark, sf_dir):
    """Companies to delete: seen by a source, outside the nations allowed, and with
    no signal from another source."""
    s = signals(spark, sf_dir)
    c = table(spark, sf_dir, "customer").where("c_nationkey not in (0, 1, 2, 3)").select(F.col("c_custkey").alias("company_id"))
    seen = s.where("source = 'source3'").select("company_id").distinct().join(c, "company_id", "left_semi")
    return seen.join(s.where("source <> 'source3' and value > 1150000").select("company_id"), "company_id", "left_anti")


def spread_sample(spark, sf_dir):
    """Twelve signals of each type at equal steps of their order."""
    return relational.spread_sample(signals(spark, sf_dir).select("signal_type", "signal_id"), [F.col("signal_id")], 12, ["signal_type"])


def until_known(spark, sf_dir):
    """Signals of each company, newest first, up to five known ones in a row."""
    s = signals(spark, sf_dir).select("company_id", "signal_id")
    return relational.until_known_run(s, s.where("signal_id % 3 <> 0"), "signal_id", [F.col("signal_id").desc()], 5, ["company_id"])


def longest_streaks(spark, sf_dir):
    """Each company's longest run of signals without a tender."""
    s = signals(spark, sf_dir).select("company_id", "signal_id", "signal_type")
    told = relational.consecutive(s, ["company_id"], [F.col("signal_id")], F.col("signal_type") != "tender", F.col("signal_type") == "tender")
    return told.groupBy("company_id").agg(F.max("streak").alias("streak"))


def signups_before(spark, sf_dir):
    """Each purchase with its user's latest signup until then."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    found = ranges.as_of(e.where("event_type = 'purchase'"), e.where("event_type = 'signup'"), ["user_id"], "ts", "signup", ("event_id",))
    return found.select("event_id", F.col("signup.event_id").alias("signup_id"))


def orders_open_together(spark, sf_dir):
    """Pairs of a customer's orders that are open on a same day; every tenth order is open for years."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    open_ = F.when(F.col("o_orderkey") % 10 == 0, F.lit(1500)).otherwise(F.col("o_orderkey") % 200).cast("int")
    o = o.withColumn("closed", F.col("o_orderdate") + F.make_interval(days=open_))
    pairs = ranges.overlapping(o, o, "o_orderdate", "closed", ["o_custkey"])
    return pairs.where("a.o_orderkey < b.o_orderkey").select(F.col("a.o_orderkey").alias("first"), F.col("b.o_orderkey").alias("second"))


def lines_in_seasons(spark, sf_dir):
    """Lines shipped in each nation's season; seasons overlap and have no key."""
    n = F.col("n_nationkey").cast("int")
    start = F.to_timestamp(F.lit("1995-01-01")) + F.make_interval(days=n * 90)
    seasons = table(spark, sf_dir, "nation").select("n_name", start.alias("from"), (start + F.make_interval(days=n % 4 * 300)).alias("until"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").alias("from"), F.col("l_shipdate").alias("until"), "l_quantity")
    pairs = ranges.overlapping(seasons, lines, "from", "until")
    return pairs.groupBy(F.col("a.n_name").alias("n_name")).agg(F.count("*").alias("lines"), F.round(F.sum("b.l_quantity"), 2).alias("quantity"))


def first_terminal(spark, sf_dir):
    """The first final event of each company and day, null if none is."""
    s = signals(spark, sf_dir)
    final = F.when(F.col("signal_type").isin("tender", "ranking"), F.struct("signal_id", "signal_type"))
    told = s.groupBy("company_id", F.to_date("detected_at").alias("day")).agg(F.min(final).alias("first"))
    return told.select("company_id", "day", F.col("first.signal_type").alias("outcome"))


def claims(spark, sf_dir):
    """Who keeps an id: claims of orders on their customer's place of a month, by
    date; three and more cancel each other."""
    o = table(spark, sf_dir, "orders")
    asked = o.select((F.col("o_custkey") * 12 + F.month("o_orderdate")).alias("id"), F.col("o_orderkey").alias("query_id"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate")).alias("since"))
    return resolution.collisions(asked).groupBy("outcome").agg(F.count("*").alias("n"), F.sum("query_id").alias("queries"))


def repeated_text_sources(spark, sf_dir):
    """Lines of conversations that several have, with their number and first turn."""
    c = table(spark, sf_dir, "conversations")
    return c.groupBy(F.length("text").alias("length")).agg(F.count("*").alias("n"), F.count_distinct("conv_id").alias("conversations"), F.min("turn").alias("first")).where("n > 1")


QUERIES: dict[str, Query] = {f.__name__: f for f in (exact_names, prefix_lookup, fragment_lookup, big_orders_of_known, without_orders, both_words, name_words, word_counts, all_values, upserted_state, inserted_state, deleted_state, greatest_order_value, uncovered_signals, links_both_ways, latest_signal, counts_by_condition, repeated_names, prefix_by_status, date_range, same_in_any_case, previous_state, distinct_pairs, out_of_territory, spread_sample, until_known, longest_streaks, signups_before, orders_open_together, lines_in_seasons, first_terminal, claims, repeated_text_sources)}

_WORDS = "index_ AS (SELECT DISTINCT id, unnest(string_split(name, ' ')) AS word FROM names)"

SQL = {
    "exact_names": f"WITH {NAMES} SELECT a.query_id, n.id, n.name FROM asked a JOIN names n ON regexp_replace(a.name, ' inc$', '') = n.name WHERE NOT n.retired",
    "prefix_lookup": f"WITH {NAMES}, met AS (SELECT a.query_id, n.id, n.name, row_number() OVER (PARTITION BY a.query_id ORDER BY n.name, n.id) AS rank FROM asked a JOIN names n ON starts_with(n.name, split_part(a.name, ' ', 1))) SELECT * FROM met WHERE rank <= 50",
    "fragment_lookup": f"WITH {NAMES}, met AS (SELECT a.query_id, n.id, n.name, row_number() OVER (PARTITION BY a.query_id ORDER BY n.name, n.id) AS rank FROM asked a JOIN names n ON contains(n.name, substr(a.name, 1, 6))) SELECT * FROM met WHERE rank <= 50",
    "big_orders_of_known": "SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)",
    "without_orders": "SELECT c_custkey, c_acctbal FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderdate >= TIMESTAMP '2000-01-01')",
    "both_words": f"WITH {NAMES}, {_WORDS} SELECT id FROM index_ WHERE word = 'red' INTERSECT SELECT id FROM index_ WHERE word = 'economy'",
    "name_words": f"WITH {NAMES}, {_WORDS} SELECT id, word FROM index_",
    "word_counts": f"WITH {NAMES}, {_WORDS} SELECT word, count(*) AS ids FROM index_ GROUP BY word",
    "all_values": "SELECT 'customer' AS kind, c_acctbal AS amount FROM customer UNION ALL SELECT 'supplier', s_acctbal FROM supplier",
    "upserted_state": f"WITH {SNAPSHOTS}, state AS (SELECT * FROM after_ UNION ALL SELECT * FROM before_ WHERE key NOT IN (SELECT key FROM after_)) SELECT status, count(*) AS n, CAST(sum(key) AS BIGINT) AS keys FROM state GROUP BY status",
    "inserted_state": f"WITH {SNAPSHOTS}, state AS (SELECT * FROM before_ UNION ALL SELECT * FROM after_ WHERE key NOT IN (SELECT key FROM before_)) SELECT status, count(*) AS n, CAST(sum(key) AS BIGINT) AS keys FROM state GROUP BY status",
    "deleted_state": f"WITH {SNAPSHOTS} SELECT priority, count(*) AS n FROM before_ WHERE key IN (SELECT key FROM after_) GROUP BY priority",
    "greatest_order_value": "SELECT c_custkey, c_nationkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS most FROM customer ORDER BY c_nationkey, most DESC NULLS LAST, c_custkey LIMIT 100",
    "uncovered_signals": f"WITH {SIGNALS} SELECT s.signal_id, s.company_id, CAST(s.detected_at AS DATE) AS day FROM signals s WHERE NOT EXISTS (SELECT 1 FROM signals b WHERE b.value > 1000000 AND b.company_id = s.company_id AND CAST(b.detected_at AS DATE) = CAST(s.detected_at AS DATE))",
    "links_both_ways": "WITH pairs AS (SELECT DISTINCT concat('p', l_partkey) AS a, concat('s', l_suppkey) AS b FROM lineitem), ways AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs) SELECT a, count(*) AS partners FROM ways GROUP BY a",
    "latest_signal": f"WITH {SIGNALS}, ranked AS (SELECT company_id, signal_type, signal_id, value, detected_at, row_number() OVER (PARTITION BY company_id, signal_type ORDER BY detected_at DESC, signal_id DESC) AS r FROM signals) SELECT company_id, signal_type, signal_id, value, detected_at FROM ranked WHERE r = 1",
    "counts_by_condition": "SELECT o_orderpriority, count(*) AS n, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS done, count(CASE WHEN o_totalprice > 250000 THEN 1 END) AS large FROM orders GROUP BY o_orderpriority",
    "repeated_names": "SELECT p_name, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1",
    "prefix_by_status": "SELECT substr(lpad(CAST(o_orderkey AS VARCHAR), 8, '0'), 1, 5) AS prefix, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2",
    "date_range": "SELECT o_orderstatus, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders GROUP BY o_orderstatus",
    "same_in_any_case": "WITH c AS (SELECT lower(c_mktsegment) AS word, count(*) AS customers FROM customer GROUP BY 1), p AS (SELECT lower(p_type) AS word, count(*) AS parts FROM part GROUP BY 1) SELECT coalesce(c.word, p.word) AS word, customers, parts FROM c FULL OUTER JOIN p ON c.word = p.word",
    "previous_state": f"WITH {SNAPSHOTS} SELECT b.status AS before, a.status AS after, count(*) AS n FROM before_ b JOIN after_ a ON a.key = b.key GROUP BY b.status, a.status",
    "distinct_pairs": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    "out_of_territory": f"WITH {SIGNALS} SELECT DISTINCT company_id FROM signals WHERE source = 'source3' AND company_id IN (SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (0, 1, 2, 3)) AND company_id NOT IN (SELECT company_id FROM signals WHERE source <> 'source3' AND value > 1150000)",
    "spread_sample": f"WITH {SIGNALS}, placed AS (SELECT signal_type, signal_id, row_number() OVER (PARTITION BY signal_type ORDER BY signal_id) - 1 AS place, count(*) OVER (PARTITION BY signal_type) AS n FROM signals), steps AS (SELECT unnest(range(12)) AS i) SELECT DISTINCT signal_type, signal_id FROM placed JOIN steps ON place = CAST(floor(i * n / 12) AS BIGINT)",
    "until_known": f"WITH {SIGNALS}, a AS (SELECT company_id, signal_id, CASE WHEN signal_id % 3 <> 0 THEN 1 ELSE 0 END AS known FROM signals), b AS (SELECT *, sum(1 - known) OVER (PARTITION BY company_id ORDER BY signal_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM a), c AS (SELECT *, sum(known) OVER (PARTITION BY company_id, island ORDER BY signal_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS length FROM b), d AS (SELECT company_id, max(CASE WHEN length = 5 THEN signal_id END) AS stop FROM c GROUP BY company_id) SELECT c.company_id, c.signal_id FROM c JOIN d ON c.company_id = d.company_id WHERE d.stop IS NULL OR c.signal_id >= d.stop",
    "signups_before": "SELECT p.event_id, s.event_id AS signup_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') s ON p.user_id = s.user_id AND p.ts >= s.ts",
    "orders_open_together": "WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate, o_orderdate + to_days(CAST(CASE WHEN o_orderkey % 10 = 0 THEN 1500 ELSE o_orderkey % 200 END AS INTEGER)) AS closed FROM orders) SELECT a.o_orderkey AS first, b.o_orderkey AS second FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND a.o_orderdate <= b.closed AND b.o_orderdate <= a.closed",
    "lines_in_seasons": "SELECT n_name, count(*) AS lines, round(sum(l_quantity), 2) AS quantity FROM nation JOIN lineitem ON l_shipdate BETWEEN TIMESTAMP '1995-01-01' + to_days(CAST(n_nationkey * 90 AS INTEGER)) AND TIMESTAMP '1995-01-01' + to_days(CAST(n_nationkey * 90 + n_nationkey % 4 * 300 AS INTEGER)) GROUP BY n_name",
    "longest_streaks": f"WITH {SIGNALS}, a AS (SELECT company_id, signal_id, signal_type, sum(CASE WHEN signal_type = 'tender' THEN 1 ELSE 0 END) OVER (PARTITION BY company_id ORDER BY signal_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS era FROM signals), b AS (SELECT company_id, era, count(CASE WHEN signal_type <> 'tender' THEN 1 END) AS n FROM a GROUP BY company_id, era) SELECT company_id, max(n) AS streak FROM b GROUP BY company_id",
    "first_terminal": f"WITH {SIGNALS}, a AS (SELECT company_id, CAST(detected_at AS DATE) AS day, min(CASE WHEN signal_type IN ('tender', 'ranking') THEN signal_id END) AS first FROM signals GROUP BY 1, 2) SELECT a.company_id, a.day, s.signal_type AS outcome FROM a LEFT JOIN signals s ON a.first = s.signal_id",
    "claims": "WITH a AS (SELECT o_custkey * 12 + month(o_orderdate) AS id, o_orderkey AS query_id, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END AS since FROM orders), b AS (SELECT *, count(*) OVER (PARTITION BY id) AS n, row_number() OVER (PARTITION BY id ORDER BY since ASC NULLS LAST, query_id) AS r FROM a), c AS (SELECT query_id, CASE WHEN n > 2 THEN 'nobody' WHEN r = 1 THEN 'kept' ELSE 'refused' END AS outcome FROM b) SELECT outcome, count(*) AS n, CAST(sum(query_id) AS BIGINT) AS queries FROM c GROUP BY outcome",
    "repeated_text_sources": "SELECT length(text) AS length, count(*) AS n, count(DISTINCT conv_id) AS conversations, min(turn) AS first FROM conversations GROUP BY length(text) HAVING count(*) > 1",
}
