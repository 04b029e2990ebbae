"""Snapshots compared, with their safeguards."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalmill.operators import diff
from signalmill.plans.views import SNAPSHOTS, Query, orders_after, orders_before, table

RELEVANT = ["holder", "priority", "status"]


def snapshot_changes(spark, sf_dir):
    """Every key that appeared, disappeared or changed, with the fields that did."""
    found = diff.changes(orders_before(spark, sf_dir), orders_after(spark, sf_dir), ["key"], RELEVANT)
    return found.select("key", "change", F.array_join(F.coalesce("fields", F.array().cast("array<string>")), ",").alias("fields"))


def snapshot_volumes(spark, sf_dir):
    """Counts and percentages of the changes, and whether they reach thresholds of
    a hundred rows and one per cent."""
    found = diff.changes(orders_before(spark, sf_dir), orders_after(spark, sf_dir), ["key"], RELEVANT)
    whole = orders_before(spark, sf_dir).agg(F.count("*").alias("whole"))
    told = found.groupBy("change").agg(F.count("*").alias("n")).join(F.broadcast(whole), F.lit(True))
    percent = 100.0 * F.col("n") / F.col("whole")
    return told.select("change", "n", F.round(percent, 4).alias("percent"), ((F.col("n") >= 100) & (percent >= 1.0)).alias("exceeded"))


def snapshot_run(spark, sf_dir):
    """A guarded run on the registry's snapshots: the state it leaves, by status."""
    out = diff.run(orders_before(spark, sf_dir), orders_after(spark, sf_dir), ["key"], RELEVANT, earlier_runs=9)
    return out.state.groupBy("status").agg(F.count("*").alias("n"), F.lit(out.status).alias("outcome"))


def key_duplicates(spark, sf_dir):
    """Surplus line items of equal key, identical and divergent."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return diff.duplicate_keys(l, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity"])


def one_per_key(spark, sf_dir):
    """Keys left after duplicates go, by return flag counts of lines and keys."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    kept = diff.one_per_key(l.select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey", "l_linenumber"], ["l_partkey"])
    return kept.groupBy("l_linenumber").agg(F.count("*").alias("keys"))


_JOURNAL = "journal AS (SELECT concat('s', o_custkey % 20) AS source, CASE WHEN o_orderstatus = 'F' THEN 'quarantined' ELSE 'accepted' END AS status, CAST(month(o_orderdate) AS VARCHAR) AS cycle, o_totalprice / 10000 AS appeared_percent, o_totalprice / 20000 AS disappeared_percent, o_totalprice / 40000 AS modified_percent FROM orders)"


def _journal(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.concat(F.lit("s"), (F.col("o_custkey") % 20).cast("string")).alias("source"), F.when(F.col("o_orderstatus") == "F", "quarantined").otherwise("accepted").alias("status"), F.month("o_orderdate").cast("string").alias("cycle"), (F.col("o_totalprice") / 10000).alias("appeared_percent"), (F.col("o_totalprice") / 20000).alias("disappeared_percent"), (F.col("o_totalprice") / 40000).alias("modified_percent"))


def proposed_limits(spark, sf_dir):
    """Thresholds proposed from sources with five clean runs."""
    p = diff.proposed_limits(_journal(spark, sf_dir))
    return p.select("source", "runs", *[F.round(c, 4).alias(c) for c in ("appeared_percent", "disappeared_percent", "modified_percent")])


def simultaneous_quarantines(spark, sf_dir):
    """Cycles in which several sources were quarantined."""
    return diff.simultaneous(_journal(spark, sf_dir))


QUERIES: dict[str, Query] = {f.__name__: f for f in (snapshot_changes, snapshot_volumes, snapshot_run, key_duplicates, one_per_key, proposed_limits, simultaneous_quarantines)}

_CHANGES = f"""{SNAPSHOTS}, changes AS (
  SELECT coalesce(b.key, a.key) AS key, CASE WHEN b.key IS NULL THEN 'appeared' WHEN a.key IS NULL THEN 'disappeared' ELSE 'modified' END AS change,
         CASE WHEN b.key IS NULL OR a.key IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.holder IS DISTINCT FROM b.holder THEN 'holder' END, CASE WHEN a.priority IS DISTINCT FROM b.priority THEN 'priority' END, CASE WHEN a.status IS DISTINCT FROM b.status THEN 'status' END) END AS fields
  FROM before_ b FULL OUTER JOIN after_ a ON a.key = b.key
  WHERE b.key IS NULL OR a.key IS NULL OR a.holder IS DISTINCT FROM b.holder OR a.priority IS DISTINCT FROM b.priority OR a.status IS DISTINCT FROM b.status)"""

SQL = {
    "snapshot_changes": f"WITH {_CHANGES} SELECT key, change, fields FROM changes",
    "snapshot_volumes": f"WITH {_CHANGES} SELECT change, n, round(100.0 * n / whole, 4) AS percent, n >= 100 AND 100.0 * n / whole >= 1.0 AS exceeded FROM (SELECT change, count(*) AS n, (SELECT count(*) FROM before_) AS whole FROM changes GROUP BY change)",
    "snapshot_run": f"WITH {SNAPSHOTS} SELECT status, count(*) AS n, 'accepted' AS outcome FROM after_ GROUP BY status",
    "key_duplicates": "WITH k AS (SELECT count(*) AS n, count(DISTINCT concat_ws('|', l_partkey, l_suppkey, l_quantity)) AS forms FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) SELECT CAST(coalesce(sum(CASE WHEN forms = 1 THEN n - 1 END), 0) AS BIGINT) AS identical, CAST(coalesce(sum(CASE WHEN forms > 1 THEN n - 1 END), 0) AS BIGINT) AS divergent FROM k",
    "one_per_key": "SELECT l_linenumber, count(*) AS keys FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) GROUP BY l_linenumber",
    "proposed_limits": f"WITH {_JOURNAL} SELECT source, count(*) AS runs, round(max(appeared_percent) * 1.5, 4) AS appeared_percent, round(max(disappeared_percent) * 1.5, 4) AS disappeared_percent, round(max(modified_percent) * 1.5, 4) AS modified_percent FROM journal WHERE status = 'accepted' GROUP BY source HAVING count(*) >= 5",
    "simultaneous_quarantines": f"WITH {_JOURNAL} SELECT cycle, count(*) AS quarantined FROM journal WHERE status = 'quarantined' GROUP BY cycle HAVING count(*) >= 2",
}
