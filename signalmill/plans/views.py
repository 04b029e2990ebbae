"""The driver's tables in the roles that the operators know.

Events are signals of companies (users), orders are a registry's snapshots,
parts are its names. Each view has its SQL twin, used as a common table
expression by the queries' SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmill.functions.fuzzy import edit_similarity

AS_OF = datetime(2024, 2, 15)
TYPES = {"purchase": "tender", "click": "financing", "signup": "registry", "view": "hiring", "error": "ranking"}

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])[F.col("event_type")]
    change = F.element_at(F.array(F.lit("new_site"), F.lit("address_change"), F.lit("permit"), F.lit("other")), k % 4 + 1)
    nature = F.when(k % 3 == 0, "Nouvelle construction").when(k % 3 == 1, "Amélioration").otherwise("Occupation")
    fields = F.create_map(F.lit("k"), k.cast("string"), F.lit("goods"), F.when(k % 5 == 0, "Équipement").when(k % 5 == 1, "véhicule").otherwise("autre"), F.lit("change"), change, F.lit("nature"), nature, F.lit("rank"), (k * 10).cast("string"), F.lit("growth"), (k * 3).cast("string"))
    source = F.when((kind == "hiring") & (k % 6 == 0), "foreign_workers").otherwise(F.concat(F.lit("source"), (k % 7).cast("string")))
    return e.select(F.col("event_id").alias("signal_id"), F.col("user_id").alias("company_id"), kind.alias("signal_type"), source.alias("source"), (F.col("value") * 2500).alias("value"), F.col("ts").alias("detected_at"), k.alias("k"), fields.alias("fields"))


_CASES = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in TYPES.items())
SIGNALS = f"""
raw_signals AS (
  SELECT event_id AS signal_id, user_id AS company_id, CASE event_type {_CASES} END AS signal_type, value * 2500 AS value, ts AS detected_at,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
signals AS (
  SELECT *, CASE WHEN signal_type = 'hiring' AND k % 6 = 0 THEN 'foreign_workers' ELSE concat('source', k % 7) END AS source,
         CASE k % 5 WHEN 0 THEN 'Équipement' WHEN 1 THEN 'véhicule' ELSE 'autre' END AS goods,
         CASE k % 4 WHEN 0 THEN 'new_site' WHEN 1 THEN 'address_change' WHEN 2 THEN 'permit' ELSE 'other' END AS change,
         CASE k % 3 WHEN 0 THEN 'Nouvelle construction' WHEN 1 THEN 'Amélioration' ELSE 'Occupation' END AS nature FROM raw_signals)"""


def orders_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_custkey").alias("holder"))


def orders_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next snapshot: some keys gone, some statuses changed, some keys new."""
    old = orders_before(spark, sf_dir)
    kept = old.where("key % 97 <> 0").withColumn("status", F.when(F.col("key") % 89 == 0, "X").otherwise(F.col("status"))).withColumn("priority", F.when(F.col("key") % 178 == 0, F.lit(None)).otherwise(F.col("priority")))
    new = old.where("key % 53 = 0").withColumn("key", F.col("key") + 10_000_000)
    return kept.unionByName(new)


SNAPSHOTS = """
before_ AS (SELECT o_orderkey AS key, o_orderstatus AS status, o_orderpriority AS priority, o_custkey AS holder FROM orders),
after_ AS (
  SELECT key, CASE WHEN key % 89 = 0 THEN 'X' ELSE status END AS status, CASE WHEN key % 178 = 0 THEN NULL ELSE priority END AS priority, holder FROM before_ WHERE key % 97 <> 0
  UNION ALL SELECT key + 10000000, status, priority, holder FROM before_ WHERE key % 53 = 0)"""


def registry_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, retired) of parts: a name of two words and their brand's."""
    p = table(spark, sf_dir, "part")
    name = F.concat_ws(" ", "p_name", F.lower("p_type"), F.replace(F.lower("p_brand"), F.lit("#"), F.lit(" ")))
    return p.select(F.col("p_partkey").alias("id"), name.alias("name"), (F.col("p_partkey") % 11 == 0).alias("retired"))


def dirty_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, name, city) of detected names: one for each supplier, the
    registry's name of the same number, damaged by a rule (a word dropped, a word
    added, or a letter doubled)."""
    n = registry_names(spark, sf_dir).join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")), "id")
    dropped = F.regexp_replace("name", " [^ ]+$", "")
    name = F.when(F.col("id") % 3 == 0, dropped).when(F.col("id") % 3 == 1, F.concat("name", F.lit(" inc"))).otherwise(F.regexp_replace("name", "l", "ll"))
    return n.select(F.col("id").alias("query_id"), name.alias("name"), F.concat(F.lit("city"), (F.col("id") % 5).cast("string")).alias("city"))


NAMES = """
names AS (SELECT p_partkey AS id, concat_ws(' ', p_name, lower(p_type), replace(lower(p_brand), '#', ' ')) AS name, p_partkey % 11 = 0 AS retired FROM part),
asked AS (
  SELECT id AS query_id, concat('city', id % 5) AS city,
         CASE id % 3 WHEN 0 THEN regexp_replace(name, ' [^ ]+$', '') WHEN 1 THEN concat(name, ' inc') ELSE replace(name, 'l', 'll') END AS name
  FROM names JOIN supplier ON s_suppkey = id)"""


def cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("city"), (F.col("p_partkey") % 5).cast("string")).alias("city"))


edit_score = edit_similarity
EDIT_SCORE = "round(100.0 * (1 - levenshtein({a}, {b}) / greatest(length({a}), length({b}))), 4)"
