"""Confidence, relevance and their parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalmill.functions.numbers import freshness
from signalmill.operators import relevance, reports, scores
from signalmill.operators.relational import densest_window
from signalmill.plans.views import AS_OF, SIGNALS, Query, signals, table


def _steps(value: str, steps: list[tuple[float, float]]) -> str:
    return "CASE " + " ".join(f"WHEN {value} >= {t} THEN {s}.0" for t, s in steps) + f" ELSE {steps[-1][1]}.0 END"


_AGE = f"greatest(0.15, pow(0.5, greatest(0.0, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(detected_at)) / 1e6) / 86400.0 / 120.0))"
_SCORED = f"""
posted AS (SELECT company_id, count(*) AS posted FROM signals WHERE signal_type = 'hiring' GROUP BY company_id),
scored AS (
  SELECT s.*, CASE signal_type
    WHEN 'tender' THEN {_steps("value", scores.TENDER)}
    WHEN 'financing' THEN least(100.0, {_steps("value", scores.FINANCING)} + CASE goods WHEN 'Équipement' THEN 15.0 WHEN 'véhicule' THEN 0.0 ELSE 5.0 END)
    WHEN 'hiring' THEN CASE WHEN source = 'foreign_workers' THEN {_steps("coalesce(nullif(value, 0), posted)", scores.FOREIGN_WORKERS)} ELSE {_steps("posted", scores.HIRING)} END
    WHEN 'registry' THEN CASE change WHEN 'new_site' THEN 70.0 WHEN 'address_change' THEN 50.0 WHEN 'permit' THEN CASE nature WHEN 'Nouvelle construction' THEN 75.0 WHEN 'Amélioration' THEN 50.0 ELSE 25.0 END ELSE 20.0 END
    WHEN 'ranking' THEN greatest(50.0, {_steps("(1000 - k * 10)", scores.RANK)}, {_steps("(k * 3)", scores.GROWTH)})
    ELSE 30.0 END AS base, {_AGE} AS age
  FROM signals s LEFT JOIN posted p ON s.company_id = p.company_id)"""
_CONFIDENCE = f"""
per AS (SELECT company_id, max(base * age) AS best, count(DISTINCT signal_type) AS types, max(value) AS value FROM scored GROUP BY company_id),
confidence AS (
  SELECT company_id, best, types, least(30.0, 12.0 * (types - 1)) AS corroboration, value,
         least(100.0, best + least(30.0, 12.0 * (types - 1))) AS raw FROM per)"""
_LEVEL = "CASE WHEN raw >= 70 THEN 'high' WHEN raw >= 40 THEN 'medium' ELSE 'low' END"


def signal_scores(spark, sf_dir):
    """Every signal's base and faded score."""
    s = scores.signal_scores(signals(spark, sf_dir), AS_OF)
    return s.select("signal_id", "signal_type", "base", F.round("faded", 6).alias("faded"))


def confidence(spark, sf_dir):
    """Every company's confidence and level."""
    c = scores.confidence(signals(spark, sf_dir), AS_OF)
    return c.select("company_id", F.round("best", 6).alias("best"), "types", "corroboration", "score", "level")


def confidence_digest(spark, sf_dir):
    """The ten companies of greatest confidence, then greatest value, with the backlog."""
    s = signals(spark, sf_dir)
    notes = scores.confidence(s, AS_OF).select(F.col("company_id").alias("note_id"), "score", "level", F.lit(None).cast("timestamp").alias("sent_at"))
    tops = reports.digest(notes, s.select(F.col("company_id").alias("note_id"), "value"), 10)
    return tops.select(F.col("note_id").alias("company_id"), "score", "level", F.round("value", 4).alias("value"), "backlog")


def freshness_by_day(spark, sf_dir):
    """Mean freshness of each day's signals."""
    s = signals(spark, sf_dir).select(F.to_date("detected_at").alias("day"), freshness(F.col("detected_at"), AS_OF).alias("f"))
    return s.groupBy("day").agg(F.count("*").alias("n"), F.round(F.avg("f"), 6).alias("freshness"))


def velocity(spark, sf_dir):
    """The densest three days of each company's signals, and their bonus."""
    v = relevance.velocity_bonus(signals(spark, sf_dir), relevance.Weighting(window_days=3))
    return v.select("company_id", "densest", "velocity")


def absence(spark, sf_dir):
    """Companies without a financing signal on a day of signals."""
    s = signals(spark, sf_dir).withColumn("company_id", F.concat_ws("/", F.col("company_id").cast("string"), F.date_format("detected_at", "yyyy-MM-dd")))
    return relevance.absence_bonus(s, "financing")


_SPHERES = [("tender", ["projects", "supplies"]), ("financing", ["finance", "projects"]), ("hiring", ["people"]), ("registry", ["estate", "people"]), ("ranking", ["projects", "finance"])]
_NEEDS = [(1, "projects", 100.0), (1, "people", 50.0), (2, "finance", 100.0), (3, "estate", 80.0)]


def relevance_scores(spark, sf_dir):
    """Relevance of every company to every need: the best base of its signals,
    absence of financing, and velocity; with its grade."""
    s = signals(spark, sf_dir)
    types = spark.createDataFrame(_SPHERES, "signal_type string, spheres array<string>")
    needs = spark.createDataFrame(_NEEDS, "need_id int, sphere string, weight double")
    hits = relevance.match_needs(s, F.broadcast(types), F.broadcast(needs)).join(s.select("signal_id", (F.col("k") == 42).alias("hit")), "signal_id")
    base = hits.withColumn("base", relevance.sphere_base(F.col("hit"), F.col("is_main"), F.col("is_likely"), F.col("weight")))
    best = base.groupBy("company_id", "need_id").agg(F.max("base").alias("base"))
    told = best.join(relevance.absence_bonus(s, "financing"), "company_id").join(relevance.velocity_bonus(s, relevance.Weighting(window_days=3)), "company_id")
    raw = relevance.relevance(F.col("base"), F.lit(0.85), F.col("absence"), F.col("velocity"), F.lit(0.0))
    return told.select("company_id", "need_id", "base", F.round(raw, 4).alias("relevance"), relevance.grade(raw).alias("grade"))


def sensitivity_gates(spark, sf_dir):
    """Companies that pass each sensitivity of confidence."""
    c = scores.confidence(signals(spark, sf_dir), AS_OF)
    each = c.withColumn("sensitivity", F.explode(F.array(*[F.lit(x) for x in ("low", "medium", "high")])))
    return each.where(scores.passes(F.col("level"), F.col("sensitivity"))).groupBy("sensitivity").agg(F.count("*").alias("companies"))


def feedback(spark, sf_dir):
    """The weight that rejections (here errors of small value) leave."""
    s = signals(spark, sf_dir).where("signal_type = 'ranking' and value < 200000")
    return s.groupBy("company_id").agg(F.count("*").alias("rejections")).select("company_id", "rejections", F.round(relevance.feedback_weight(F.col("rejections")), 4).alias("weight"))


def brand_weights(spark, sf_dir):
    """Brands of each type weighted by their parts, the most frequent as 100."""
    n = table(spark, sf_dir, "part").groupBy("p_type", "p_brand").agg(F.count("*").alias("n"))
    return relevance.normalised_weights(n, ["p_type"], "n")


def tender_steps(spark, sf_dir):
    """Orders by the score that their price would have as a tender."""
    return table(spark, sf_dir, "orders").groupBy(scores.tender(F.col("o_totalprice") * 3).alias("score")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def densest_orders(spark, sf_dir):
    """The most orders that a customer placed within 60 days."""
    return densest_window(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", 60)


def who_bonus(spark, sf_dir):
    """Bonus of a shared kind of client and the sign of none, by customer."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array("c_mktsegment")).alias("kinds"))
    need = F.from_json(F.lit('[{"kind":"MACHINERY","weight":100},{"kind":"FURNITURE","weight":50}]'), "array<struct<kind:string,weight:double>>")
    w = relevance.who(F.col("kinds"), need)
    return c.select("c_custkey", w["bonus"].alias("bonus"), w["off_profile"].alias("off_profile"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (confidence_digest, signal_scores, confidence, freshness_by_day, velocity, absence, relevance_scores, sensitivity_gates, feedback, brand_weights, tender_steps, densest_orders, who_bonus)}

_SPHERE_ROWS = ", ".join(f"('{t}', '{s}', {str(i == 0).lower()})" for t, ss in _SPHERES for i, s in enumerate(ss))
_NEED_ROWS = ", ".join(f"({n}, '{s}', {w})" for n, s, w in _NEEDS)
_VELOCITY = "held AS (SELECT company_id, count(*) OVER (PARTITION BY company_id ORDER BY detected_at RANGE BETWEEN CURRENT ROW AND INTERVAL 3 DAYS FOLLOWING) AS n FROM signals),\nvelocity AS (SELECT company_id, max(n) AS densest, least(24.0, 8.0 * (max(n) - 1)) AS velocity FROM held GROUP BY company_id)"

SQL = {
    "confidence_digest": f"WITH {SIGNALS},{_SCORED},{_CONFIDENCE} SELECT company_id, round(raw, 1) AS score, {_LEVEL} AS level, round(value, 4) AS value, (SELECT count(*) FROM confidence) AS backlog FROM confidence ORDER BY round(raw, 1) DESC, value DESC NULLS LAST, company_id LIMIT 10",
    "signal_scores": f"WITH {SIGNALS},{_SCORED} SELECT signal_id, signal_type, base, round(base * age, 6) AS faded FROM scored",
    "confidence": f"WITH {SIGNALS},{_SCORED},{_CONFIDENCE} SELECT company_id, round(best, 6) AS best, types, corroboration, round(raw, 1) AS score, {_LEVEL} AS level FROM confidence",
    "freshness_by_day": f"WITH {SIGNALS} SELECT CAST(detected_at AS DATE) AS day, count(*) AS n, round(avg({_AGE}), 6) AS freshness FROM signals GROUP BY CAST(detected_at AS DATE)",
    "velocity": f"WITH {SIGNALS},{_VELOCITY} SELECT company_id, densest, velocity FROM velocity",
    "absence": f"WITH {SIGNALS} SELECT concat(company_id, '/', strftime(detected_at, '%Y-%m-%d')) AS company_id, CASE WHEN max(CASE WHEN signal_type = 'financing' THEN 1 ELSE 0 END) = 1 THEN 0.0 ELSE 15.0 END AS absence FROM signals GROUP BY 1",
    "relevance_scores": f"""WITH {SIGNALS},{_VELOCITY},
spheres(signal_type, sphere, is_main) AS (VALUES {_SPHERE_ROWS}), needs(need_id, sphere, weight) AS (VALUES {_NEED_ROWS}),
absent AS (SELECT company_id, CASE WHEN max(CASE WHEN signal_type = 'financing' THEN 1 ELSE 0 END) = 1 THEN 0.0 ELSE 15.0 END AS absence FROM signals GROUP BY company_id),
bases AS (SELECT s.company_id, n.need_id, max(CASE WHEN s.k = 42 THEN 90.0 WHEN p.is_main THEN 60.0 * n.weight / 100 ELSE 30.0 * n.weight / 100 END) AS base
          FROM signals s JOIN spheres p ON s.signal_type = p.signal_type JOIN needs n ON p.sphere = n.sphere GROUP BY s.company_id, n.need_id),
raws AS (SELECT b.company_id, b.need_id, b.base, least(100.0, b.base * 0.85 + a.absence + v.velocity) AS raw FROM bases b JOIN absent a ON b.company_id = a.company_id JOIN velocity v ON b.company_id = v.company_id)
SELECT company_id, need_id, base, round(raw, 4) AS relevance, CASE WHEN raw >= 80 THEN 'AAA' WHEN raw >= 50 THEN 'AA' ELSE 'A' END AS grade FROM raws""",
    "sensitivity_gates": f"""WITH {SIGNALS},{_SCORED},{_CONFIDENCE}, levels AS (SELECT {_LEVEL} AS level FROM confidence),
gates(sensitivity, level) AS (VALUES ('low', 'high'), ('medium', 'high'), ('medium', 'medium'), ('high', 'high'), ('high', 'medium'), ('high', 'low'))
SELECT sensitivity, count(*) AS companies FROM gates JOIN levels ON gates.level = levels.level GROUP BY sensitivity""",
    "feedback": f"WITH {SIGNALS} SELECT company_id, count(*) AS rejections, round(greatest(0.4, 1.0 - 0.15 * count(*)), 4) AS weight FROM signals WHERE signal_type = 'ranking' AND value < 200000 GROUP BY company_id",
    "brand_weights": "SELECT p_type, p_brand, n, round(100.0 * n / max(n) OVER (PARTITION BY p_type), 1) AS weight FROM (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY p_type, p_brand)",
    "tender_steps": f"SELECT score, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM (SELECT o_totalprice, {_steps('o_totalprice * 3', scores.TENDER)} AS score FROM orders) GROUP BY score",
    "densest_orders": "SELECT o_custkey, max(n) AS densest FROM (SELECT o_custkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN CURRENT ROW AND INTERVAL 60 DAYS FOLLOWING) AS n FROM orders) GROUP BY o_custkey",
    "who_bonus": "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 0.0 WHEN c_mktsegment = 'MACHINERY' THEN 12.0 WHEN c_mktsegment = 'FURNITURE' THEN 6.0 ELSE 0.0 END AS bonus, c_custkey % 4 <> 0 AND c_mktsegment NOT IN ('MACHINERY', 'FURNITURE') AS off_profile FROM customer",
}
