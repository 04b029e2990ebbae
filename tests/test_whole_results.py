"""Results that were cut, or left to chance, and work that grew with repeated names."""

from __future__ import annotations

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from signalmill.functions import blocks
from signalmill.functions.fuzzy import weighted_ratio
from signalmill.operators import blocking, dedup, dossiers, profiles, resolution
from signalmill.plans import catalog
from signalmill.sources import sinks


def test_a_map_shows_every_point(spark, tmp_path):
    places = spark.range(6001).selectExpr("concat('n ', id) AS name", "CAST(id % 90 AS double) AS lat", "CAST(id % 180 AS double) AS lon", "CAST(id AS double) AS score")
    sinks.write_map(places, f"file://{tmp_path}/map.html")
    page = (tmp_path / "map.html").read_text()
    assert page.count("<circle") == 6001 and page.index("<title>n 6000 ") < page.index("<title>n 5999 ")
    assert page.startswith("<!DOCTYPE html>") and page.endswith("</svg>")


def test_links_at_one_place_go_by_their_url(spark):
    rows = [("http://a", 0, "/tb"), ("http://a", 0, "/ta"), ("http://a", 1, "/u2"), ("http://a", 1, "/u1"), ("http://a", 1, "/ab")]
    wanted = {"t": "^/t", "vowel": "^/[eiou]", "a": "^/a"}
    for some in (rows, rows[::-1]):
        links = spark.createDataFrame(some, "site string, place int, url string").coalesce(1)
        assert {(r.url, r.category) for r in profiles.pages_to_visit(links, wanted, 2).collect()} == {("/ta", "t"), ("/ab", "a")}


def like_sql(spark, folder, name: str, **tables) -> None:
    """Holds a query to its SQL on small tables made for it."""
    con = duckdb.connect()
    for table, rows in tables.items():
        rows.coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got, want = catalog.queries()[name](spark, str(folder)), con.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(map(str, got.select(*columns).collect())) == sorted(str(spark.createDataFrame([r], got.select(*columns).schema).first()) for r in want.fetchall())


def test_a_pass_looks_at_all_names_of_a_first_word(spark, tmp_path):
    parts = spark.range(2100).selectExpr("id AS p_partkey", "concat('red z', lpad(id, 4, '0')) AS p_name", "'Brand#1' AS p_brand", "'LARGE' AS p_type")
    like_sql(spark, tmp_path, "resolved_by_edits", part=parts, supplier=spark.createDataFrame([(2099,), (2098,)], "s_suppkey long"))


def counted(spark):
    """The weighted similarity of two columns, and how many pairs it was asked for."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def score(a, b):
        seen.add(1)
        return weighted_ratio(a, b) if a and b else 0.0

    return score.asNondeterministic(), seen


@pytest.mark.parametrize("how", ["first pass", "three passes"])
def test_equal_names_are_compared_once(spark, how):
    asked = spark.range(40).selectExpr("id AS query_id", "concat('red gear ', id % 2) AS name", "concat('c', id % 3) AS city")
    names = spark.range(60).selectExpr("id", "concat('red gear ', id % 3) AS name", "id % 7 = 0 AS retired")
    cities = names.selectExpr("id", "concat('c', id % 3) AS city")
    score, seen = counted(spark)
    run = resolution.resolve if how == "three passes" else resolution.decisions_under
    got = run(asked, names if how == "three passes" else names.drop("retired"), cities, score=score(F.col("asked"), F.col("name")))
    assert len(got.collect()) == 40
    assert 0 < seen.value <= 2 * 3 * (5 if how == "three passes" else 2)


def test_best_ids_are_those_of_all_names(spark):
    """Ids of several names, names of several ids, and a limit within a name's ids."""
    names = [(k, f"red {w}") for k in range(30) for w in {f"gear{k % 4}", f"gears{k % 3}", "ring"}] + [(k, "redder gear1") for k in range(6)]
    asked = [(0, "red gear1"), (1, "red gear1"), (2, "red rings"), (3, "blue"), (4, ""), (5, None), (6, "redd gear1")]
    known, wanted = spark.createDataFrame(names, "id int, name string"), spark.createDataFrame(asked, "query_id int, name string")
    for limit in (None, 7, 40):
        listed = sorted((n, k) for k, n in names)
        want = set()
        for q, name in asked:
            met = [(n, k) for n, k in listed if name and n.startswith(name.split(" ")[0])][:limit]
            best = {}
            for n, k in met:
                best[k] = max(best.get(k, 0.0), weighted_ratio(name, n))
            want |= {(q, k, round(s, 6)) for s, k in sorted((-s, k) for k, s in best.items())[:5] for s in [-s]}
        got = {(r.query_id, r.id, round(r.score, 6)) for r in resolution.best_by_prefix(wanted, known, limit).collect()}
        assert got == want


def test_signals_of_one_name_and_city_are_compared_once(spark):
    signals = spark.range(60).selectExpr("id AS signal_id", "concat('red gears ', id % 2) AS name", "CASE WHEN id % 3 > 0 THEN 'c' END AS city", "CAST(null AS string) AS company_no", "DATE'2024-01-01' AS detected_at")
    companies = spark.range(50).selectExpr("id AS company_id", "CAST(null AS string) AS id", "concat('red gear ', id % 2) AS name", "CASE WHEN id % 5 > 0 THEN 'c' END AS city")
    decisions = spark.createDataFrame([], "query_id long, id string, family string")
    score, seen = counted(spark)
    placed, _ = dossiers.find_or_create(signals, companies, decisions, lambda a, b, ca, cb: dedup.pair_score(a, b, ca, cb, score))
    got = {(r.signal_id, r.company_id) for r in placed.collect()}
    alike = lambda s, c: weighted_ratio(f"red gears {s % 2}", f"red gear {c % 2}") + (5 if s % 3 and c % 5 else 0)
    assert got == {(s, min(range(50), key=lambda c: (-min(100.0, alike(s, c)), c))) for s in range(60)}
    assert 0 < seen.value <= 4 * 4


def test_candidates_with_places_kept_are_looked_up_once_for_the_same_words(spark):
    names = spark.range(400).selectExpr("id", "concat(element_at(array('red', 'blue', 'reddish'), CAST(id % 3 + 1 AS int)), ' gear ', id % 7, ' x', id % 11) AS name")
    asked = spark.range(90).selectExpr("id AS query_id", "CASE WHEN id = 3 THEN '' WHEN id = 4 THEN 'unknown' WHEN id = 5 THEN null ELSE concat('red bolt ', id % 7, ' x', id % 11) END AS name")
    first = blocking.by_prefix(names, asked).select("query_id", "id", "name")
    index = blocking.word_index(names)
    other = blocking.by_rarest_word(asked, index, blocking.word_frequency(index), 20).join(names, "id").select("query_id", "id", "name")
    want = sorted(map(tuple, blocking.with_reserve(first, other, 20).select("query_id", "id").collect()))
    assert sorted(map(tuple, blocking.reserved(asked, names, 20, 20).collect())) == want


def test_what_an_explode_made_is_not_broadcast(spark):
    names = spark.createDataFrame([(k, f"red gear {k}") for k in range(50)], "id int, name string")
    index = blocking.word_index(names)
    for found in (blocking.by_fragment(names, names.withColumnRenamed("id", "query_id"), 5), blocking.by_rarest_word(names.withColumnRenamed("id", "query_id"), index, blocking.word_frequency(index), 3)):
        plan = found._jdf.queryExecution().sparkPlan().toString()
        sides = [x for x in plan.splitlines() if "BroadcastHashJoin" in x]
        assert not sides


def test_pairs_of_a_directory_come_once_without_a_distinct_over_them(spark):
    directory = spark.createDataFrame([(1, "RED GEAR // Bolt"), (2, "bolt"), (3, "bolt//Red  gear"), (4, "none"), (5, "")], "entry int, names string")
    names = spark.createDataFrame([(7, "red gear"), (7, "bolt"), (8, "bolt"), (8, "bolt"), (9, "else"), (10, None)], "id int, name string")
    got = profiles.overlapping_directories(directory, names)
    assert sorted(map(tuple, got.collect())) == [(7, 1), (7, 2), (7, 3), (8, 1), (8, 2), (8, 3)]
    assert not re.search(r"keys=\[id#\d+L?, entry#", got._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("kind", [blocks.Weighted, blocks.Edits])
def test_scores_of_blocks_are_those_of_pairs(kind):
    one = weighted_ratio if kind is blocks.Weighted else lambda a, b: round(100 * (1 - blocks._distance(a, b) / max(len(a), len(b))) + 1e-9, 4)
    for seed, letters in enumerate(("abcde", "abé ñxyz", "ab")):
        draw = random.Random(seed)
        words = ["".join(draw.choice(letters) for _ in range(draw.randint(1, 9))) for _ in range(30)]
        left, right = ([" ".join(draw.choice(words) for _ in range(draw.randint(1, 5))) for _ in range(n)] for n in (20, 40))
        left, right = [*left, "x" * 75, "b a "], [*right, "x" * 70, "x" * 80 + " y", " a  b ", "a b"]
        told = {(i, j): one(a, b) for i, a in enumerate(left) for j, b in enumerate(right)}
        for least in (0.0, 60.0, 85.0):
            found = {(i, j): s for i, j, s in zip(*(x.tolist() for x in blocks.pairs(kind, left, right, least)), strict=True)}
            assert found == {k: s for k, s in told.items() if s >= least}
        best = sorted(zip(*(x.tolist() for x in blocks.pairs(kind, left, right, 50.0, 3)), strict=True))
        assert best == sorted((i, j, -s) for i in range(len(left)) for s, j in sorted((-told[i, j], j) for j in range(len(right)) if told[i, j] >= 50)[:3])


def test_links_and_duplicates_are_those_of_all_pairs(spark):
    draw = random.Random(3)
    names = [" ".join(draw.choice(["red", "reddish", "gear", "ring", "co", "nord", "sud"]) for _ in range(draw.randint(1, 3))) for _ in range(60)] + ["1234 5678 canada", "1234 5679 canada"] * 2
    rows = [(k, n, draw.choice(["x", " X", "y", "", None]), draw.choice([["QC"], ["ON"], ["QC", "ON"], [], None])) for k, n in enumerate([*names, "", None])]
    pool = spark.createDataFrame(rows, "company_id int, name string, city string, provinces array<string>")
    lacks = lambda p, q: p is not None and q is not None and bool(set(q) - set(p))
    links = {}
    for k, n, _, p in rows:
        found = sorted((-weighted_ratio(n, m), j) for j, m, _, q in rows if n and m and j != k and lacks(p, q) and weighted_ratio(n, m) >= 80)
        links |= {(min(k, j), max(k, j)): -s for s, j in found[:3]}
    assert {(r.a, r.b): r.score for r in dedup.cross_province(pool).collect()} == links
    own = lambda c: (c or "").strip().lower()
    alike = {}
    for k, n, c, _ in rows:
        for j, m, d, _ in rows:
            if k < j and n and m and (n.startswith(m.split(" ")[0]) or m.startswith(n.split(" ")[0])) and not (n[0] == "1" and m[0] == "1" and n != m):
                alike[k, j] = min(100.0, weighted_ratio(n, m) + (5 if own(c) and own(c) == own(d) else 0))
    assert {(r.older, r.younger): r.score for r in dedup.candidate_pairs(pool).collect()} == {k: s for k, s in alike.items() if s >= 90}
