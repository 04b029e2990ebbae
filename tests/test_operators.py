"""Operators on small fixtures whose results are known."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from signalmill.functions import fuzzy, numbers, text
from signalmill.operators import blocking, dedup, diff, graph, relational, relevance, reports, resolution, scores, tiebreak


def one(spark, column, *values, names=("a", "b", "c"), types="string"):
    kinds = [types] * len(values) if isinstance(types, str) else types
    df = spark.createDataFrame([values or (None,)], ", ".join(f"{n} {t}" for n, t in zip(names, kinds or ["string"], strict=False)))
    return df.select(column.alias("x")).first().x


# -- similarity -----------------------------------------------------------------


def test_plateaus_of_the_similarity():
    assert fuzzy.weighted_ratio("9519 3801 quebec inc", "9519 3850 quebec inc") == pytest.approx(95.0)
    assert fuzzy.weighted_ratio("transport", "transport tremblay inc") == pytest.approx(90.0)
    assert fuzzy.weighted_ratio("a b", "b a") == pytest.approx(95.0)
    assert fuzzy.weighted_ratio("same", "same") == 100.0
    assert fuzzy.weighted_ratio("", "x") == 0.0
    assert fuzzy.weighted_ratio("la", "la ferme des bois du nord") == pytest.approx(60.0)


@pytest.mark.parametrize(("a", "b"), [("", ""), ("abc", "acb"), ("boulangerie", "boulanger"), ("xaybzc", "abc"), ("aaaa", "aa")])
def test_common_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert fuzzy.common_subsequence(a, b) == table[-1][-1]


def test_similarity_of_columns_takes_nulls(spark):
    df = spark.createDataFrame([("a", None), (None, None), ("ab", "ab")], "x string, y string")
    assert [r.s for r in df.select(fuzzy.similarity(F.col("x"), F.col("y")).alias("s")).collect()] == [0.0, 0.0, 100.0]


# -- text and numbers -----------------------------------------------------------


@pytest.mark.parametrize(("said", "want"), [("L'Oréal", "l oreal"), ("L’Oréal", "loreal"), ("cœur", "cur"), ("  A--b ", "a b"), (None, None), ("", ""), ("ÉCOLE 2²", "ecole 22")])
def test_normalise(spark, said, want):
    assert one(spark, text.normalise(F.col("a")), said) == want


def test_text_functions(spark):
    assert one(spark, text.postal_codes(F.col("a")), "St-Isidore, QC J0L  2A") == ["J0L"]
    assert one(spark, text.postal_codes(F.col("a")), "Montréal H2X 1Y4 and j0l2a1") == ["H2X", "H2X1Y4", "J0L", "J0L2A1"]
    assert one(spark, text.city_of_address(F.col("a")), "Laval, QC") == "Laval" and one(spark, text.city_of_address(F.col("a")), "Laval") is None
    assert one(spark, text.city_in_parentheses(F.col("a")), "Laval (Québec)") == ("Laval", "Québec")
    assert one(spark, text.city_and_province(F.col("a")), "a, b, ON") == ("a, b", "ON")
    assert one(spark, text.company_number(F.col("a")), "9519 3801 quebec inc") == "9519 3801"
    assert one(spark, text.without_legal_form(F.col("a")), "ferme du nord inc ltee") == "ferme du nord" and one(spark, text.without_legal_form(F.col("a")), "inc") == "inc"
    assert one(spark, text.has_phrase(F.col("a"), "été"), "l'ÉTÉ vient") is True and one(spark, text.has_phrase(F.col("a"), "été"), "étés") is False
    assert one(spark, text.amount(F.col("a")), 1234567.5, types="double") == "1 234 567,50 $"
    assert one(spark, text.french_date(F.col("a")), datetime(2024, 8, 1), types="timestamp") == "1er août 2024"
    assert one(spark, text.person_name(F.col("a")), "Tremblay, Jean") == "strict" and one(spark, text.person_name(F.col("a")), "Jean Tremblay") == "loose" and one(spark, text.person_name(F.col("a")), "Ferme 12 Inc") is None
    page = "<p>Call 514-555-1234 or a@b.ca<script>x@y.z</script> <a href='/t'>12 employés</a>"
    assert one(spark, text.contacts(text.visible_text(F.col("a"))), page) == ("a@b.ca", "514-555-1234", 12)
    assert one(spark, text.links(F.col("a")), page) == ["/t"]
    assert one(spark, text.activity_words(F.col("a"), ["autres"]), "Autres services de boulangerie") == ["boulangerie", "services"]


def test_normal_form_is_the_compatibility_decomposition_of_all_of_unicode(spark):
    import re
    import unicodedata

    def golden(said):
        plain = unicodedata.normalize("NFKD", said).encode("ascii", "ignore").decode()
        return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9 ]", " ", plain.lower())).strip()

    codes = [c for c in [*range(1, 0xD800), *range(0xE000, 0x110000)] if c < 0x3400 or unicodedata.decomposition(chr(c)) or c % 997 == 0]
    said = ["a" + " ".join(map(chr, codes[k : k + 40])) + "b" for k in range(0, len(codes), 40)] + ["Dvořák", "Nguyễn Ő", "Łódź Ｆｕｌｌ", "ﬁnance №5", "L'Été & Fils, inc."]
    df = spark.createDataFrame([(s,) for s in said], "a string")
    for r in df.select("a", text.normalise(F.col("a")).alias("b")).collect():
        assert r.b == golden(r.a) == text.normalised(r.a), r.a


def test_names_as_the_rules_say(spark):
    for said, want in (("Mississauga, ON L5N 0A4", ["ON"]), ("Ontario", []), ("québec qc et ab", ["AB", "QC"]), (None, [])):
        assert one(spark, text.provinces(F.col("a")), said) == want
    for said, want in (("Gagnon et Fils inc.", 1), ("X inc. & Y inc.", 2), ("gestion x inc ltee", 1), ("Pierre et Paul", 0), ("A ltée, B S.E.N.C.", 2)):
        assert one(spark, text.entities(F.col("a")), said) == want
    assert one(spark, text.without_legal_form(F.col("a")), "bell canada") == "bell canada" and one(spark, text.without_legal_form(F.col("a")), "abc societe snc") == "abc"
    _, form, legal, activity = text.NOT_A_PERSON
    for said, strict, loose in (("Lessard, Martin", "kept", form), ("Martin Lessard", form, "kept"), ("Bell Canada", form, activity), ("9528-9393 Québec inc.", form, form), ("Roy inc., Luc", legal, form), ("Ferme, Luc", activity, form), ("A, B, C", form, form), ("a b c, d", form, form), (None, form, form)):
        assert (one(spark, text.person_reason(F.col("a")), said), one(spark, text.person_reason(F.col("a"), True), said)) == (strict, loose), said
    assert one(spark, text.keyword_hits(F.col("a"), ["Chef"]), "Chef de projet – amélioration continue") == ["Chef", "amelioration continue", "chef de projet"]
    for said, want in (("1h 30min", 5400.0), ("infinity", None), ("", None), ("2 fortnights", None), ("1.5 hours", 5400.0), (None, None)):
        assert one(spark, numbers.duration(F.col("a")), said) == want
    from signalmill.operators.relevance import in_territories

    for said, want in (("Nouvelle- cosse", True), ("nouvelle écosse", True), ("Ontario", False), (" ", True), (None, True)):
        assert one(spark, in_territories(F.col("a"), ["Nouvelle-Écosse"]), said) is want


def test_numbers(spark):
    for said, want in (("1,234.50 $", 1234.5), ("12 %", 12.0), ("n/a", None), ("", None), (None, None)):
        assert one(spark, numbers.parse_number(F.col("a")), said) == want
    assert str(one(spark, numbers.quarter_date(F.col("a")), "2026Q3-list.csv")) == "2026-07-01"
    now = datetime(2024, 6, 1)
    for days, want in ((0, 1.0), (120, 0.5), (5000, 0.15), (-3, 1.0)):
        assert one(spark, numbers.freshness(F.col("a"), now), now - timedelta(days=days), types="timestamp") == pytest.approx(want)
    assert one(spark, numbers.step(F.col("a"), [(10, 3), (5, 2), (1, 1)]), 0.0, types="double") == 1.0


# -- snapshots ------------------------------------------------------------------


def snapshot(spark, rows):
    return spark.createDataFrame(rows, "key string, name string, size int")


def test_diff_run(spark):
    old = [(f"k{i}", f"n{i}", i) for i in range(20)]
    first = diff.run(None, snapshot(spark, old), ["key"], ["name", "size"])
    assert first.status == "reference" and first.changes.count() == 0 and first.state.count() == 20
    new = [(k, n, s + (k == "k3")) for k, n, s in old if k != "k0"] + [("z", None, None), ("z", None, None)]
    run = diff.run(first.state, snapshot(spark, new), ["key"], ["name", "size"], seen_schema=dict(first.state.dtypes))
    assert run.status == "accepted" and run.counts == {"appeared": 1, "disappeared": 1, "modified": 1}
    changed = {r.key: (r.change, r.fields) for r in run.changes.collect()}
    assert changed == {"k0": ("disappeared", None), "k3": ("modified", ["size"]), "z": ("appeared", None)}
    again = diff.run(run.state, snapshot(spark, list(reversed(new))), ["key"], ["name", "size"])
    assert again.counts == {}
    moved = diff.registry_signals(run.changes, "key", "size").collect()
    assert [(r.key, r.before, r.after) for r in moved] == [("k3", "3", "4")]


def test_diff_safeguards(spark):
    state = snapshot(spark, [(f"k{i}", "n", i) for i in range(20)])
    tight = diff.Limits(disappeared=diff.Threshold(10, 30.0))
    few = snapshot(spark, [(f"k{i}", "n", i) for i in range(11)])
    run = lambda **o: diff.run(state, few, ["key"], ["name", "size"], **o)
    assert run(limits=tight, earlier_runs=9).status == "accepted"  # nine gone, ten needed
    held = run(limits=tight, earlier_runs=0)  # careful: five are enough
    assert (held.status, held.motive) == ("quarantined", "disappeared") and held.state.count() == 20
    assert diff.lift(held, few, ["key"], ["name", "size"], True).count() == 11 and diff.lift(held, few, ["key"], ["name", "size"], False).count() == 20
    assert run(unreadable=6, read=100).motive == "unreadable"
    assert run(seen_schema={"key": "string", "name": "string", "size": "bigint"}).motive == "types changed"
    assert diff.run(state, few.drop("size"), ["key"], ["name", "size"], seen_schema=dict(state.dtypes)).motive == "columns removed"
    assert diff.run(state, state.withColumn("more", F.lit(1)), ["key"], ["name", "size"], seen_schema=dict(state.dtypes)).warnings == ("column added: more",)
    assert diff.run_together([held]) is False


def test_duplicates_keep_the_greatest_fingerprint(spark):
    rows = [("a", "x", 1), ("a", "x", 1), ("b", "x", 1), ("b", "y", 2), ("c", "z", 3)]
    assert tuple(diff.duplicate_keys(snapshot(spark, rows), ["key"], ["name", "size"]).first()) == (1, 1)
    kept = [tuple(r) for r in diff.one_per_key(snapshot(spark, rows), ["key"], ["name", "size"]).select("key", "name").collect()]
    other = [tuple(r) for r in diff.one_per_key(snapshot(spark, rows[::-1]), ["key"], ["name", "size"]).select("key", "name").collect()]
    assert sorted(kept) == sorted(other) and len(kept) == 3


# -- scores ---------------------------------------------------------------------

NOW = datetime(2024, 6, 1)
SIGNAL = "signal_id int, company_id int, signal_type string, source string, value double, detected_at timestamp, fields map<string,string>"


def test_confidence(spark):
    at = NOW
    rows = [(1, 1, "tender", "s", 2e6, at, {}), (2, 1, "hiring", "s", None, at, {}), (3, 1, "hiring", "s", None, at, {}), (4, 2, "hiring", "foreign_workers", 6.0, at, {}), (5, 3, "unknown", "s", None, NOW - timedelta(days=120), {}), (6, 4, "registry", "s", None, at, {"change": "new_secondary_site"}), (7, 5, "ranking", "s", None, at, {"rank": "20"}), (8, 6, "hiring", "foreign_workers", None, at, {})]
    df = spark.createDataFrame(rows, SIGNAL)
    got = {r.company_id: (r.score, r.level) for r in scores.confidence(df, NOW).collect()}
    assert got == {1: (97.0, "high"), 2: (90.0, "high"), 3: (15.0, "low"), 4: (70.0, "high"), 5: (90.0, "high"), 6: (65.0, "medium")}
    each = {r.signal_id: r.base for r in scores.signal_scores(df, NOW).collect()}
    assert each == {1: 85.0, 2: 45.0, 3: 45.0, 4: 90.0, 5: 30.0, 6: 70.0, 7: 90.0, 8: 65.0}
    bonus = spark.createDataFrame([(3, 99.0)], "company_id int, bonus double")
    assert {r.company_id: r.expansion for r in scores.confidence(df, NOW, bonus).collect()}[3] == 15.0
    assert one(spark, scores.passes(F.col("a"), F.col("b")), "medium", "low") is False


def test_relevance(spark):
    at = [NOW + timedelta(days=d) for d in (0, 10, 59, 200)]
    df = spark.createDataFrame([(i, 1, "tender", "s", None, t, {}) for i, t in enumerate(at)] + [(9, 2, "financing", "s", None, NOW, {})], SIGNAL)
    assert {r.company_id: (r.densest, r.velocity) for r in relevance.velocity_bonus(df).collect()} == {1: (3, 16.0), 2: (1, 0.0)}
    assert {r.company_id: r.absence for r in relevance.absence_bonus(df, "financing").collect()} == {1: 15.0, 2: 0.0}
    assert one(spark, relevance.feedback_weight(F.col("a")), 9, types="int") == pytest.approx(0.4)
    assert one(spark, relevance.in_territories(F.col("a"), ["Québec"]), "quebec") is True and one(spark, relevance.in_territories(F.col("a"), ["Québec"]), "Qu bec") is True
    assert one(spark, relevance.in_territories(F.col("a"), ["Québec"]), None) is True and one(spark, relevance.in_territories(F.col("a"), ["Québec"]), "Ontario") is False
    assert one(spark, relevance.in_territory(F.col("a"), F.col("b"), F.col("c")), None, None, "Laval") is False


# -- names ----------------------------------------------------------------------


def test_resolution_passes(spark):
    names = spark.createDataFrame([("1", "transport tremblay", False), ("2", "ferme du nord", False), ("3", "les ateliers zyx", False), ("4", "vieux moulin", True), ("5", "boutique alpha", False), ("6", "boutique alpho", False), ("1", "tremblay logistique", False)], "id string, name string, retired boolean")
    asked = spark.createDataFrame([(1, "transport tremblay", None), (2, "zyx les ateliers", None), (3, "vieux moulin", None), (4, "qqq", None), (5, "boutique alphu", None), (6, "", None)], "query_id int, name string, city string")
    got = {r.query_id: (r.id, r.family, r["pass"]) for r in resolution.resolve(asked, names).collect()}
    assert got[1] == ("1", "retained", 1) and got[2] == ("3", "retained", 2) and got[3] == ("4", "retained", 3)
    assert got[4][1] == "no candidate" and got[5][1] == "ambiguous" and got[6][1] == "no candidate"


def test_prefix_is_not_the_first_word(spark):
    names = spark.createDataFrame([("1", "lesage bois"), ("2", "les bois"), ("3", "bois les")], "id string, name string")
    asked = spark.createDataFrame([(1, "les pins")], "query_id int, name string")
    assert {r.id for r in blocking.by_prefix(names, asked).collect()} == {"1", "2"}
    assert {r.id for r in blocking.by_fragment(names, spark.createDataFrame([(1, "s bois et")], "query_id int, name string")).collect()} == {"2"}


def test_address_tie_break_levels(spark):
    rows = [(1, "a", ["J0L", "J0L2A1"], "x", ["J0L", "J0L2A1"], "x"), (1, "b", ["H2X", "H2X1Y4"], "x", ["J0L", "J0L2A1"], "x"), (2, "a", ["J0L"], "x", ["J0L"], "x"), (2, "b", ["H2X"], "y", ["J0L"], "x"), (3, "a", None, "x", None, "x"), (3, "b", None, "y", None, "x"), (4, "a", ["G1G"], "x", ["J0L"], "x"), (4, "b", ["H2X"], "y", ["J0L"], "x"), (5, "a", None, None, None, "x"), (5, "b", None, "x", None, "x")]
    df = spark.createDataFrame(rows, "query_id int, id string, codes array<string>, city string, asked_codes array<string>, asked_city string")
    got = {r.query_id: (r.level, r.winner, r.outcome) for r in tiebreak.by_address(df).collect()}
    assert got == {1: ("code", "a", "broken"), 2: ("area", "a", "broken"), 3: ("city", "a", "broken"), 4: (None, None, "all excluded"), 5: (None, None, "competitor unknown")}


def test_duplicates_merge_into_the_oldest(spark):
    pool = spark.createDataFrame([(1, "boulangerie du coin", "laval"), (2, "boulangerie du coin", "laval"), (3, "boulangerie du coinn", "laval"), (4, "9519 3801 quebec inc", None), (5, "9519 3850 quebec inc", None)], "company_id int, name string, city string")
    pairs = dedup.candidate_pairs(pool)
    assert not [r for r in pairs.collect() if {r.older, r.younger} == {4, 5}]
    assert {r.company_id: r.kept for r in dedup.merges(pairs).collect()} == {2: 1, 3: 1}
    links = dedup.cross_province(pool.withColumn("provinces", F.when(F.col("company_id") == 1, F.array(F.lit("QC"))).otherwise(F.array(F.lit("ON")))))
    assert {(r.a, r.b) for r in links.collect()} >= {(1, 2), (1, 3)}


def test_links_of_provinces_need_no_common_first_word(spark):
    made = [(i, f"alpha {i:04d}", "laval", ["QC"]) for i in range(600)] + [(1000, "les toitures du nord", "laval", ["QC"]), (1001, "toitures du nord", "laval", ["ON"]), (1002, "alpha zz 77", "laval", ["QC"]), (1003, "alpha zz 77", "laval", ["ON"])]
    pool = spark.createDataFrame(made, "company_id int, name string, city string, provinces array<string>")
    found = {(r.a, r.b): r.score for r in dedup.cross_province(pool).collect()}
    assert (1000, 1001) in found and found[1002, 1003] == 100.0


def test_pairs_of_a_frequent_first_word_are_all_met(spark):
    made = [(i, f"alpha {i * 7919 % 9973:04d}", None) for i in range(600)] + [(1002, "alpha zzzzzzzz", None), (1003, "alpha zzzzzzzz", None)]
    pool = spark.createDataFrame(made, "company_id int, name string, city string")
    assert (1002, 1003, 100.0) in {tuple(r) for r in dedup.candidate_pairs(pool).collect()}


def test_components(spark):
    pairs = spark.createDataFrame([(i + 1, i) for i in range(30)] + [(50, 51), (51, 52), (52, 50), (7, 7)], "a int, b int")
    got = {r.node: r.component for r in graph.components(pairs, "a", "b").collect()}
    assert got == {**dict.fromkeys(range(31), 0), 50: 50, 51: 50, 52: 50}


def test_windows(spark):
    df = spark.createDataFrame([(1, i) for i in range(10)], "k int, i int")
    known = df.where("i in (3, 4, 5, 8)")
    assert [r.i for r in relational.until_known_run(df, known, "i", [F.col("i")], 3, ["k"]).orderBy("i").collect()] == [0, 1, 2, 3, 4, 5]
    for n in (1, 3, 10, 20):
        got = [r.i for r in relational.spread_sample(df, [F.col("i")], n, ["k"]).orderBy("i").collect()]
        assert got == ([int(i * 10 / n) for i in range(n)] if n < 10 else list(range(10)))


def test_reports(spark):
    notes = spark.createDataFrame([(1, 50.0, None), (2, 70.0, None), (3, 70.0, None), (4, 99.0, datetime(2024, 1, 1))], "note_id int, score double, sent_at timestamp")
    values = spark.createDataFrame([(2, 5.0), (2, 9.0)], "note_id int, value double")
    assert [(r.note_id, r.value, r.backlog) for r in reports.digest(notes, values, 2).collect()] == [(2, 9.0, 3), (3, None, 3)]
    assert one(spark, reports.classify(F.col("a"), [("x", "foo"), ("y", "o")]), "FOO") == "x" and one(spark, reports.classify(F.col("a"), []), " ") == reports.UNSTATED
    assert one(spark, reports.band_overlaps(F.col("a"), F.lit(10), F.lit(None).cast("int")), "5-19") is True and one(spark, reports.band_overlaps(F.col("a"), F.lit(10), F.lit(None).cast("int")), None) is False


def test_merges_go_on_to_the_end(spark):
    star = [(0, k, 95.0 + k % 5) for k in range(1, 200)] + [(500, 501, 99.0), (501, 502, 98.0), (500, 502, 96.0), (600, 601, 94.9)]
    got = {r.company_id: r.kept for r in dedup.merges(spark.createDataFrame(star, "older long, younger long, score double")).collect()}
    assert got == {**{k: 0 for k in range(1, 200)}, 501: 500, 502: 500}
    chain = spark.createDataFrame([(k, k + 1, 99.0 - k / 100) for k in range(60)], "older long, younger long, score double")
    assert {r.company_id: r.kept for r in dedup.merges(chain).collect()} == {k: k - 1 for k in range(1, 61, 2)}  # each left one has no pair any more


def test_places_over_ranges_are_those_of_one_window(spark):
    from signalmill.operators.relational import in_order

    rows = spark.createDataFrame([("hot", i, i % 7) for i in range(500)] + [(None, i, 1) for i in range(5)] + [("one", 0, 3)], "g string, i int, n int").repartition(5)
    got = {(r.g, r.i): (r._place, r._n, r._running, r._total) for r in in_order(rows, ["g"], [F.desc("i")], F.col("n")).collect()}
    assert len(got) == 506 and got["hot", 499] == (0, 500, 499 % 7, sum(i % 7 for i in range(500))) and got["one", 0] == (0, 1, 3, 3)
    assert all(got["hot", i][0] == 499 - i and got["hot", i][2] == sum(j % 7 for j in range(i, 500)) for i in range(500)) and got[None, 0] == (4, 5, 5, 5)


def test_bounds_drop_no_pair_that_reaches_the_score(spark):
    import random

    draw = random.Random(2)
    words = ["ferme", "nord", "inc", "abc", "construction", "le", "x9", "gestion", "tremblay", "du"]
    names = [" ".join(draw.choice(words) for _ in range(draw.randint(1, 6))) for _ in range(60)] + ["".join(draw.choice("abcde ") for _ in range(draw.randint(2, 25))).strip() or "a" for _ in range(60)]
    pairs = [(a, b, fuzzy.weighted_ratio(a, b)) for a in names for b in names]
    df = spark.createDataFrame(pairs, "a string, b string, score double")
    a, b = F.col("a"), F.col("b")
    told = df.withColumn("may", fuzzy.may_reach(a, b, fuzzy.letters(a), fuzzy.letters(b), 80.0)).collect()
    assert all(r.may for r in told if r.score >= 80) and sum(not r.may for r in told) > len(told) / 4


def test_scores_of_known_pairs():
    # fixed values of the published scorer's documentation and of plain arithmetic
    for a, b, want in (("this is a test", "this is a test!", 96.55), ("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear", 95.0), ("abc", "abc", 100.0), ("abc", "", 0.0), ("abcd", "wxyz", 0.0), ("transport tremblay", "tremblay transport", 95.0), ("new york mets", "new york mets vs atlanta braves", 90.0)):
        assert abs(fuzzy.weighted_ratio(a, b) - want) < 0.01, (a, b, fuzzy.weighted_ratio(a, b))
