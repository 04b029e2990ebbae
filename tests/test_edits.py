"""Joins by edits against all pairs."""

from __future__ import annotations

import random

import pytest

from signalmill.operators import dedup, edits


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def score(a: str, b: str) -> float:
    return round(100 * (1 - distance(a, b) / max(len(a), len(b))), 4)


def damaged(draw: random.Random, name: str, alphabet: str) -> str:
    letters = list(name)
    for _ in range(draw.randint(0, 6)):
        k, what = draw.randrange(len(letters) + 1), draw.randrange(3)
        if what == 0:
            letters.insert(k, draw.choice(alphabet))
        elif k < len(letters) and what == 1:
            letters[k] = draw.choice(alphabet)
        elif k < len(letters) and len(letters) > 1:
            del letters[k]
    return "".join(letters)


def made(seed: int, count: int, alphabet: str = "abc é") -> list[str]:
    draw = random.Random(seed)
    names = ["".join(draw.choice(alphabet) for _ in range(draw.randint(1, 24))) for _ in range(count // 4)]
    return [damaged(draw, draw.choice(names), alphabet) or "a" for _ in range(count)]


@pytest.mark.parametrize("least", [100.0, 92.0, 80.0, 66.6667, 60.0, 50.0])
def test_no_pair_is_lost(spark, least):
    left, right = sorted(set(made(1, 120))), sorted(set(made(1, 160)) | {"b", "ab"})
    frame = lambda names: spark.createDataFrame([(n,) for n in [*names, "", None]], "name string")
    got = {(r.a, r.b): r.score for r in edits.similar_names(frame(left), frame(right), least).collect()}
    assert got == {(a, b): score(a, b) for a in left for b in right if score(a, b) >= least}


def brute_links(rows: list[tuple], least: float, most: int) -> dict:
    links = {}
    for key, name, provinces in rows:
        found = [(-score(name, n), k) for k, n, p in rows if name and n and provinces is not None and p is not None and set(p) - set(provinces) and k != key and score(name, n) >= least]
        for s, k in sorted(found)[:most]:
            links[min(k, key), max(k, key)] = -s
    return links


@pytest.mark.parametrize("least", [50.0, 80.0])
def test_links_are_those_of_the_nested_loop(spark, least):
    draw = random.Random(5)
    names = made(7, 140) + ["same name"] * 30 + ["", None]
    rows = [(k, n, draw.choice([["QC"], ["ON"], ["QC", "ON"], ["ON", "QC"], [], None])) for k, n in enumerate(names)]
    pool = spark.createDataFrame(rows, "company_id int, name string, provinces array<string>")
    got = {(r.a, r.b): r.score for r in dedup.cross_province_by_edits(pool, least).collect()}
    assert got == brute_links(rows, least, 3)
    assert dedup.cross_province_by_edits(pool.limit(0), least).count() == 0


def test_a_name_of_very_many_companies_is_searched_once(spark):
    rows = [(k, "ferme du nord", ["QC"] if k % 2 else ["ON"]) for k in range(4000)]
    pool = spark.createDataFrame(rows, "company_id int, name string, provinces array<string>")
    got = edits.best_matches(pool, 80.0, 3).collect()
    assert len(got) == 3 * 4000
    assert {r.id for r in got if r.query_id % 2} == {0, 2, 4} and {r.id for r in got if not r.query_id % 2} == {1, 3, 5}


def test_pairs_met_grow_about_as_the_names(spark):
    def count(n: int) -> int:
        draw = random.Random(n)
        word = lambda: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randint(4, 9)))
        frame = spark.createDataFrame([(f"{word()} {word()} {word()}",) for _ in range(n)], "name string")
        return edits.met(frame, frame, 84.0).count()

    small, large = count(500), count(4000)
    assert large < small * 8**1.3
