"""Interval and as-of joins and scans along a key, against loops."""

from __future__ import annotations

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from signalmill.operators import ranges, relational


def intervals(seed: int, count: int, longest: int) -> list[tuple]:
    draw = random.Random(seed)
    made = []
    for k in range(count):
        start = draw.randint(-500, 500)
        made.append((k, draw.choice(["a", "a", "a", "b", None]), start, start + int(longest ** draw.random()) - 1))
    return [*made, (count, "a", None, 5), (count + 1, "a", 5, None), (count + 2, "a", 9, 3), (count + 3, "a", 7, 7), (count + 3, "a", 7, 7)]


@pytest.mark.parametrize("longest", [1, 40, 4000])
def test_overlaps_are_those_of_the_nested_loop(spark, longest):
    left, right = intervals(1, 150, longest), intervals(2, 200, 300)
    frame = lambda rows: spark.createDataFrame(rows, "id int, k string, s int, e int")

    def brute(keyed: bool) -> Counter:
        return Counter((a[0], b[0]) for a in left for b in right if None not in (*a[2:], *b[2:]) and a[2] <= a[3] and b[2] <= b[3] and a[2] <= b[3] and b[2] <= a[3] and (not keyed or (a[1] is not None and a[1] == b[1])))

    for keys in ([], ["k"]):
        got = ranges.overlapping(frame(left), frame(right), "s", "e", keys).collect()
        assert Counter((r.a.id, r.b.id) for r in got) == brute(bool(keys))
    assert ranges.overlapping(frame(left), frame([]), "s", "e").count() == 0


def test_overlaps_of_moments_before_1970(spark):
    day = datetime(1969, 12, 31)
    rows = [(k, day + timedelta(days=k), day + timedelta(days=k, seconds=86400 * (k % 3))) for k in range(-3, 4)]
    df = spark.createDataFrame(rows, "id int, s timestamp, e timestamp")
    got = Counter((r.a.id, r.b.id) for r in ranges.overlapping(df, df, "s", "e").collect())
    assert got == Counter((a[0], b[0]) for a in rows for b in rows if a[1] <= b[2] and b[1] <= a[2])


def test_as_of_is_the_latest_before(spark):
    draw = random.Random(3)
    right = [(k, draw.choice(["hot", "hot", "cold", None]), draw.choice([None, draw.randint(0, 60)]), draw.randint(0, 3)) for k in range(400)]
    left = [(k, draw.choice(["hot", "hot", "cold", "none", None]), draw.choice([None, *range(-2, 70)])) for k in range(500)] * 2
    got = ranges.as_of(spark.createDataFrame(left, "id int, k string, t int"), spark.createDataFrame(right, "id int, k string, t int, p int"), ["k"], "t", "found", ("p", "id"))
    assert got.columns == ["id", "k", "t", "found"]

    def brute(k, t):
        known = [(r[2], r[3], r[0]) for r in right if r[1] == k and r[2] is not None and t is not None and r[2] <= t] if k is not None else []
        return max(known)[2] if known else None

    assert Counter((r.id, r.k, r.t, r.found and r.found.id) for r in got.collect()) == Counter((*row, brute(row[1], row[2])) for row in left)
    nobody = ranges.as_of(spark.createDataFrame(left, "id int, k string, t int"), spark.createDataFrame([], "id int, k string, t int"), ["k"], "t")
    assert nobody.where("found is not null").count() == 0 and nobody.count() == len(left)


def test_streaks_and_stops_of_a_key_over_many_ranges(spark):
    draw = random.Random(4)
    rows = [(k, "hot" if k % 10 else None, draw.random() < 0.8, draw.random() < 0.1) for k in range(3000)]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "i int, k string, counted boolean, resets boolean").repartition(7)
    got = {r.i: r.streak for r in relational.consecutive(df, ["k"], [F.col("i")], F.col("counted"), F.col("resets")).collect()}
    want, streak = {}, {}
    for i, k, counted, resets in sorted(rows):
        streak[k] = (0 if resets else streak.get(k, 0)) + counted
        want[i] = streak[k]
    assert got == want
    known = spark.createDataFrame([(i,) for i, _, counted, _ in rows if counted], "i int")
    for run in (1, 6, 30, 500):
        left = relational.until_known_run(df, known, "i", [F.col("i")], run, ["k"])
        assert left.columns == df.columns
        kept, row, stopped = set(), {}, set()
        for i, k, counted, _ in sorted(rows):
            if k in stopped:
                continue
            kept.add(i)
            row[k] = row.get(k, 0) + 1 if counted else 0
            if row[k] >= run:
                stopped.add(k)
        assert {r.i for r in left.collect()} == kept
