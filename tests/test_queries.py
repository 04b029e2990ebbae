"""Every query of the library against its SQL."""

from __future__ import annotations

from collections import Counter
from datetime import datetime
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from signalmill.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for file in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, datetime):
        return value.date() if value.time() == value.min.time() else value
    return value


def rows(names: list[str], found) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, sf, name):
    got = QUERIES[name](spark, sf)
    want = con.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_runs(spark, sf, name):
    found = QUERIES[name](spark, sf)
    assert found.columns and found.count() >= 0


def test_every_sql_has_a_query():
    assert SQL.keys() <= QUERIES.keys()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert entry.oracle_sql().keys() <= entry.queries().keys() and QUERIES.keys() <= entry.queries().keys()


def test_every_detected_name_is_resolved(spark, sf):
    from signalmill.plans.views import dirty_names

    asked = [r.query_id for r in dirty_names(spark, sf).collect()]
    assert sorted(r.query_id for r in QUERIES["resolved_names"](spark, sf).collect()) == sorted(asked)
