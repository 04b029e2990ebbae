"""Queries of the operators against their SQL."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from signalmill.llm import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for file in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    want = con.execute(SQL[name])
    names = [d[0] for d in want.description]
    got = registry.queries()[name](spark, sf)
    assert sorted(got.columns) == sorted(names)
    assert Counter(map(tuple, got.select(*names).collect())) == Counter(map(tuple, want.fetchall()))
