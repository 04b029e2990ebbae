"""All named queries and their SQL."""

from __future__ import annotations

from signalmill.plans import diffs, dossiers, names, profiles, relational, rollups, scores, sources, texts, versions
from signalmill.plans.views import Query

MODULES = (scores, relational, diffs, rollups, texts, names, profiles, dossiers, sources, versions)


def queries() -> dict[str, Query]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
