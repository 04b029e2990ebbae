"""The schema that every source is brought to, and how it is filled.

Columns of raw rows are strings; a source is a mapping from its columns to the
schema, so a new source is a few lines of configuration and one reader.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalmill.functions.numbers import parse_date, parse_number

SCHEMA = {
    "source": "string", "signal_type": "string", "name": "string", "detected_at": "timestamp", "source_ref": "string", "company_no": "string",
    "address": "string", "city": "string", "region": "string", "sector": "string", "website": "string", "value": "double", "title": "string", "fields": "map<string,string>",
}


def text(df: DataFrame, *names: str) -> Column:
    """The first of several columns that has a value, trimmed; columns that the
    rows lack count as empty."""
    known = {c.lower(): c for c in df.columns}
    there = [F.nullif(F.trim(F.col(f"`{known[n.lower()]}`").cast("string")), F.lit("")) for n in names if n.lower() in known]
    return F.coalesce(*there) if there else F.lit(None).cast("string")


def number(df: DataFrame, *names: str) -> Column:
    """The first of several columns that is a number other than zero, else zero or null."""
    values = [parse_number(text(df, n)) for n in names]
    return F.coalesce(*[F.nullif(v, F.lit(0.0)) for v in values], *values)


def date(df: DataFrame, *names: str) -> Column:
    return F.coalesce(*[parse_date(text(df, n)) for n in names])


def reference(source: str, *parts: Column) -> Column:
    return F.concat_ws(":", F.lit(source), *[F.coalesce(p, F.lit("")) for p in parts])


def fields(**named: Column) -> Column:
    """A map of the named values, without nulls."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in named.items()])
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))


def signals(df: DataFrame, source: str, signal_type: str, **columns: Column) -> DataFrame:
    """Rows in the schema; columns not given are null. Rows without a name go."""
    made = {"source": F.lit(source), "signal_type": F.lit(signal_type), **columns}
    out = df.select(*[made.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in SCHEMA.items()])
    return out.where("name is not null and name <> ''")


def since(rows: DataFrame, start: datetime | None) -> DataFrame:
    """Rows from a date on; those without a date stay."""
    return rows if start is None else rows.where(F.col("detected_at").isNull() | (F.col("detected_at") >= F.lit(start)))


def not_in_the_future(rows: DataFrame, as_of: datetime) -> DataFrame:
    return rows.where(F.col("detected_at").isNull() | (F.col("detected_at") <= F.lit(as_of)))


def ingest(known: DataFrame, fresh: DataFrame, as_of: datetime) -> DataFrame:
    """New signals: the first row of each (source, source_ref) that isn't known;
    a missing date is that of the run."""
    from signalmill.operators.relational import latest

    new = fresh.join(known.select("source", "source_ref").distinct(), ["source", "source_ref"], "left_anti")
    new = latest(new, ["source", "source_ref"], [F.col("detected_at").asc_nulls_last(), F.col("name")])
    return new.withColumn("detected_at", F.coalesce("detected_at", F.lit(as_of)))


def check_columns(df: DataFrame, wanted: list[str]) -> None:
    """Refuses a file that lacks columns, before any row is read."""
    lacking = sorted(set(wanted) - set(df.columns))
    if lacking:
        raise ValueError(f"missing columns: {lacking}; there are {sorted(df.columns)}")


def header_aliases(columns: list[str], aliases: dict[str, list[str]]) -> dict[str, str]:
    """Role to column: the first alias that is part of a header, in normalised form."""
    from signalmill.functions.text import normalised as plain

    found, lacking = {}, []
    for role, names in aliases.items():
        hit = next((c for a in names for c in columns if plain(a.replace("_", " ")) in plain(c.replace("_", " "))), None)
        if hit is None:
            lacking.append(role)
        else:
            found[role] = hit
    if lacking:
        raise ValueError(f"no column for {lacking}; headers: {columns}")
    return found
