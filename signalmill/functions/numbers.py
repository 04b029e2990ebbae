"""Numbers, dates and step tables over columns."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_number(text: Column) -> Column:
    """A number without thousands commas, signs of currency or per cent and
    no-break spaces; null if it is none."""
    return F.nullif(F.regexp_replace(text, "[,$%\u00a0\\s]", ""), F.lit("")).try_cast("double")


def parse_date(text: Column) -> Column:
    """A date in one of the usual forms, as a timestamp; null if it is none."""
    forms = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy", "yyyyMMdd")
    return F.coalesce(*[F.try_to_timestamp(F.trim(text), F.lit(f)) for f in forms])


def quarter_date(name: Column) -> Column:
    """First day of the quarter that a file name tells (``2024q3``, ``q3_2024``)."""
    lowered = F.lower(name)
    year = F.coalesce(F.nullif(F.regexp_extract(lowered, r"(\d{4})[ _-]?[qt]([1-4])", 1), F.lit("")), F.nullif(F.regexp_extract(lowered, r"[qt]([1-4])[ _-]?(\d{4})", 2), F.lit("")))
    quarter = F.coalesce(F.nullif(F.regexp_extract(lowered, r"(\d{4})[ _-]?[qt]([1-4])", 2), F.lit("")), F.nullif(F.regexp_extract(lowered, r"[qt]([1-4])[ _-]?(\d{4})", 1), F.lit("")))
    return F.make_date(year.cast("int"), quarter.cast("int") * 3 - 2, F.lit(1))


def step(value: Column, table: list[tuple[float, float]]) -> Column:
    """The score of the first threshold reached, from the highest on; the last
    score if none is."""
    out = F.lit(float(table[-1][1]))
    for least, score in reversed(table):
        out = F.when(value >= least, F.lit(float(score))).otherwise(out)
    return out


def band(value: Column, edges: list[tuple[float, str]], beyond: str) -> Column:
    """The name of the first band whose upper edge the value doesn't pass."""
    out = F.lit(beyond)
    for edge, name in reversed(edges):
        out = F.when(value <= edge, F.lit(name)).otherwise(out)
    return F.when(value.isNotNull(), out)


def percentage(part: Column, whole: Column) -> Column:
    """100 * part / whole; of nothing it is 100, or 0 if the part is nothing too."""
    return F.when(whole == 0, F.when(part > 0, 100.0).otherwise(0.0)).otherwise(100.0 * part / F.nullif(whole, F.lit(0)))


def freshness(at: Column, as_of: datetime | Column, half_life_days: float = 120.0, floor: float = 0.15) -> Column:
    """Halves every ``half_life_days``, down to ``floor``; the future is fresh."""
    now = F.lit(as_of) if isinstance(as_of, datetime) else as_of
    seconds = F.unix_micros(now.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))
    return F.greatest(F.lit(floor), F.pow(F.lit(0.5), F.greatest(F.lit(0.0), seconds / 1e6) / 86400.0 / half_life_days))


# Units of durations, in seconds.
UNITS = {1: ("s", "sec", "second", "seconds"), 60: ("min", "m", "minute", "minutes"), 3600: ("h", "hr", "hour", "hours"), 86400: ("d", "day", "days"), 604800: ("w", "week", "weeks")}


def duration(said: Column) -> Column:
    """``1h 30min`` in seconds; null for an empty, unending or unknown one."""
    pattern = r"(\d+(?:\.\d+)?)\s*([a-zA-Z]+)"
    seconds = F.create_map(*[F.lit(x) for n, names in UNITS.items() for name in names for x in (name, float(n))])
    values = F.transform(F.regexp_extract_all(said, F.lit(pattern), F.lit(1)), lambda v: v.cast("double"))
    units = F.transform(F.regexp_extract_all(said, F.lit(pattern), F.lit(2)), lambda u: F.try_element_at(seconds, F.lower(u)))
    total = F.aggregate(F.zip_with(values, units, lambda v, u: v * u), F.lit(0.0), lambda a, x: a + x)
    return F.when((F.trim(said) != "infinity") & (F.size(values) > 0), total)
