"""Comparison of successive snapshots of a keyed table.

A snapshot is a DataFrame with key columns and value columns. Rows get a
fingerprint of their relevant columns; one full outer join on the key tells what
appeared, disappeared or changed. Safeguards decide from counts alone whether
the result may be applied: a share of unreadable rows, a schema that lost or
changed a relevant column, and volumes beyond double thresholds (a number and a
percentage) put the run into quarantine. State is a DataFrame passed in and
returned; writing it is the caller's.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmill.operators.storage import materialize

KINDS = ("disappeared", "appeared", "modified")


@dataclass(frozen=True)
class Threshold:
    """Both must be reached: a count and a percentage of the previous rows."""

    count: int
    percent: float

    def tightened(self, factor: float) -> Threshold:
        return Threshold(max(1, round(self.count * factor)), self.percent * factor)


@dataclass(frozen=True)
class Limits:
    # The defaults of each kind of change.
    appeared: Threshold = Threshold(500, 50.0)
    disappeared: Threshold = Threshold(300, 30.0)
    modified: Threshold = Threshold(500, 50.0)
    unreadable_percent: float = 5.0
    careful_runs: int = 5
    careful_factor: float = 0.5

    @classmethod
    def of(cls, said: dict | None) -> Limits:
        """A source's own limits, as ``{kind: {"percent": ..., "count": ...}}``;
        kinds and values that it doesn't name keep the defaults."""
        limits = cls()
        for kind in KINDS:
            own = (said or {}).get(kind)
            if own:
                usual = getattr(limits, kind)
                limits = replace(limits, **{kind: Threshold(int(own.get("count", usual.count)), float(own.get("percent", usual.percent)))})
        return limits

    def effective(self, earlier_runs: int) -> Limits:
        """Tighter until enough runs (the reference run not counted) went before."""
        if earlier_runs >= self.careful_runs:
            return self
        return replace(self, **{k: getattr(self, k).tightened(self.careful_factor) for k in KINDS})


@dataclass(frozen=True)
class Outcome:
    """What a run decided. ``status`` is reference, accepted or quarantined."""

    status: str
    motive: str | None
    changes: DataFrame
    state: DataFrame
    counts: dict[str, int] = field(default_factory=dict)
    warnings: tuple[str, ...] = ()
    rows: int = 0
    previous: int = 0
    limits: Limits | None = None
    careful: bool = False
    columns: dict[str, str] = field(default_factory=dict)


def fingerprint(columns: list[str]) -> Column:
    """Digest of the columns' names and values; nulls count as values."""
    return F.sha2(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def one_per_key(rows: DataFrame, keys: list[str], relevant: list[str]) -> DataFrame:
    """Of rows with equal key, the one with the greatest fingerprint, which is
    added as ``fingerprint``."""
    named = rows.withColumn("fingerprint", fingerprint(relevant))
    whole = F.max_by(F.struct(*[c for c in named.columns if c not in keys]), "fingerprint")
    return named.groupBy(*keys).agg(whole.alias("_row")).select(*keys, "_row.*")


def duplicate_keys(rows: DataFrame, keys: list[str], relevant: list[str]) -> DataFrame:
    """(identical, divergent): surplus rows whose key holds one fingerprint, and
    those whose key holds several."""
    # The least and the greatest digest of a key differ if any do: one aggregate,
    # summed where the rows lie.
    whole = F.struct(*[F.col(c).cast("string") for c in sorted(relevant)])
    form = F.struct(F.xxhash64(whole), F.hash(whole))
    held = rows.groupBy(*keys).agg(F.count("*").alias("n"), (F.min(form) == F.max(form)).alias("same")).where("n > 1")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n") - 1)), F.lit(0)).cast("long")
    return held.agg(total(F.col("same")).alias("identical"), total(~F.col("same")).alias("divergent"))


def changes(old: DataFrame, new: DataFrame, keys: list[str], relevant: list[str]) -> DataFrame:
    """(keys, change, fields, before, after), a row for each key that changed.

    ``fields`` are the relevant columns that differ, sorted; ``before`` and
    ``after`` map relevant columns to their values as strings. Keys are compared
    null-safe; both sides have one row for each key.
    """
    names = sorted(relevant)
    values = F.array(*[F.col(c).cast("string") for c in names])
    a = old.select(*keys, values.alias("_a"))
    b = new.select(*[F.col(k).alias(f"_{k}") for k in keys], values.alias("_b"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    met = a.join(b, same, "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b")))
    change = F.when(F.col("_a").isNull(), "appeared").when(F.col("_b").isNull(), "disappeared").otherwise("modified")
    listed = F.array(*[F.lit(c) for c in names])
    differ = F.filter(F.transform(listed, lambda c, i: F.when(~F.col("_a")[i].eqNullSafe(F.col("_b")[i]), c)), lambda c: c.isNotNull())
    key = [F.when(F.col("_a").isNull(), F.col(f"_{k}")).otherwise(F.col(k)).alias(k) for k in keys]
    said = lambda side: F.when(F.col(side).isNotNull(), F.map_from_arrays(listed, F.col(side)))
    return met.select(*key, change.alias("change"), F.when(change == "modified", differ).alias("fields"), said("_a").alias("before"), said("_b").alias("after"))


def schema_change(seen: dict[str, str] | None, df: DataFrame, relevant: list[str]) -> tuple[list[str], list[str], list[str]]:
    """Relevant columns that were removed, that changed their type, and columns
    that were added, against an earlier schema."""
    if seen is None:
        return [], [], []
    now = dict(df.dtypes)
    removed = sorted(c for c in relevant if c in seen and c not in now)
    retyped = sorted(c for c in relevant if c in seen and c in now and seen[c] != now[c])
    return removed, retyped, sorted(set(now) - set(seen))


def percent_of(part: int, whole: int) -> float:
    return 100.0 * part / whole if whole else (100.0 if part else 0.0)


def exceeded(counts: dict[str, int], previous: int, limits: Limits) -> str | None:
    """The kind whose double threshold is reached, disappearances first."""
    for kind in KINDS:
        t = getattr(limits, kind)
        if counts.get(kind, 0) >= t.count and percent_of(counts.get(kind, 0), previous) >= t.percent:
            return kind
    return None


def run(state: DataFrame | None, new: DataFrame, keys: list[str], relevant: list[str], *, seen_schema: dict[str, str] | None = None, unreadable: int = 0, read: int | None = None, earlier_runs: int = 0, limits: Limits | None = None) -> Outcome:
    """One run over a snapshot. Without a state it is the reference: it seeds the
    state, gives no changes and is never quarantined for its volume. A quarantined
    run leaves the state as it was and still returns its changes, so that they can
    be looked at and applied later."""
    limits = limits or Limits()
    columns, held = dict(new.dtypes), state if state is not None else new.limit(0)
    if read and 100.0 * unreadable / read > limits.unreadable_percent:
        return Outcome("quarantined", "unreadable", new.limit(0), held, {"unreadable": unreadable}, rows=read, columns=columns)
    removed, retyped, added = schema_change(seen_schema, new, relevant)
    warnings = tuple(f"column added: {c}" for c in added)
    if removed or retyped:
        return Outcome("quarantined", "columns removed" if removed else "types changed", new.limit(0), held, {}, warnings, columns=columns)
    fresh = one_per_key(new, keys, relevant).drop("fingerprint")
    told = {"rows": new.count(), "columns": columns}
    if state is None:
        return Outcome("reference", None, changes(fresh.limit(0), fresh, keys, relevant).limit(0), fresh, {}, warnings, **told)
    found = materialize(changes(state, fresh, keys, relevant))  # counted here and used by the caller
    counts = {r["change"]: r["count"] for r in found.groupBy("change").count().collect()}  # three rows at most
    effective, previous = limits.effective(earlier_runs), state.count()
    motive = exceeded(counts, previous, effective)
    return Outcome("quarantined" if motive else "accepted", motive, found, state if motive else fresh, counts, warnings, previous=previous, limits=effective, careful=effective is not limits, **told)


#: Columns of the journal of runs.
JOURNAL = "source string, run_id string, status string, motive string, rows long, previous_rows long, " + ", ".join(f"{k} long, {k}_percent double, {k}_limit_percent double, {k}_limit_count long" for k in KINDS) + ", identical_duplicates long, divergent_duplicates long, duplicate_share double, careful boolean, warnings array<string>"


def journal_row(outcome: Outcome, source: str, run_id: str, duplicates: tuple[int, int] = (0, 0)) -> dict:
    """A run as a row of the journal, whichever way it ended: counts and their
    percentages of the rows before (null if nothing was compared), the limits
    that applied, and the share of surplus rows."""
    compared = outcome.limits is not None
    row = {"source": source, "run_id": run_id, "status": outcome.status, "motive": outcome.motive, "rows": outcome.rows, "previous_rows": outcome.previous}
    for kind in KINDS:
        n, limit = outcome.counts.get(kind, 0), getattr(outcome.limits, kind) if compared else None
        row |= {kind: n if compared else None, f"{kind}_percent": float(percent_of(n, outcome.previous)) if compared else None}
        row |= {f"{kind}_limit_percent": float(limit.percent) if limit else None, f"{kind}_limit_count": limit.count if limit else None}
    identical, divergent = duplicates
    return row | {"identical_duplicates": identical, "divergent_duplicates": divergent, "duplicate_share": (identical + divergent) / outcome.rows if outcome.rows else 0.0, "careful": outcome.careful, "warnings": list(outcome.warnings)}


def write_journal(spark: SparkSession, rows: list[dict], path: str) -> None:
    """Appends runs, a row each, to the journal's files."""
    schema = JOURNAL
    names = [c.strip().split(" ")[0] for c in schema.split(", ")]
    spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema).coalesce(1).write.mode("append").parquet(path)


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(JOURNAL).parquet(path)


def run_together(runs: list[Outcome]) -> bool:
    """Whether what follows may go on: every grain's run was accepted."""
    return all(r.status == "accepted" for r in runs)


def apply(state: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """The state after stored changes (see :func:`changes`): rows that disappeared
    or changed go, and what appeared or changed comes, its relevant columns in the
    state's types. Columns that the changes don't have are null in new rows."""
    left = state.join(found.select(*keys), keys, "left_anti")
    values = [F.col("after")[c].cast(kind).alias(c) for c, kind in state.dtypes if c not in keys]
    return left.unionByName(found.where("change <> 'disappeared'").select(*[F.col(k) for k in keys], *values))


def lift(outcome: Outcome, new: DataFrame, keys: list[str], relevant: list[str], accept: bool) -> DataFrame:
    """The state that the snapshot itself gives, or the state as it was, where the
    changes weren't stored; see :func:`settle`. A run that read too little or
    lost columns has nothing to apply."""
    if not accept or outcome.motive in ("unreadable", "columns removed", "types changed"):
        return outcome.state
    return one_per_key(new, keys, relevant).drop("fingerprint")


def settle(state: DataFrame, outcome: Outcome, keys: list[str], accept: bool) -> tuple[DataFrame, dict[str, str] | None]:
    """(state, schema to know from now on) after a quarantine is lifted. Accepted,
    the changes that were found then are applied as they are, nothing is read
    again; a run whose schema changed has none, and its new schema is taken as
    legitimate. A run that read too little has nothing to apply. Rejected, all
    stays as it was."""
    if outcome.status != "quarantined":
        raise ValueError(f"a run that is {outcome.status} has no quarantine to lift")
    if not accept or outcome.motive == "unreadable":
        return state, None
    if outcome.motive in ("columns removed", "types changed"):
        return state, outcome.columns
    return apply(state, outcome.changes, keys), outcome.columns


def waiting(quarantines: DataFrame) -> DataFrame:
    """Quarantines that nobody decided on, the newest first; ``quarantines`` has
    status and created_at."""
    return quarantines.where("status = 'waiting'").orderBy(F.desc("created_at"))


def proposed_limits(journal: DataFrame, least_runs: int = 5, factor: float = 1.5) -> DataFrame:
    """Per source with enough clean runs, the greatest percentages times a factor.
    ``journal`` has source, status and a percentage of each kind."""
    clean = journal.where("status = 'accepted'").groupBy("source")
    tops = [F.max(f"{k}_percent").alias(f"{k}_percent") for k in KINDS]
    return clean.agg(F.count("*").alias("runs"), *tops).where(F.col("runs") >= least_runs).select("source", "runs", *[(F.col(f"{k}_percent") * factor).alias(f"{k}_percent") for k in KINDS])


def simultaneous(journal: DataFrame, least: int = 2) -> DataFrame:
    """Cycles in which several sources were quarantined: more likely a fault here
    than in all of them."""
    return journal.groupBy("cycle").agg(F.count_if(F.col("status") == "quarantined").alias("quarantined")).where(F.col("quarantined") >= least)


def registry_signals(found: DataFrame, key: str, address: str = "address", status: str | None = None, active: tuple[str, ...] = ()) -> DataFrame:
    """Signals of a registry diff: an address that changed and was known before;
    with ``status``, of companies in one of the ``active`` states only."""
    before, after = F.col("before")[address], F.col("after")[address]
    moved = (F.col("change") == "modified") & F.array_contains("fields", address) & before.isNotNull()
    if status:
        moved = moved & F.coalesce(F.lower(F.col("after")[status]).isin(*active), F.lit(False))
    return found.where(moved).select(key, F.lit("address_change").alias("change_kind"), before.alias("before"), after.alias("after"))


def new_secondary_sites(sites: DataFrame, companies: DataFrame, key: str, main: str = "is_main") -> DataFrame:
    """Signals of a diff of sites: one that appeared, isn't the main one and
    belongs to a company that isn't itself new."""
    secondary = sites.where((F.col("change") == "appeared") & (F.col("after")[main] != "true"))
    return secondary.join(companies.where("change = 'appeared'").select(key), key, "left_anti").withColumn("change_kind", F.lit("new_site"))
