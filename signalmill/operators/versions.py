"""States in versions: what a run gives becomes visible at once or not at all.

A version is a small JSON manifest that names the files of its state and of its
changes and holds the run's row of the journal. Files are written first, under a
name of their own; the version exists from the moment its manifest is renamed to
its number, and a number can be taken once. So state, archive and journal can't
part, a reader of a version isn't disturbed by later ones, and undoing is a new
version with an older state.

A run that failed before its manifest left nothing to see; tried again under its
id it starts anew. One that failed after it is known by its id and isn't written
again. Its changes are passed on at least once: until the receiver returned, the
version counts as undelivered, and :meth:`Versions.deliver` or the run's next
attempt passes them on. The receiver gets the version's number to tell repeats.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from signalmill.operators.diff import JOURNAL, Outcome, apply, journal_row

MANIFEST = f"version long, parent long, state string, changes string, {JOURNAL}"

Receiver = Callable[[int, DataFrame], None]


class Conflict(RuntimeError):
    """Another version came in between."""


class Versions:
    """The versions of one state in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._system = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for part in ("manifests", "delivered", "drafts", "data"):
            self._system.mkdirs(self._path(f"{self.folder}/{part}"))

    def _names(self, part: str) -> set[str]:
        return {s.getPath().getName() for s in self._system.listStatus(self._path(f"{self.folder}/{part}"))}

    def _put(self, part: str, name: str, text: str) -> None:
        """A whole file or none; fails if there is one of the name."""
        draft, place = self._path(f"{self.folder}/drafts/{uuid.uuid4().hex}"), self._path(f"{self.folder}/{part}/{name}")
        stream = self._system.create(draft, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        fs = self._jvm.org.apache.hadoop.fs
        options = self.spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
        options[0] = fs.Options.Rename.NONE
        files = fs.FileContext.getFileContext(self._system.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            files.rename(draft, place, options)
        except Exception as error:
            if self._system.exists(place):
                raise Conflict(f"{part}/{name} is taken") from error
            raise

    # what there is

    def history(self) -> DataFrame:
        """A row for each version: its files and its row of the journal."""
        return self.spark.read.schema(MANIFEST).json(f"{self.folder}/manifests")

    def journal(self) -> DataFrame:
        return self.history().where("status <> 'undone'").drop("parent", "state", "changes")

    def latest(self) -> Row | None:
        names = self._names("manifests")
        return self.version(max(map(int, names))) if names else None

    def version(self, number: int) -> Row:
        found = self.spark.read.schema(MANIFEST).json(f"{self.folder}/manifests/{number:012d}").first()
        if found is None:
            raise LookupError(f"no version {number}")
        return found

    def of_run(self, run_id: str) -> Row | None:
        return self.history().where(F.col("run_id") == run_id).first()

    def read(self, number: int | None = None) -> DataFrame:
        """The state of a version, or of the latest."""
        row = self.latest() if number is None else self.version(number)
        if row is None:
            raise LookupError("there is no version yet")
        return self.spark.read.parquet(row.state)

    def changes(self, number: int) -> DataFrame:
        return self.spark.read.parquet(self.version(number).changes)

    def undelivered(self) -> list[int]:
        """Accepted versions whose changes weren't taken yet, oldest first."""
        done = self._names("delivered")
        accepted = self.history().where("status = 'accepted'").select("version").collect()
        return sorted(r.version for r in accepted if f"{r.version:012d}" not in done)

    # what changes

    def _commit(self, parent: Row | None, row: dict) -> int:
        number = parent.version + 1 if parent else 1
        self._put("manifests", f"{number:012d}", json.dumps({"version": number, "parent": parent.version if parent else None} | row))
        return number

    def finish(self, outcome: Outcome, run_id: str, source: str = "", receiver: Receiver | None = None, base: int | None = None, step: Callable[[str], None] = lambda name: None) -> int:
        """Carries a run through and returns its version; may be called again with
        the same ``run_id`` after a failure. A quarantined run is a version with
        the state as it was, and its changes wait. ``base`` is the version that
        the run was compared with; ``step`` is told each step before it starts."""
        known = self.of_run(run_id)
        if known is None:
            parent = self.latest()
            if base is not None and (parent.version if parent else None) != base:
                raise Conflict(f"the run is of version {base}")
            place = f"{self.folder}/data/{uuid.uuid4().hex}"
            step("state")
            state = parent.state if parent and outcome.status == "quarantined" else f"{place}/state"
            if state.startswith(place):
                outcome.state.write.parquet(state)
            step("changes")
            outcome.changes.write.parquet(f"{place}/changes")
            step("manifest")
            known = self.version(self._commit(parent, journal_row(outcome, source, run_id) | {"state": state, "changes": f"{place}/changes"}))
        if receiver and known.status == "accepted" and f"{known.version:012d}" not in self._names("delivered"):
            self._deliver(known.version, receiver, step)
        return known.version

    def _deliver(self, number: int, receiver: Receiver, step: Callable[[str], None]) -> None:
        step("deliver")
        receiver(number, self.changes(number))
        step("delivered")
        self._put("delivered", f"{number:012d}", "")

    def deliver(self, receiver: Receiver) -> list[int]:
        """Passes on what wasn't delivered yet, oldest first."""
        waiting = self.undelivered()
        for number in waiting:
            self._deliver(number, receiver, lambda name: None)
        return waiting

    def write(self, state: DataFrame, run_id: str, source: str = "") -> int:
        """A version of a state that no run gave, as ids that were written."""
        known = self.of_run(run_id)
        if known:
            return known.version
        place = f"{self.folder}/data/{uuid.uuid4().hex}/state"
        state.write.parquet(place)
        return self._commit(self.latest(), {"state": place, "run_id": run_id, "source": source, "status": "written"})

    def undo(self, number: int | None = None) -> int:
        """A new version with the state before the given or the latest one."""
        row, now = (self.latest() if number is None else self.version(number)), self.latest()
        if row is None or row.parent is None:
            raise LookupError("there is no version before")
        return self._commit(now, {"state": self.version(row.parent).state, "status": "undone"})

    def settle(self, number: int, keys: list[str], accept: bool, run_id: str) -> int:
        """Lifts a quarantine: accepted, the changes found then are applied to the
        latest state as a new version; rejected, nothing changes. A run whose
        reading or columns failed has nothing to apply."""
        row = self.version(number)
        if row.status != "quarantined":
            raise ValueError(f"version {number} is {row.status}")
        if not accept or row.motive in ("unreadable", "columns removed", "types changed"):
            return self.latest().version
        return self.write(apply(self.read(), self.changes(number), keys), run_id, row.source or "")

    def forget(self, keep: int) -> None:
        """Removes the files that none of the newest ``keep`` versions and no
        waiting quarantine or delivery needs, what failed runs left among them;
        manifests, and so the journal, stay. Not while a run is under way."""
        rows = sorted(self.history().select("version", "status", "state", "changes").collect(), key=lambda r: r.version)
        waiting = set(self.undelivered())
        needed = {p for r in rows[-keep:] for p in (r.state, r.changes) if p} | {r.changes for r in rows if r.changes and (r.version in waiting or r.status == "quarantined")}
        held = {p.rsplit("/", 2)[1] for p in needed}
        for name in self._names("data") - held:
            self._system.delete(self._path(f"{self.folder}/data/{name}"), True)
        for name in self._names("drafts"):
            self._system.delete(self._path(f"{self.folder}/drafts/{name}"), False)
