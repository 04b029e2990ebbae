"""Versions of a state: conflicts, failures, readers and what is removed."""

from __future__ import annotations

import pytest

from signalmill.operators.diff import Limits, run
from signalmill.operators.versions import Conflict, Versions

KEYS, RELEVANT = ["k"], ["v"]


@pytest.fixture
def held(spark, tmp_path):
    return Versions(spark, f"file://{tmp_path}/state")


def state(spark, rows):
    return spark.createDataFrame(rows, "k int, v string")


def pairs(df):
    return sorted(tuple(r) for r in df.select("k", "v").collect())


def test_a_reader_keeps_its_version(spark, held):
    assert held.latest() is None
    first, second = [(1, "a"), (2, "b")], [(1, "a"), (2, "c"), (3, None)]
    held.finish(run(None, state(spark, first), KEYS, RELEVANT), "one")
    reader = held.read()
    held.finish(run(held.read(), state(spark, second), KEYS, RELEVANT, earlier_runs=9), "two")
    assert pairs(reader) == first and pairs(held.read()) == second and pairs(held.read(1)) == first
    assert sorted((r.k, r.change) for r in held.changes(2).collect()) == [(2, "modified"), (3, "appeared")]
    assert [(r.run_id, r.status, r.rows) for r in held.journal().orderBy("version").collect()] == [("one", "reference", 2), ("two", "accepted", 3)]


def test_a_run_of_an_older_version_is_refused(spark, held):
    outcome = run(None, state(spark, [(1, "a")]), KEYS, RELEVANT)
    held.finish(outcome, "one", base=None)
    with pytest.raises(Conflict):
        held.finish(run(state(spark, [(1, "z")]), state(spark, [(1, "b")]), KEYS, RELEVANT, earlier_runs=9), "two", base=7)
    with pytest.raises(Conflict):  # two writers took the same number
        held._commit(None, {"state": "x", "status": "written"})
    assert held.history().count() == 1 and pairs(held.read()) == [(1, "a")]


def test_a_run_is_carried_through_once(spark, held):
    outcome, taken = run(None, state(spark, [(1, "a")]), KEYS, RELEVANT), []
    receiver = lambda number, found: taken.append((number, found.count()))
    assert held.finish(outcome, "one", receiver=receiver) == held.finish(outcome, "one", receiver=receiver) == 1
    change = run(held.read(), state(spark, [(1, "b")]), KEYS, RELEVANT, earlier_runs=9)
    assert held.finish(change, "two") == 2 and held.undelivered() == [2]
    assert held.deliver(receiver) == [2] and held.deliver(receiver) == [] and taken == [(2, 1)]


@pytest.mark.parametrize("broken", ["state", "changes", "manifest", "deliver", "delivered"])
def test_a_failed_run_shows_nothing_or_all(spark, held, broken):
    held.finish(run(None, state(spark, [(1, "a")]), KEYS, RELEVANT), "one")
    change, taken = run(held.read(), state(spark, [(1, "b")]), KEYS, RELEVANT, earlier_runs=9), []

    def fail(step):
        if step == broken:
            raise OSError(step)

    receiver = lambda number, found: taken.append(number)
    with pytest.raises(OSError, match=broken):
        held.finish(change, "two", receiver=receiver, step=fail)
    early = broken in ("state", "changes", "manifest")
    assert pairs(held.read()) == [(1, "a" if early else "b")] and held.history().count() == (1 if early else 2)
    assert held.finish(change, "two", receiver=receiver) == 2 and pairs(held.read()) == [(1, "b")]
    assert taken == [2, 2] if broken == "delivered" else taken == [2]
    held.forget(1)
    assert pairs(held.read()) == [(1, "b")] and held.journal().count() == 2
    assert len(held._names("data")) == 1 and not held._names("drafts")


def test_quarantine_waits_and_is_settled(spark, held):
    rows = [(k, "a") for k in range(20)]
    held.finish(run(None, state(spark, rows), KEYS, RELEVANT), "one")
    tight = Limits.of({"disappeared": {"percent": 1, "count": 1}})
    number = held.finish(run(held.read(), state(spark, rows[:5]), KEYS, RELEVANT, earlier_runs=9, limits=tight), "two", receiver=lambda *_: pytest.fail("not accepted"))
    assert held.version(number).motive == "disappeared" and pairs(held.read()) == rows
    held.forget(1)
    assert held.settle(number, KEYS, False, "no") == number and pairs(held.read()) == rows
    assert held.settle(number, KEYS, True, "yes") == held.settle(number, KEYS, True, "yes") == 3 and pairs(held.read()) == rows[:5]
    assert held.undo() == 4 and pairs(held.read()) == rows and held.undo() == 5 and pairs(held.read()) == rows[:5]
    with pytest.raises(LookupError):
        held.undo(1)
    with pytest.raises(ValueError, match="reference"):
        held.settle(1, KEYS, True, "x")


def test_an_empty_state_has_versions_too(spark, held):
    held.finish(run(None, state(spark, []), KEYS, RELEVANT), "one")
    held.finish(run(held.read(), state(spark, []), KEYS, RELEVANT), "two")
    assert pairs(held.read()) == [] and held.changes(2).count() == 0
