"""States in versions: runs carried through, failed, tried again, undone and read at any version."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalmill.operators import dossiers
from signalmill.operators.diff import KINDS, Limits, run
from signalmill.operators.versions import Versions
from signalmill.plans.dossiers import _IDS, _folder, _ids
from signalmill.plans.views import SNAPSHOTS, Query, orders_after, orders_before

KEYS, RELEVANT = ["key"], ["holder", "priority", "status"]
LOOSE, TIGHT = Limits.of({k: {"percent": 95.0} for k in KINDS}), Limits.of({"disappeared": {"percent": 0.1, "count": 1}})
STEPS = ("state", "changes", "manifest", "deliver", "delivered")


class Failure(Exception):
    pass


def state_versions(spark, sf_dir):
    """A reference, an accepted run, a quarantined one, its acceptance and an undo,
    each read at its own version in the end."""
    old, new = orders_before(spark, sf_dir), orders_after(spark, sf_dir)
    held = Versions(spark, _folder(spark, "versions"))
    held.finish(run(None, old, KEYS, RELEVANT), "first")
    held.finish(run(held.read(), new, KEYS, RELEVANT, earlier_runs=9, limits=LOOSE), "second", base=1)
    # New keys of the second run are gone again: too many for the tight limits.
    third = held.finish(run(held.read(), old, KEYS, RELEVANT, earlier_runs=9, limits=TIGHT), "third", base=2)
    held.settle(third, KEYS, True, "third, accepted")
    held.undo()
    told = held.history().select("version", "status", F.col("rows").alias("rows_read"))
    counted = None
    for number in range(1, 6):
        one = held.read(number).agg(F.lit(number).cast("long").alias("version"), F.count("*").alias("n"), F.sum("key").alias("keys"), F.sum("holder").alias("holders"), F.count("priority").alias("priorities"), F.count_if(F.col("status") == "X").alias("changed"))
        counted = one if counted is None else counted.unionByName(one)
    return told.join(counted, "version")


def failed_runs(spark, sf_dir):
    """A run that fails at each of its steps: what a reader sees then, and what is
    there after it was tried again."""
    old, new = orders_before(spark, sf_dir), orders_after(spark, sf_dir)
    first, second = run(None, old, KEYS, RELEVANT), run(old, new, KEYS, RELEVANT, earlier_runs=9, limits=LOOSE)
    rows = []
    for broken in STEPS:
        held, passed = Versions(spark, _folder(spark, "versions")), []

        def receive(number, found, passed=passed):
            passed.append((number, found.count()))

        def fail(step, broken=broken):
            if step == broken:
                raise Failure(step)

        held.finish(first, "first", receiver=receive)
        try:
            held.finish(second, "second", receiver=receive, base=1, step=fail)
        except Failure:
            seen, waiting = held.read().count(), len(held.undelivered())
            again = held.finish(second, "second", receiver=receive, base=1)
            rows.append((broken, seen, waiting, again, held.read().count(), held.history().count(), sum(n for _, n in passed)))
    return spark.createDataFrame(rows, "step string, seen long, waiting int, version int, after long, versions long, passed long")


def undone_versions(spark, sf_dir):
    """Ids written as a version and taken back by undoing it."""
    companies, placed = _ids(spark, sf_dir)
    held = Versions(spark, _folder(spark, "versions"))
    held.write(companies, "companies")
    held.write(dossiers.write_ids(held.read(), placed, ["city"])[0], "ids")
    held.undo()
    columns = lambda number, name: held.read(number).select("company_id", F.col("id").alias(name), F.col("status").alias(f"{name}_status"))
    return columns(2, "written").join(columns(3, "undone"), "company_id")


QUERIES: dict[str, Query] = {f.__name__: f for f in (state_versions, failed_runs, undone_versions)}

_COUNTS = "count(*) AS n, CAST(sum(key) AS BIGINT) AS keys, CAST(sum(holder) AS BIGINT) AS holders, count(priority) AS priorities, count(CASE WHEN status = 'X' THEN 1 END) AS changed"
SQL = {
    "state_versions": f"""WITH {SNAPSHOTS}, b AS (SELECT {_COUNTS} FROM before_), a AS (SELECT {_COUNTS} FROM after_)
SELECT CAST(1 AS BIGINT) AS version, 'reference' AS status, n AS rows_read, b.* FROM b UNION ALL SELECT 2, 'accepted', n, a.* FROM a UNION ALL SELECT 3, 'quarantined', (SELECT n FROM b), a.* FROM a
UNION ALL SELECT 4, 'written', NULL, b.* FROM b UNION ALL SELECT 5, 'undone', NULL, a.* FROM a""",
    "failed_runs": f"""WITH {SNAPSHOTS}, b AS (SELECT count(*) AS n FROM before_), a AS (SELECT count(*) AS n FROM after_),
c AS (SELECT count(*) AS n FROM before_ b FULL OUTER JOIN after_ a ON a.key = b.key WHERE a.key IS NULL OR b.key IS NULL OR a.holder IS DISTINCT FROM b.holder OR a.priority IS DISTINCT FROM b.priority OR a.status IS DISTINCT FROM b.status),
s AS (SELECT unnest(['state', 'changes', 'manifest', 'deliver', 'delivered']) AS step)
SELECT step, CASE WHEN step IN ('deliver', 'delivered') THEN a.n ELSE b.n END AS seen, CASE WHEN step IN ('deliver', 'delivered') THEN 1 ELSE 0 END AS waiting, 2 AS version, a.n AS after, CAST(2 AS BIGINT) AS versions,
       CASE WHEN step = 'delivered' THEN 2 ELSE 1 END * c.n AS passed FROM s, a, b, c""",
    "undone_versions": f"{_IDS} SELECT company_id, id AS written, status AS written_status, CASE WHEN place IS NOT NULL THEN id_before ELSE id END AS undone, CASE WHEN place IS NOT NULL THEN 'not found' ELSE status END AS undone_status FROM w",
}
