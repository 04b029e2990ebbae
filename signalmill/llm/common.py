"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch. Texts may be long, so batches are kept small.
ARROW_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Bounds the memory of an Arrow batch of whole texts, unless the session has
    a bound of its own. Spark reads the setting when a query runs, so it stays."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(setting)) in (0, 10_000):  # Spark's default
        spark.conf.set(setting, str(ARROW_ROWS))


def parts_of(spark: SparkSession, total: int, part_bytes: int, least_bytes: int = 1 << 20) -> int:
    """Partitions for so many bytes: of ``part_bytes`` each, or smaller ones if
    that leaves the cluster's cores without work, but not below ``least_bytes``."""
    return max(1, -(-total // part_bytes), min(spark.sparkContext.defaultParallelism, -(-total // least_bytes)))


def one_task_each(manifest: DataFrame, order: str, most: int = 100_000) -> DataFrame:
    """A manifest's rows dealt to tasks by ranges of ``order``: a task for each
    file, up to ``most`` tasks. A range partitioning with a given number isn't
    coalesced, however few bytes the rows have, and equal parts don't collide."""
    return manifest.repartitionByRange(min(most, max(1, manifest.count())), order)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI.

    It is the cluster's ``spark.checkpoint.dir``, or the folder given to
    ``setCheckpointDir``. Only a local session, as in tests, may do without: it
    gets a temporary folder. A cluster has no folder to fall back on.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="signalmill-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder; later steps read the files.

    A reliable checkpoint: it survives the loss of executors and isn't
    recomputed by every branch that reads it.
    """
    where = shared_dir(df.sparkSession)
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(where)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, kind: str) -> str:
    """A fresh folder name for files that an operator writes."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def spare(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that the rows don't have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


class open_shared:  # noqa: N801
    """A file of the shared folder, in a task. With ``attempt`` it is written:
    under a name of the attempt's own, renamed to ``path`` when all went well."""

    def __init__(self, path: str, attempt: int | None = None):
        from pyarrow import fs

        self.path, self.attempt, self.stream = path, attempt, None
        self.system, self.place = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")

    def __enter__(self) -> open_shared:
        return self

    def open(self):
        if self.attempt is None:
            self.stream = self.system.open_input_file(self.place)
        else:
            folder, _, name = self.place.rpartition("/")
            self.system.create_dir(folder, recursive=True)
            self.draft = f"{folder}/_{name}.{self.attempt}"
            self.stream = self.system.open_output_stream(self.draft)
        return self.stream

    def __exit__(self, kind, *_) -> None:
        if self.stream:
            self.stream.close()
            if self.attempt is not None and kind is None:
                self.system.move(self.draft, self.place)
