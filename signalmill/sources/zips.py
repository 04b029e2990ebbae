"""CSV members of zip archives as a data source, read without unpacking.

Every member is a partition: a task opens the archive, streams the member through
the decompressor and hands over named columns in batches, so that neither an
archive nor a member is held whole or written out. Planning reads the archives'
directories only. A member can't be split, as its compression can't.

    spark.dataSource.register(ZipMembers)
    spark.read.format("zip_members").option("members", "*/Nom.csv").option("columns", "NEQ,NOM_ASSUJ").load(path)

``columns`` are titles, all strings, beside ``archive`` and ``member``; a member
that misses one is refused with its name before any of its rows. Filters on
``member`` leave out partitions with the option ``pushdown`` (it needs the setting
``spark.sql.python.filterPushdown.enabled``); the option ``members``, a pattern, always does.

Defined results: texts are UTF-8 with or without a mark at the start, other bytes
are replaced; a short row has nulls at its end, cells beyond the titles are left
out, blank rows give none; of equal titles the first counts; an empty member has
no titles and is refused; fields of any length are read.
"""

from __future__ import annotations

import csv
import io
import sys
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

ROWS = 2_000


def _place(path: str):
    from pyarrow import fs

    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


@dataclass
class Member(InputPartition):
    archive: str
    name: str


class _Reader(DataSourceReader):
    def __init__(self, path: str, pattern: str, schema: StructType):
        self.path, self.pattern, self.schema, self.only = path, pattern, schema, None

    def partitions(self) -> list[Member]:
        from pyarrow import fs

        system, place = _place(self.path)
        info = system.get_file_info(place)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(place, recursive=True))
        made = []
        for archive in sorted(i.path for i in found if i.is_file and i.path.lower().endswith(".zip")):
            with system.open_input_file(archive) as f, zipfile.ZipFile(f) as z:
                names = [i.filename for i in z.infolist() if not i.is_dir()]
            made += [Member(archive, n) for n in names if fnmatchcase(n, self.pattern) and (self.only is None or n in self.only)]
        return made

    def read(self, partition: Member | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        system, _ = _place(self.path)
        wanted = self.schema.names[2:]
        arrow = pa.schema([(n, pa.string()) for n in self.schema.names])
        csv.field_size_limit(min(sys.maxsize, (1 << 31) - 1))
        with system.open_input_file(partition.archive) as f, zipfile.ZipFile(f) as z, z.open(partition.name) as data:
            rows = csv.reader(io.TextIOWrapper(data, "utf-8-sig", "replace", newline=""))
            titles = next(rows, [])
            missing = [n for n in wanted if n not in titles]
            if missing:
                raise ValueError(f"{partition.archive}: {partition.name} has no column {', '.join(missing)}")
            at, held = [titles.index(n) for n in wanted], []

            def batch() -> pa.RecordBatch:
                same = [pa.array([x] * len(held), pa.string()) for x in (partition.archive, partition.name)]
                return pa.RecordBatch.from_arrays(same + [pa.array([r[i] if i < len(r) else None for r in held], pa.string()) for i in at], schema=arrow)

            for row in rows:
                if row:
                    held.append(row)
                if len(held) == ROWS:
                    yield batch()
                    held = []
            if held:
                yield batch()


class _FilteredReader(_Reader):
    """Takes filters on ``member``; Spark refuses such a reader where the pushdown is off."""

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("member",):
                named = set(f.value) if isinstance(f, In) else {f.value}
                self.only = named if self.only is None else self.only & named
            else:
                yield f


class ZipMembers(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> StructType:
        columns = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        return StructType([StructField(n, StringType()) for n in ("archive", "member", *columns)])

    def reader(self, schema: StructType) -> DataSourceReader:
        kind = _FilteredReader if self.options.get("pushdown", "false") == "true" else _Reader
        return kind(self.options["path"], self.options.get("members", "*"), schema)


def zip_members(spark: SparkSession, path: str, columns: list[str], members: str = "*.csv", pushdown: bool = False) -> DataFrame:
    """The named columns of all members that match, of one archive or of all in a folder."""
    spark.dataSource.register(ZipMembers)
    return spark.read.format("zip_members").option("members", members).option("columns", ",".join(columns)).option("pushdown", str(pushdown).lower()).load(path)
