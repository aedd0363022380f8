"""The registry workbook as a data source: ``spark.read.format("registry_xlsx")`` and, for the cells to fill, a write that is all or nothing.

    register(spark)
    rows = spark.read.format("registry_xlsx").load(path)                      # a workbook, or a folder of them: a partition each
    edits.write.format("registry_xlsx").option("source", path).mode("overwrite").save(copy)

Edits are (row, column, value, kind) as registry.edits gives them. Tasks hand them over as commit messages; the copy is made at commit, next to
its place, and then moved there, so a job that fails leaves nothing behind. The edits of one workbook are at most its cells.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from reconspark.sources import registry

EDIT = ("row", "column", "value", "kind")


def place(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path within it, of an address or of a path that all machines share."""
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def load(path: str) -> bytes:
    system, inner = place(path)
    with system.open_input_stream(inner) as f:
        return f.read()


def digest(path: str) -> str:
    """SHA-256 of a workbook: given with a plan, it makes a later write refuse a workbook that has changed meanwhile."""
    return hashlib.sha256(load(path)).hexdigest()


@dataclass
class Workbook(InputPartition):
    path: str


class Reader(DataSourceReader):
    def __init__(self, path: str, sheet: str):
        self.path, self.sheet = path, sheet

    def partitions(self) -> list[Workbook]:
        system, inner = place(self.path)
        found = system.get_file_info(inner)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if found.type == fs.FileType.File:
            return [Workbook(self.path)]
        root = self.path.rstrip("/")
        names = sorted(i.base_name for i in system.get_file_info(fs.FileSelector(inner)) if i.type == fs.FileType.File and i.base_name.lower().endswith(".xlsx"))
        return [Workbook(f"{root}/{n}") for n in names]

    def read(self, partition: Workbook) -> Iterator[tuple]:
        yield from registry.registry_rows(load(partition.path), partition.path, self.sheet)


@dataclass
class Edits(WriterCommitMessage):
    cells: list[tuple[int, str, str, str]]


class Writer(DataSourceWriter):
    def __init__(self, source: str, target: str, sheet: str, expected: str | None, overwrite: bool):
        self.source, self.target, self.sheet, self.expected, self.overwrite = source, target, sheet, expected, overwrite

    def write(self, iterator: Iterator[Row]) -> Edits:
        return Edits([tuple(r[c] for c in EDIT) for r in iterator])

    def commit(self, messages: list[Edits | None]) -> None:
        book = load(self.source)
        if self.expected and hashlib.sha256(book).hexdigest() != self.expected:
            raise ValueError(f"{self.source} has changed since the plan was made")
        cells = sorted(c for m in messages if m for c in m.cells)
        if len({c[:2] for c in cells}) < len(cells):
            raise ValueError("a cell has two values")
        system, inner = place(self.target)
        if not self.overwrite and system.get_file_info(inner).type != fs.FileType.NotFound:
            raise FileExistsError(self.target)
        made, near = registry.save_copy(book, cells, self.sheet), f"{inner}.{uuid.uuid4().hex}.tmp"
        try:
            with system.open_output_stream(near) as f:
                f.write(made)
            system.move(near, inner)
        except BaseException:
            if system.get_file_info(near).type != fs.FileType.NotFound:
                system.delete_file(near)
            raise

    def abort(self, messages: list[Edits | None]) -> None:
        """Nothing is written before commit."""


class RegistryWorkbook(DataSource):
    """Options: path; sheet (registry.SHEET by default); for a write source, and sha256 of it when the plan was made (optional)."""

    @classmethod
    def name(cls) -> str:
        return "registry_xlsx"

    def schema(self) -> str:
        return registry.ROWS

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], self.options.get("sheet", registry.SHEET))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        source, target = self.options.get("source"), self.options["path"]
        if not source:
            raise ValueError("option source: the workbook to copy")
        if [*map(str.casefold, EDIT)] != [f.name.casefold() for f in schema.fields]:
            raise ValueError(f"the columns of edits are {', '.join(EDIT)}")
        if place(source)[1].rstrip("/") == place(target)[1].rstrip("/"):
            raise ValueError("the copy must not replace its source")
        return Writer(source, target, self.options.get("sheet", registry.SHEET), self.options.get("sha256"), overwrite)


def register(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(RegistryWorkbook)
    return spark
