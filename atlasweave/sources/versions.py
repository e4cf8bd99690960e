"""Several tables published as one version, so that a reader sees all of them or none.

A version's tables are written to a folder of their own; then a numbered pointer file is created that names the folder.  Creating a file that
must not exist is atomic, so of two writers that started from one version the second is refused, and a writer that
dies before its pointer is complete leaves the last version in force.  Old versions stay readable until they are removed.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter
from pyspark.sql.types import StructType

from ..functions.lineage import shuffles_removed

#: Seconds after which a pointer without content counts as left by a writer that died.
ABANDONED = 60.0


class Conflict(RuntimeError):
    """Another writer has published meanwhile; nothing of this version is visible."""


@dataclass(frozen=True)
class Table:
    """A table to publish: its rows, the columns that its folders are named by, and the order within files.

    gathered is done to rows once the order has brought equal ones together, so that grouping by folders and order takes no shuffle of its own.
    slices are conditions that deal out the rows, each in one slice; a slice is written before the next is read, so the disk holds one's shuffle at a time.
    """

    rows: DataFrame
    folders: tuple[str, ...] = ()
    order: tuple[str, ...] = ()
    gathered: Callable[[DataFrame], DataFrame] | None = None
    slices: tuple[Column, ...] = ()

    def write(self, path: str) -> None:
        for rows in [self.rows.where(s) for s in self.slices] or [self.rows]:
            if self.order:  # ranges of the whole order, so a frequent folder or key is spread over several files
                rows = rows.repartitionByRange(*self.folders, *self.order)
                rows = (self.gathered(rows) if self.gathered else rows).sortWithinPartitions(*self.folders, *self.order)
            writer: DataFrameWriter = rows.write.mode("append" if self.slices else "errorifexists")
            (writer.partitionBy(*self.folders) if self.folders else writer).parquet(path)

    @property
    def schema(self) -> StructType:
        return (self.gathered(self.rows) if self.gathered else self.rows).schema


def dealt(number: Column, slices: int) -> tuple[Column, ...]:
    """Conditions that deal out rows by a number of theirs."""
    return tuple(F.pmod(number, F.lit(slices)) == k for k in range(slices)) if slices > 1 else ()


def remove(spark: SparkSession, place: str) -> None:
    fs, path = _path(spark, place)
    fs.delete(path, True)


@dataclass(frozen=True)
class Version:
    """A published version: its number, the folder of its tables, their schemas, and what its writer noted."""

    number: int
    data: str
    schemas: dict[str, str] = field(default_factory=dict)
    meta: dict[str, str] = field(default_factory=dict)

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        schema = StructType.fromDDL(self.schemas[name])
        return spark.read.schema(schema).parquet(f"{self.data}/{name}").select(*[f"`{n}`" for n in schema.names])


def _path(spark: SparkSession, place: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _text(spark: SparkSession, place: str) -> str:
    fs, path = _path(spark, place)
    stream = fs.open(path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _pointers(spark: SparkSession, folder: str) -> list[tuple[int, int, float]]:
    """Number, size and age in seconds of all pointers, the last one first."""
    fs, path = _path(spark, f"{folder}/pointers")
    if not fs.exists(path):
        return []
    found = [s for s in fs.listStatus(path) if s.getPath().getName().isdigit()]
    return sorted(((int(s.getPath().getName()), s.getLen(), time.time() - s.getModificationTime() / 1000) for s in found), reverse=True)


def current(spark: SparkSession, folder: str, number: int | None = None) -> Version | None:
    """The last complete version, or the one of a number; None if there is none."""
    for n, size, _ in _pointers(spark, folder):
        if size and number in (None, n):
            text = _text(spark, f"{folder}/pointers/{n:09d}")
            if text.endswith("\n"):  # else it is still being written
                return Version(n, **json.loads(text))
    return None


def publish(spark: SparkSession, folder: str, tables: dict[str, Table], base: Version | None = None, meta: dict[str, str] | None = None, check: Callable[[Version], None] | None = None) -> Version:
    """Write the tables and make them the current version, if the current one is still `base`; else Conflict.

    check gets the version when its tables are written and may raise, so that it never becomes visible.
    """
    data = f"{folder}/versions/{uuid4().hex}"
    with shuffles_removed(spark):
        for name, table in tables.items():
            table.write(f"{data}/{name}")
    number = base.number if base else 0
    version = Version(number + 1, data, {name: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in t.schema) for name, t in tables.items()}, meta or {})
    if check:
        check(version)
    known = _pointers(spark, folder)
    if any(size and n > number for n, size, _ in known) or any(not size and n > number and age < ABANDONED for n, size, age in known):
        raise Conflict(f"{folder} has moved on from version {number}")
    number = max([number, *(n for n, _, _ in known)]) + 1
    version = Version(number, data, version.schemas, version.meta)
    fs, path = _path(spark, f"{folder}/pointers/{number:09d}")
    try:
        stream = fs.create(path, False)
    except Exception as e:
        raise Conflict(f"version {number} of {folder} is being published by another writer") from e
    try:
        stream.write(bytearray((json.dumps({"data": version.data, "schemas": version.schemas, "meta": version.meta}) + "\n").encode()))
    finally:
        stream.close()
    return version


def remove_old(spark: SparkSession, folder: str, keep: int = 2) -> list[int]:
    """Remove all but the last versions; a reader of an older one must be done by then."""
    complete = [n for n, size, _ in _pointers(spark, folder) if size]
    gone = []
    for n in complete[keep:]:
        old = current(spark, folder, n)
        for place in ([old.data] if old else []) + [f"{folder}/pointers/{n:09d}"]:
            remove(spark, place)
        gone.append(n)
    return gone


def fingerprint(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """path, changed (time of modification) and length of all files; their contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    return found.select("path", found["modificationTime"].alias("changed"), "length")
