"""Book files as a data source: ``spark.read.format("epub").load(root)``.

Files are listed once, on the driver, and filters on path, size and time leave files out before any is
opened. What is left is dealt into partitions by length. A task opens a container at its directory and
reads only the entries that the asked columns need: the package document, the cover if there is a
``cover_bytes`` column in the schema, or nothing at all. Columns are asked for by ``schema``, since Spark
does not tell a source which of its columns a query uses.
"""

from __future__ import annotations

import datetime
import fnmatch
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition,
    LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith)
from pyspark.sql.types import StructType

from lectern.sources.library import PACKAGES_SCHEMA, open_container

PARTITION_BYTES = 128 << 20
# A file counts as at least so many bytes.
OPEN_BYTES = 1 << 20
ROWS = 64
LISTED = ("path", "size", "ctime")

_TESTS: dict[type, Callable] = {
    EqualTo: lambda x, v: x == v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v,
    LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v, In: lambda x, v: x in v,
    StringStartsWith: lambda x, v: x.startswith(v), StringEndsWith: lambda x, v: x.endswith(v),
    StringContains: lambda x, v: v in x}


def located(uri: str) -> tuple[pafs.FileSystem, str, str]:
    """The file system of a path, the path there, and what goes before it in the path column."""
    if "://" not in uri:
        path = uri.removeprefix("file:")
        return pafs.LocalFileSystem(), path, "file:"
    system, path = pafs.FileSystem.from_uri(uri)
    return system, path, uri[:len(uri) - len(path.lstrip("/"))].rstrip("/") + "/" * (not path.startswith("/"))


@dataclass
class Files(InputPartition):
    """(path, size, time) of the files of a task."""

    rows: list[tuple[str, int, datetime.datetime]]


class EpubReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.root, self.glob = options["path"], options.get("pathGlobFilter", "*.epub")
        self.most = int(options.get("maxPartitionBytes", PARTITION_BYTES))
        self.names = schema.fieldNames()
        known = dict(column.split() for column in PACKAGES_SCHEMA.split(", "))
        for field in schema:
            if known.get(field.name) != field.dataType.simpleString():
                raise ValueError(f"a book file has no column {field.name} {field.dataType.simpleString()}")
        self.tests: list[tuple[int, Callable, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for one in filters:
            name = getattr(one, "attribute", ())
            test = _TESTS.get(type(one))
            if test is None or len(name) != 1 or name[0] not in LISTED:
                yield one
            else:
                self.tests.append((LISTED.index(name[0]), test, one.value))

    def listed(self) -> list[tuple[str, int, datetime.datetime]]:
        """The files below the root that every pushed filter accepts."""
        system, path, before = located(self.root)
        found = []
        for info in system.get_file_info(pafs.FileSelector(path, recursive=True)):
            parts = info.path[len(path):].strip("/").split("/")
            if info.type != pafs.FileType.File or any(p[:1] in ("_", ".") for p in parts):
                continue
            if not fnmatch.fnmatchcase(info.base_name, self.glob):
                continue
            # to the millisecond, as Spark's own listings
            time = info.mtime.replace(microsecond=info.mtime.microsecond // 1000 * 1000)
            row = (before + info.path, info.size, time)
            if all(test(row[at], _in_utc(value)) for at, test, value in self.tests):
                found.append(row)
        return found

    def partitions(self) -> list[Files]:
        """Largest files first, each to a partition that still has room, so tasks read alike."""
        parts, held = [], 0
        for row in sorted(self.listed(), key=lambda r: (-r[1], r[0])):
            size = max(row[1], OPEN_BYTES)
            if not parts or held + size > self.most:
                parts.append(Files([]))
                held = 0
            parts[-1].rows.append(row)
            held += size
        return parts or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        kinds = {"path": pa.string(), "size": pa.int64(), "ctime": pa.timestamp("us", tz="UTC"),
                 "opf_xml": pa.string(), "cover_bytes": pa.binary(), "error": pa.string()}
        schema = pa.schema([(n, kinds[n]) for n in self.names])
        opens = bool({"opf_xml", "cover_bytes", "error"} & set(self.names))
        for start in range(0, len(partition.rows), ROWS):
            rows = []
            for path, size, time in partition.rows[start:start + ROWS]:
                row = {"path": path, "size": size, "ctime": time}
                if opens:
                    row |= read_package(path, "cover_bytes" in self.names)
                rows.append({n: row.get(n) for n in self.names})
            yield pa.RecordBatch.from_pylist(rows, schema)


def _in_utc(value: object) -> object:
    """Times that Spark hands over without a zone are in the zone of this process."""
    if isinstance(value, (list, tuple)):
        return [_in_utc(x) for x in value]
    return value.astimezone(datetime.timezone.utc) if isinstance(value, datetime.datetime) else value


def read_package(uri: str, cover: bool = True) -> dict[str, object]:
    """opf_xml, cover_bytes and error of one file, of which only the needed entries are read."""
    try:
        system, path, _ = located(uri)
        with system.open_input_file(path) as file:
            document, image = open_container(file, cover)
        return {"opf_xml": document, "cover_bytes": image, "error": None}
    except Exception as problem:  # noqa: BLE001 - any broken file is reported, not raised
        return {"opf_xml": None, "cover_bytes": None, "error": f"{type(problem).__name__}: {problem}"}


class EpubSource(DataSource):
    """Options: ``pathGlobFilter`` (*.epub) and ``maxPartitionBytes``."""

    @classmethod
    def name(cls) -> str:
        return "epub"

    def schema(self) -> str:
        return PACKAGES_SCHEMA

    def reader(self, schema: StructType) -> EpubReader:
        return EpubReader(schema, self.options)


def register(spark: SparkSession) -> None:
    """Makes ``format("epub")`` known to the session, with filters pushed into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(EpubSource)
