"""Book files: listing a library and opening its containers."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from typing import IO
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.ingest import COVER_MARK
from lectern.session import bound_batches, shared_folder

CONTAINER = "META-INF/container.xml"
FILES_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
PACKAGES_SCHEMA = (
    "path string, size bigint, ctime timestamp, opf_xml string, cover_bytes binary, error string")
PACKAGE_COLUMNS = [column.split()[0] for column in PACKAGES_SCHEMA.split(", ")]
# What a file counts when files are dealt into tasks that open none.
OPEN_COST, LISTED_BYTES = "spark.sql.files.openCostInBytes", str(128 << 10)
# Files whose packages are held at once.
OPENED = 64


def read_files(spark: SparkSession, root: str, glob: str = "*.epub") -> DataFrame:
    """Files below ``root`` with their content; the name must match exactly, case included."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root))


def scan_library(spark: SparkSession, root: str, glob: str = "*.epub") -> DataFrame:
    """Listing (path, size, ctime) as of now, written to the shared folder.

    The content column is pruned, so no file is opened; a file therefore counts little when files are dealt
    into tasks, unlike where they are read.
    """
    cost = spark.conf.get(OPEN_COST)
    found = read_files(spark, root, glob).select(
        "path", F.col("length").alias("size"), F.col("modificationTime").alias("ctime"))
    path = shared_folder(spark, "listing")
    spark.conf.set(OPEN_COST, LISTED_BYTES)
    try:
        found.write.parquet(path)
    finally:
        spark.conf.set(OPEN_COST, cost)
    return spark.read.schema(found.schema).parquet(path)


def open_container(file: IO[bytes], cover: bool = True) -> tuple[str, bytes | None]:
    """Package document and, if asked for, cover bytes of one container; no other entry is read."""
    with zipfile.ZipFile(file) as archive:
        container = ElementTree.fromstring(archive.read(CONTAINER))
        roots = [e.get("full-path") for e in container.iter() if e.tag.endswith("rootfile")]
        if not roots:
            raise ValueError("no package document")
        document = archive.read(roots[0])
        marked = [
            e.get("href") for e in ElementTree.fromstring(document).iter()
            if e.tag.rsplit("}", 1)[-1] == "item" and COVER_MARK in (e.get("id"), e.get("properties"))]
        image = None
        if marked and cover:
            name = posixpath.normpath(posixpath.join(posixpath.dirname(roots[0]), unquote(marked[-1])))
            image = archive.read(name)
        return document.decode("utf-8-sig"), image


def read_packages(files: DataFrame) -> DataFrame:
    """Package document and cover of each file; a file that cannot be read becomes an error row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, OPENED):
                some = batch.slice(start, OPENED)
                rows = []
                for content in some.column(3):
                    try:
                        rows.append((*open_container(io.BytesIO(content.as_py())), None))
                    except Exception as problem:  # noqa: BLE001 - any broken file is reported, not raised
                        rows.append((None, None, f"{type(problem).__name__}: {problem}"))
                opened = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.binary(), pa.string()))]
                yield pa.record_batch([*some.columns[:3], *opened], names=PACKAGE_COLUMNS)

    bound_batches(files.sparkSession)
    return files.select(
        "path", F.col("length").alias("size"),
        F.col("modificationTime").cast("timestamp").alias("ctime"), "content",
    ).mapInArrow(run, PACKAGES_SCHEMA)
