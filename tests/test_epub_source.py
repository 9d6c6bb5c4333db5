"""The data source of book files, and the stream that retries by itself."""

import datetime
import io
import os
import time
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectern.plans.containers import container
from lectern.sources import epub_source, library
from lectern.streaming.ingest import retrying_stream

ITEM = '<item id="cover-image" href="c.png"/>'


def book(number, cover=b"image"):
    opf = (f'<package xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>T{number}</dc:title>'
           f"<dc:identifier>{number}</dc:identifier></metadata><manifest>{ITEM}</manifest></package>")
    return container(opf, {"c.png": cover})


def with_broken_cover(number):
    """A container whose cover cannot be read: its checksum is wrong."""
    data = bytearray(book(number, b"cover that is spoiled " * 9))
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        info = archive.getinfo("OEBPS/c.png")
    at = info.header_offset + 30 + len(info.filename) + 4
    data[at] ^= 0xFF
    return bytes(data)


@pytest.fixture
def shelf(tmp_path):
    root = tmp_path / "shelf"
    (root / "sub" / "_hidden").mkdir(parents=True)
    for n in range(6):
        (root / f"b{n}.epub").write_bytes(book(n))
        os.utime(root / f"b{n}.epub", (1_700_000_000 + n, 1_700_000_000 + n))
    (root / "sub" / "ü b.epub").write_bytes(book(7, b"x" * 4000))
    (root / "sub" / "cut.epub").write_bytes(book(8)[:50])
    (root / "spoiled.epub").write_bytes(with_broken_cover(9))
    (root / "sub" / "_hidden" / "h.epub").write_bytes(book(10))
    (root / "other.EPUB").write_bytes(book(11))
    return str(root)


@pytest.fixture
def epub(spark, shelf):
    epub_source.register(spark)
    return lambda columns=library.PACKAGES_SCHEMA, **options: spark.read.format("epub").schema(columns).options(
        **options).load(shelf)


def plain(df):
    return sorted(map(tuple, df.collect()))


def test_rows_as_those_of_the_reader(spark, shelf, epub):
    want = library.read_packages(library.read_files(spark, shelf)).drop("error")
    got = epub()
    assert got.count() == 9
    assert plain(got.drop("error").filter("opf_xml IS NOT NULL")) == plain(want.filter("opf_xml IS NOT NULL"))
    assert {os.path.basename(r.path): r.error.split(":")[0] for r in got.filter("error IS NOT NULL").collect()} == {
        "cut.epub": "BadZipFile", "spoiled.epub": epub_source.read_package(f"{shelf}/spoiled.epub")["error"].split(":")[0]}


def test_a_cover_that_is_not_asked_for_is_not_read(epub):
    """The spoiled cover is an error only where covers are asked for."""
    asked = epub("path string, opf_xml string, error string").filter(F.col("path").endswith("spoiled.epub")).first()
    assert asked.error is None and "T9" in asked.opf_xml
    assert epub().filter(F.col("path").endswith("spoiled.epub")).first().error
    # a listing opens nothing: the cut file is no error
    assert epub("path string, size bigint, error string").filter("error IS NOT NULL").count() == 1
    assert epub("path string, size bigint").count() == 9


def test_filters_leave_files_out_before_they_are_opened(shelf):
    from pyspark.sql.datasource import (
        EqualTo, GreaterThan, In, LessThanOrEqual, Not, StringContains, StringEndsWith)

    def listed(*filters):
        reader = epub_source.EpubReader(StructType.fromDDL(library.PACKAGES_SCHEMA), {"path": shelf})
        left = list(reader.pushFilters(list(filters)))
        return sorted(os.path.basename(r[0]) for part in reader.partitions() for r in part.rows), left

    assert len(listed()[0]) == 9
    assert listed(StringEndsWith(("path",), "b3.epub")) == (["b3.epub"], [])
    assert listed(In(("path",), (f"file:{shelf}/b1.epub",)), StringContains(("path",), "b"))[0] == ["b1.epub"]
    utc = datetime.datetime.fromtimestamp(1_700_000_002, datetime.timezone.utc)
    assert listed(LessThanOrEqual(("ctime",), utc))[0] == ["b0.epub", "b1.epub", "b2.epub"]
    assert listed(GreaterThan(("size",), 10**9))[0] == []
    kept = [EqualTo(("opf_xml",), "x"), Not(EqualTo(("path",), "x"))]
    assert listed(*kept)[1] == kept


def test_filters_reach_the_source(epub, shelf):
    at = datetime.datetime.fromtimestamp(1_700_000_003, datetime.timezone.utc)
    got = epub().filter((F.col("ctime") < F.lit(at)) & (F.col("size") > 10))
    assert sorted(os.path.basename(r.path) for r in got.collect()) == ["b0.epub", "b1.epub", "b2.epub"]
    assert epub().filter(F.col("path") == f"file:{shelf}/b5.epub").count() == 1
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.split("BatchScan")[0] or "ctime" in plan


def test_partitions_go_by_length(epub, shelf):
    reader = epub_source.EpubReader(StructType.fromDDL("path string"), {"path": shelf, "maxPartitionBytes": "3000000"})
    parts = reader.partitions()
    assert len(parts) == 5 and sorted(len(p.rows) for p in parts) == [1, 2, 2, 2, 2]
    assert epub(maxPartitionBytes="1000000").rdd.getNumPartitions() == 9
    with pytest.raises(Exception, match="no column"):
        epub("path string, pages int").count()
    (empty := os.path.join(shelf, "empty")) and os.mkdir(empty)
    assert epub().sparkSession.read.format("epub").load(empty).collect() == []


def test_a_running_stream_retries_by_itself(spark, tmp_path):
    root, sink = tmp_path / "root", str(tmp_path / "sink")
    root.mkdir()
    (root / "good.epub").write_bytes(book(1))
    (root / "late.epub").write_bytes(b"broken")
    (root / "never.epub").write_bytes(b"broken for good")
    query = retrying_stream(spark, str(root), sink, str(tmp_path / "checkpoint"), every="1 second",
                            first_wait=1, longest_wait=2, tries=4, remembered=1)

    def tries(name):
        try:
            found = spark.read.parquet(f"{sink}/packages").filter(F.col("path").endswith(name)).collect()
        except Exception:  # noqa: BLE001 - nothing written yet, or a file just being replaced
            return []
        return [r.error is None for r in found]

    def wait(for_it, seconds=90):
        end = time.time() + seconds
        while not for_it():
            assert time.time() < end and query.isActive, query.exception()
            time.sleep(0.5)

    try:
        wait(lambda: tries("late.epub") == [False, False])
        (root / "late.epub").write_bytes(book(2))
        wait(lambda: True in tries("late.epub"))
        wait(lambda: len(tries("never.epub")) == 4)
        time.sleep(4)
        assert tries("late.epub").count(True) == 1 and len(tries("never.epub")) == 4
        assert tries("good.epub") == [True]
    finally:
        query.stop()
    assert sorted(r.title for r in spark.read.parquet(f"{sink}/books").collect()) == ["T1", "T2"]
    state = spark.read.format("statestore").option("path", str(tmp_path / "checkpoint")).option(
        "stateVarName", "tried").load()
    assert state.count() == 0
