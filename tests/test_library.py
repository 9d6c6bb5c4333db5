"""Book files in a temporary folder: listing, opening, metadata, covers, streams, feed."""

import datetime
import hashlib
import time
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from lectern.operators import catalog, ingest, status
from lectern.plans.containers import container
from lectern.sources import covers, library
from lectern.sources.feed import write_feed
from lectern.streaming.ingest import ingest_stream, retry_failed
from lectern.streaming.progress import compact_progress, progress_stream, read_progress


def package(body="", manifest="", title="<dc:title>T</dc:title>", creator="<dc:creator>A</dc:creator>"):
    return (
        '<?xml version="1.0" encoding="UTF-8"?><opf:package xmlns:opf="http://www.idpf.org/2007/opf" '
        'version="2.0"><opf:metadata xmlns:dc="http://purl.org/dc/elements/1.1/">'
        f"{title}{creator}{body}</opf:metadata><opf:manifest>{manifest}</opf:manifest></opf:package>")


IDS = ('<dc:identifier id="bookid">urn:uuid:one</dc:identifier>'
       '<dc:identifier opf:scheme="ISBN">111</dc:identifier>'
       '<dc:identifier id="bookid" opf:scheme="ASIN">two urn:uuid:x</dc:identifier>'
       '<dc:identifier opf:scheme="ISBN">222</dc:identifier>')
COVERS = ('<opf:item id="cover-image" href="a.png"/><opf:item id="x" properties="cover-image" '
          'href="img/b c.jpg"/><opf:item id="y" href="z.png"/>')


def opened(spark, *rows):
    return spark.createDataFrame(
        [(p, 1, datetime.datetime(2024, 1, 1), x, None, e) for p, x, e in rows], library.PACKAGES_SCHEMA)


def test_identifiers_series_and_cover(spark):
    body = IDS + ('<opf:meta name="calibre:series" content="s1"/><opf:meta name="calibre:series" content="s2"/>'
                  "<dc:subject>x</dc:subject><dc:subject>y</dc:subject><dc:language>en</dc:language>"
                  "<dc:language>fr</dc:language><dc:description> a &lt;b&gt; </dc:description>")
    book = ingest.book_metadata(opened(spark, ("/l/b.epub", package(body, COVERS), None))).first()
    digest = hashlib.md5(b"urn:uuid:one111two urn:uuid:x222").hexdigest()
    assert (book.identifier, book.uuid, book.isbn, book.asin) == (digest, "two urn:uuid:x", "222", "")
    assert (book.series, book.series_index, book.language, book.tags) == ("s2", "", "en", ["x", "y"])
    assert (book.cover_url, book.cover_key, book.bucket) == (
        "img/b c.jpg", digest + "img-b c.jpg", digest[0])
    assert (book.title, book.author, book.description, book.publish_date) == ("T", "A", " a <b> ", "1970-01-01")


def test_titles(spark):
    rows = [("/l/a.b.epub", package(title="", creator=""), None), ("/l/c.epub", package(creator=""), None),
            ("/l/.epub", package(title=""), None), ("/l/e.epub", package(), "broken")]
    books = {b.path: b.title for b in ingest.book_metadata(opened(spark, *rows)).collect()}
    assert books == {"/l/a.b.epub": "a.b", "/l/c.epub": "T", "/l/.epub": ""}
    legacy = {b.path: b.title for b in ingest.book_metadata(opened(spark, *rows), legacy=True).collect()}
    assert legacy == {"/l/a.b.epub": "a.b", "/l/c.epub": "c", "/l/.epub": None}


@pytest.fixture
def shelf(tmp_path):
    root = tmp_path / "library"
    (root / "sub").mkdir(parents=True)

    def put(name, number):
        body = f"<dc:identifier>{number}</dc:identifier>"
        (root / name).write_bytes(container(package(body, COVERS), {"img/b c.jpg": b"img%d" % number}))

    put("a.epub", 1)
    put("sub/b.epub", 2)
    put("C.EPUB", 3)
    (root / "d.txt").write_text("no")
    (root / "e.epub").write_bytes(b"broken")
    return root, put


def test_scan(spark, shelf):
    root, _ = shelf
    listing = library.scan_library(spark, str(root))
    names = sorted(r.path.rsplit("/", 1)[1] for r in listing.collect())
    assert names == ["a.epub", "b.epub", "e.epub"]
    seen = listing.filter(F.col("path").endswith("a.epub"))
    assert ingest.new_files(listing, seen).count() == 2
    assert ingest.new_files(listing, seen, refresh=True).count() == 3
    parsed = library.read_packages(library.read_files(spark, str(root))).cache()
    errors = status.scan_errors(parsed).collect()
    assert len(errors) == 1 and "e.epub 解析失败：BadZipFile" in errors[0].message
    report = status.scan_report(parsed, ingest.book_metadata(parsed)).first()
    assert (report.scan_count, report.epub_count, report.failed, report.total) == (3, 2, 1, 2)


def test_ingest_stream_skips_known_books(spark, shelf, tmp_path):
    root, put = shelf
    sink, checkpoint = str(tmp_path / "sink"), str(tmp_path / "checkpoint")

    def run():
        ingest_stream(spark, str(root), sink, checkpoint).awaitTermination()
        return sorted(
            (r.title, r.identifier) for r in spark.read.parquet(f"{sink}/books").collect())

    def digest(n):
        return hashlib.md5(str(n).encode()).hexdigest()

    assert run() == sorted(("T", digest(n)) for n in (1, 2))
    put("sub/f.epub", 4)
    put("sub/copy.epub", 1)
    put("sub/copy2.epub", 4)
    assert run() == sorted(("T", digest(n)) for n in (1, 2, 4))
    assert run() == sorted(("T", digest(n)) for n in (1, 2, 4))
    stored = covers.read_covers(spark, f"{sink}/covers/batch=0")
    assert spark.read.parquet(f"{sink}/covers/batch=1").count() == 2
    assert {bytes(r.data) for r in stored.collect()} == {b"img1", b"img2"}
    assert spark.read.parquet(f"{sink}/errors").count() == 1
    # the broken file is replaced: the stream has seen it, the retry takes it
    assert not retry_failed(spark, str(root), sink, 1)
    broken = next(p for p in root.rglob("*.epub") if not zipfile.is_zipfile(p))
    time.sleep(1.1)
    put(str(broken.relative_to(root)), 9)
    assert run() == sorted(("T", digest(n)) for n in (1, 2, 4))
    assert retry_failed(spark, str(root), sink, 1)
    assert run() == sorted(("T", digest(n)) for n in (1, 2, 4, 9))
    assert not retry_failed(spark, str(root), sink, 2)
    put("sub/later.epub", 9)
    assert run() == sorted(("T", digest(n)) for n in (1, 2, 4, 9))


def test_covers(spark, tmp_path):
    path = str(tmp_path / "covers")
    rows = [("a", "a1.png", 1, 1, b"old"), ("b", "b1.txt", 1, 1, b"text"), ("1", "1.jpeg", 1, 1, b"one")]
    schema = "bucket string, key string, size bigint, last_modified bigint, data binary"
    covers.write_covers(spark.createDataFrame(rows, schema), path)
    covers.write_covers(spark.createDataFrame([("a", "a1.png", 1, 2, b"new")], schema), path)
    keys = spark.createDataFrame([("a1.png",), ("b1.txt",), ("zz.png",), ("1.jpeg",)], "key string")
    found = covers.read_covers(spark, path, keys)
    assert {r.key: bytes(r.data) for r in found.collect()} == {"a1.png": b"new", "1.jpeg": b"one"}
    assert sorted(r.bucket for r in covers.list_buckets(covers.read_covers(spark, path)).collect()) == ["1", "a", "b"]


def test_insert_new_keeps_first(spark):
    existing = spark.createDataFrame([("k1", 1, "old")], "identifier string, id int, v string")
    incoming = spark.createDataFrame(
        [("k1", 2, "no"), ("k2", 9, "late"), ("k2", 3, "first"), ("k3", 4, None)],
        "identifier string, id int, v string")
    rows = ingest.insert_new(existing, incoming, order=["id"]).collect()
    assert sorted((r.identifier, r.id, r.v or "") for r in rows) == [
        ("k1", 1, "old"), ("k2", 3, "first"), ("k3", 4, "")]


def test_feed_files(spark, tmp_path):
    books = spark.createDataFrame(
        [(1, datetime.datetime(2024, 1, 2, 3, 4, 5), "A & B", "x", "d", ""),
         (2, datetime.datetime(2024, 1, 2, 3, 4, 5), "C", "y", "e", "c.png")],
        "id bigint, utime timestamp, title string, author string, description string, cover_url string")
    path = str(tmp_path / "feed")
    write_feed(catalog.feed_entries(books, "http://h"), path, "urn:x", "Books", "http://h/opds")
    entries = spark.read.format("xml").option("rowTag", "entry").load(path)
    rows = {r.id: r for r in entries.collect()}
    assert rows[1].title == "A & B" and rows[2].author.name == "y"
    for file in spark.read.text(path, wholetext=True).collect():
        feed = ElementTree.fromstring(file.value)
        assert feed.tag == "{http://www.w3.org/2005/Atom}feed"
        assert [link.get("rel") for link in feed.findall("{*}link")] == ["start", "self"]


def test_progress_stream_over_batches(spark, tmp_path):
    source, path = tmp_path / "events", str(tmp_path / "progress")
    schema = ("event_id bigint, ts timestamp, book_id bigint, user_id bigint, progress double, "
              "progress_index bigint, para_position bigint")

    def day(n):
        return datetime.datetime(2024, 1, n)

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        progress_stream(stream, path, str(tmp_path / "checkpoint")).awaitTermination()

    def state():
        return {(r.book_id, r.user_id): (r.start_date, r.updated_at, r.progress, r.expt_end_date)
                for r in read_progress(spark, path).collect()}

    arrive([(1, day(5), 1, 1, 0.1, 1, 1), (2, day(6), 1, 1, 0.2, 1, 1), (3, day(6), 0, 1, 0.2, 1, 1)])
    assert state() == {(1, 1): (day(5), day(6), 0.2, day(20))}
    arrive([(4, day(2), 1, 1, 0.9, 1, 1), (5, day(7), 2, 1, 0.3, 1, 1)])
    want = {(1, 1): (day(5), day(2), 0.9, day(20)), (2, 1): (day(7), day(7), 0.3, day(22))}
    assert state() == want
    compact_progress(spark, path)
    assert state() == want
    arrive([(6, day(8), 2, 1, 0.4, 1, 1)])
    want[(2, 1)] = (day(7), day(8), 0.4, day(22))
    assert state() == want
