"""Ingest and status queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import ingest, known_keys, status
from lectern.plans import views as v
from lectern.plans.query import QuerySet
from lectern.plans.sql_views import CLEAN_TEXT, SCANNED, query
from lectern.session import shared_folder
from lectern.sources import covers, library, texts

QUERIES = QuerySet()

_COVER = "'img/' || lang || '.png'"
# identifier values in document order
BOOK_FILES = f"""books AS (
  SELECT '/library/' || source || '/book.' || doc_id || '.epub' AS path, n_chars AS size,
         TIMESTAMP '2020-01-01 00:00:00' + to_hours(CAST(doc_id % 1000000 AS INTEGER)) AS ctime, lang, source, doc_id,
         md5(CAST(doc_id AS VARCHAR)) AS digest, {CLEAN_TEXT} AS description,
         md5('urn:uuid:' || md5(CAST(doc_id AS VARCHAR)) || CASE lang WHEN 'en' THEN '978' || doc_id
           WHEN 'de' THEN 'B' || doc_id WHEN 'fr' THEN 'second' ELSE '' END) AS identifier,
         {_COVER} AS cover_url
  FROM documents)"""


@QUERIES.add("""
SELECT source, count(*) AS texts, CAST(sum(strlen(text) + 1) AS BIGINT) AS size
FROM documents GROUP BY source""")
def scan_library(spark, d):
    """Texts written to a folder per source beside other files, then listed; a text file per document."""
    folder = shared_folder(spark, "library")
    docs = v.table(spark, d, "documents")
    texts.write_texts(v.spread(docs.select("source", "text")), f"{folder}/shelf/texts", "source")
    docs.select("source", "doc_id").write.partitionBy("source").json(f"{folder}/shelf/other")
    found = library.scan_library(spark, folder, "*.txt")
    return found.groupBy(F.regexp_extract("path", "/source=([^/]*)/", 1).alias("source")).agg(
        F.count("*").alias("texts"), F.sum("size").alias("size"))


_FILES = "files AS (SELECT '/library/' || doc_id || '.epub' AS path, n_chars AS size FROM documents)"


@QUERIES.add(query(_FILES, body="""
SELECT * FROM files WHERE path NOT IN (SELECT '/library/' || doc_id || '.epub' FROM labels)"""))
def new_files(spark, d):
    def path(table):
        return v.table(spark, d, table).withColumn(
            "path", F.concat(F.lit("/library/"), "doc_id", F.lit(".epub")))

    return ingest.new_files(path("documents").select("path", F.col("n_chars").alias("size")), path("labels"))


@QUERIES.add(query(BOOK_FILES, body="""
SELECT path, CASE WHEN source = 'src7' THEN 'BadZipFile: File is not a zip file' END AS error,
       CASE WHEN source <> 'src7' THEN digest END AS cover FROM books"""))
def read_packages(spark, d):
    return library.read_packages(v.epub_files(spark, d)).select(
        "path", "error", F.decode("cover_bytes", "UTF-8").alias("cover"))


METADATA_SQL = """
SELECT path, size, ctime, CASE WHEN source = 'src1' THEN 'book.' || doc_id ELSE 'Title ' || doc_id END
         AS title, lang AS language, cover_url,
       CASE WHEN lang = 'fr' THEN 'second' ELSE digest END AS uuid,
       CASE WHEN lang = 'en' THEN '978' || doc_id ELSE '' END AS isbn,
       CASE WHEN lang = 'de' THEN 'B' || doc_id ELSE '' END AS asin, identifier,
       CASE WHEN source = 'src2' THEN '' ELSE 'Author ' || source END AS author,
       source AS publisher, description, lang || ',' || source AS tags, source AS series,
       CAST(doc_id AS VARCHAR) AS series_index,
       CASE WHEN source = 'src3' THEN '1970-01-01' ELSE '2001-' || lang END AS publish_date
FROM books"""


@QUERIES.add(query(BOOK_FILES, body=METADATA_SQL))
def book_metadata(spark, d):
    found = ingest.book_metadata(v.packages(spark, d))
    return found.withColumn("tags", F.array_join("tags", ",")).drop(
        "utime", "rating", "count_visit", "count_download", "cover_key", "bucket")


@QUERIES.add(query(BOOK_FILES, body=METADATA_SQL.replace("SELECT path, size, ctime,", "SELECT path,")
                   + " WHERE source <> 'src7'"))
def ingest_files(spark, d):
    """Container files opened and turned into catalogue rows; broken ones are left out."""
    found = ingest.book_metadata(library.read_packages(v.epub_files(spark, d)))
    return found.withColumn("tags", F.array_join("tags", ",")).drop(
        "size", "ctime", "utime", "rating", "count_visit", "count_download", "cover_key", "bucket")


@QUERIES.add(query(BOOK_FILES, body="""
SELECT path, CASE WHEN source = 'src1' THEN 'book.' || doc_id ELSE 'Title ' || doc_id END AS title,
       CASE WHEN source = 'src2' THEN 'book.' || doc_id WHEN source = 'src1' THEN NULL
            ELSE 'Title ' || doc_id END AS legacy_title
FROM books"""))
def book_title(spark, d):
    opened = ingest.unpack_packages(v.packages(spark, d))
    both = ingest.book_title(ingest.book_title(opened, legacy=True).withColumnRenamed(
        "title", "legacy_title"))
    return both.select("path", "title", "legacy_title")


@QUERIES.add(query(BOOK_FILES, body="SELECT path, identifier FROM books"))
def content_identifier(spark, d):
    return ingest.content_identifier(ingest.unpack_packages(v.packages(spark, d))).select(
        "path", "identifier")


@QUERIES.add(query(BOOK_FILES, body="""
SELECT path, CASE WHEN lang = 'fr' THEN 'second' ELSE digest END AS uuid,
       CASE WHEN lang = 'en' THEN '978' || doc_id ELSE '' END AS isbn,
       CASE WHEN lang = 'de' THEN 'B' || doc_id ELSE '' END AS asin FROM books"""))
def route_identifiers(spark, d):
    return ingest.route_identifiers(ingest.unpack_packages(v.packages(spark, d))).select(
        "path", "uuid", "isbn", "asin")


@QUERIES.add(query(BOOK_FILES, body="""
SELECT path, source AS series, CAST(doc_id AS VARCHAR) AS series_index FROM books"""))
def pivot_meta(spark, d):
    return ingest.pivot_meta(ingest.unpack_packages(v.packages(spark, d))).select(
        "path", "series", "series_index")


@QUERIES.add(query(BOOK_FILES, body="""
SELECT path, cover_url, identifier || replace(cover_url, '/', '-') AS cover_key,
       left(identifier, 1) AS bucket FROM books"""))
def select_cover(spark, d):
    opened = ingest.content_identifier(ingest.unpack_packages(v.packages(spark, d)))
    return ingest.select_cover(opened).select("path", "cover_url", "cover_key", "bucket")


@QUERIES.add(query(BOOK_FILES, body="SELECT path, unnest([lang, source]) AS tag FROM books"))
def book_tags(spark, d):
    return ingest.book_tags(ingest.book_metadata(v.packages(spark, d)), key="path")


@QUERIES.add("""
WITH copies AS (SELECT md5(text) AS identifier, doc_id, source FROM documents),
firsts AS (SELECT identifier, min(doc_id) AS id, arg_min(source, doc_id) AS source
           FROM copies GROUP BY identifier),
existing AS (SELECT md5(text) AS identifier, min(item_id) AS id FROM benchmark GROUP BY 1)
SELECT identifier, id, 'benchmark' AS source FROM existing
UNION ALL
SELECT identifier, id, source FROM firsts WHERE identifier NOT IN (SELECT identifier FROM existing)""")
def insert_new_books(spark, d):
    """Documents into a catalogue of benchmark passages; exact copies share an identifier."""
    existing = v.table(spark, d, "benchmark").groupBy(F.md5("text").alias("identifier")).agg(
        F.min("item_id").alias("id")).withColumn("source", F.lit("benchmark"))
    incoming = v.table(spark, d, "documents").select(
        F.md5("text").alias("identifier"), F.col("doc_id").alias("id"), "source")
    return ingest.insert_new(existing, incoming, order=["id"])


@QUERIES.add(QUERIES["insert_new_books"].sql)
def insert_new_filtered(spark, d):
    """The same insert with a Bloom filter of the passages beside the catalogue."""
    existing = v.table(spark, d, "benchmark").groupBy(F.md5("text").alias("identifier")).agg(
        F.min("item_id").alias("id")).withColumn("source", F.lit("benchmark"))
    incoming = v.table(spark, d, "documents").select(
        F.md5("text").alias("identifier"), F.col("doc_id").alias("id"), "source")
    path = shared_folder(spark, "known-keys")
    known_keys.add_keys(existing, path, 0)
    return known_keys.insert_new_filtered(existing, incoming, path, order=["id"])


_STORED = BOOK_FILES + """,
stored AS (
  SELECT left(identifier, 1) AS bucket, identifier || replace(cover_url, '/', '-') AS key,
         CAST(32 AS BIGINT) AS size, ctime AS last_modified, digest AS data FROM books)"""


def _written_covers(spark, d):
    folder = shared_folder(spark, "covers")
    covers.write_covers(ingest.covers_of(v.packages(spark, d), f"{folder}-books"), folder)
    return folder


@QUERIES.add(query(_STORED, body="SELECT * FROM stored"))
def covers_round_trip(spark, d):
    """Covers written by bucket and read back by key."""
    folder = _written_covers(spark, d)
    keys = spark.read.parquet(f"{folder}-books").select(F.col("cover_key").alias("key"))
    return covers.read_covers(spark, folder, keys).withColumn("data", F.decode("data", "UTF-8"))


@QUERIES.add(query(_STORED, body="SELECT DISTINCT bucket FROM stored"))
def list_buckets(spark, d):
    return covers.list_buckets(covers.read_covers(spark, _written_covers(spark, d)))


_TITLE = "regexp_extract(html, '(?is)<title[^>]*>([^<]*)</title>', 1)"
for _entity, _char in ingest.ENTITIES:
    _TITLE = f"replace({_TITLE}, '{_entity}', chr({ord(_char)}))"
_LANG = " || ".join(
    f"regexp_extract(html, '(?i)<html\\s(?:[^>]*?\\s)?lang\\s*=\\s*(?:{_form})', 1)" for _form in (
        '"([^"]*)"', "''([^'']*)''", "([^\\s\"''>]+)"))


@QUERIES.add(f"""
SELECT page_id, url, {_TITLE} AS title, {_LANG} AS language,
       CAST(len(regexp_extract_all(html, '(?i)<a\\s[^>]*href=')) AS BIGINT) AS links,
       CAST(len(regexp_extract_all(html, '(?i)<h[1-6][\\s>]')) AS BIGINT) AS headings
FROM pages""")
def markup_metadata(spark, d):
    return ingest.markup_metadata(v.table(spark, d, "pages"))


@QUERIES.add(query(SCANNED, body="""
SELECT count(*) AS scan_count, count(*) FILTER (WHERE error IS NULL) AS epub_count,
       count(error) AS failed, CAST(sum(size) AS BIGINT) AS disk_usage,
       (SELECT count(*) FROM part) AS total FROM scanned"""))
def scan_report(spark, d):
    return status.scan_report(v.scanned_files(spark, d), v.books(spark, d))


@QUERIES.add(query(SCANNED, body="""
SELECT path, '文件：' || path || ' 解析失败：' || error AS message FROM scanned WHERE error IS NOT NULL"""))
def scan_errors(spark, d):
    return status.scan_errors(v.scanned_files(spark, d))


_TICKS = """
SELECT tick, n, CAST(sum(n) OVER (ORDER BY tick) AS BIGINT) AS scan_count, new_errors FROM (
  SELECT time_bucket(INTERVAL '{every}', ts, TIMESTAMP '1970-01-01') + INTERVAL '{every}' AS tick,
         count(*) AS n, count(*) FILTER (WHERE NOT ok) AS new_errors FROM scanned GROUP BY 1)"""


@QUERIES.add(query(SCANNED, body=_TICKS.format(every="1 second")))
def status_ticks(spark, d):
    return status.status_ticks(v.scanned_files(spark, d))


@QUERIES.add(query(SCANNED, body=_TICKS.format(every="6 hours")))
def status_ticks_six_hours(spark, d):
    return status.status_ticks(v.scanned_files(spark, d), "6 hours")


@QUERIES.add(query(SCANNED, body="""
SELECT date_trunc('second', ts) + INTERVAL 1 SECOND AS tick, path, error FROM scanned WHERE NOT ok"""))
def tick_errors(spark, d):
    return status.tick_errors(v.scanned_files(spark, d))
