"""Catalogue queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import book_index, catalog
from lectern.operators import live_stats as live_stats_of
from lectern.plans import views as v
from lectern.plans.query import QuerySet
from lectern.plans.sql_views import BOOKS, query
from lectern.session import shared_folder
from lectern.sources.feed import write_feed

QUERIES = QuerySet()


@QUERIES.add(query(BOOKS, body="""
SELECT id, title, author, category FROM books
WHERE contains(lower(title), 'ring') OR contains(lower(author), 'ring')
ORDER BY id LIMIT 20 OFFSET 40"""))
def search_books(spark, d):
    return catalog.search_books(v.books(spark, d), q="RING", page_size=20, page_num=2).select(
        "id", "title", "author", "category")


@QUERIES.add(query(BOOKS, body="""
SELECT id, title, author, category FROM books
WHERE (contains(title, 'bolt') OR contains(author, 'bolt')) AND category = 'SMALL'
  AND author = 'Brand#4' ORDER BY id LIMIT 50"""))
def search_books_filtered(spark, d):
    return catalog.search_books(
        v.books(spark, d), q="bolt", category="SMALL", author="Brand#4", page_size=50, ci=False,
    ).select("id", "title", "author", "category")


@QUERIES.add(query(BOOKS, body="""
SELECT id, title FROM books WHERE lower(title) LIKE '%b_lt%' OR lower(author) LIKE '%b_lt%'
ORDER BY id LIMIT 30"""))
def search_books_wildcards(spark, d):
    return catalog.search_books(
        v.books(spark, d), q="B_lt", page_size=30, wildcards=True).select("id", "title")


@QUERIES.add(query(BOOKS, body="""
SELECT id, title, author, category FROM books
WHERE contains(lower(title), 'll ri') OR contains(lower(author), 'll ri')
ORDER BY id LIMIT 20 OFFSET 20"""))
def search_indexed(spark, d):
    books = v.books(spark, d)
    path = shared_folder(spark, "book-index")
    book_index.add_books(books, path)
    return book_index.search_indexed(books, path, q="LL RI", page_size=20, page_num=1).select(
        "id", "title", "author", "category")


@QUERIES.add(query(BOOKS, body="""
SELECT id, title FROM books WHERE lower(title) LIKE '%all b_lt%' OR lower(author) LIKE '%all b_lt%'
ORDER BY id LIMIT 30"""))
def search_indexed_wildcards(spark, d):
    books = v.books(spark, d)
    path = shared_folder(spark, "book-index")
    book_index.add_books(books, path)
    return book_index.search_indexed(
        books, path, q="all B_lt", page_size=30, wildcards=True).select("id", "title")


@QUERIES.add(query(BOOKS, body="""
SELECT count(*) AS total FROM books
WHERE contains(lower(title), 'ring') OR contains(lower(author), 'ring')"""))
def search_total(spark, d):
    return catalog.search_total(v.books(spark, d), q="ring")


@QUERIES.add(query(BOOKS, body="""
SELECT event_id AS request_id, event_id AS book_id, title, author, id IS NOT NULL AS found
FROM events LEFT JOIN books ON id = event_id"""))
def lookup_books(spark, d):
    requests = v.table(spark, d, "events").select(
        F.col("event_id").alias("request_id"), F.col("event_id").alias("book_id"))
    return catalog.lookup_books(requests, v.books(spark, d).select("id", "title", "author"))


@QUERIES.add(query(BOOKS, body="""
SELECT count(*) AS total, count(DISTINCT author) AS author, count(DISTINCT publisher) AS publisher,
       (SELECT count(DISTINCT tag) FROM (SELECT unnest([lang, source]) AS tag FROM documents)) AS tag
FROM books"""))
def book_stats(spark, d):
    return catalog.book_stats(v.books(spark, d, details=True), v.book_tags(spark, d))


@QUERIES.add(query(BOOKS, body="""
SELECT count(*) AS total, true AS author_near, true AS publisher_near, true AS tag_near FROM books"""))
def live_stats(spark, d):
    """Sketches of two batches united; the estimates lie within three standard errors of the counts."""
    books, tags = v.books(spark, d, details=True), v.book_tags(spark, d)
    path = shared_folder(spark, "stats")
    small_parts = F.col("category") == "SMALL"
    live_stats_of.add_batch(books.filter(small_parts), tags, path, 0)
    live_stats_of.add_batch(books.filter(~small_parts), None, path, 1)
    exact = catalog.book_stats(books, tags)
    most = 3 * 1.04 / 2 ** (live_stats_of.PRECISION / 2)
    found = live_stats_of.live_stats(spark, path)
    return found.select("total", *[(F.abs(F.col(c) - exact.select(c).scalar()) <= F.ceil(
        exact.select(c).scalar() * most)).alias(f"{c}_near") for c in ("author", "publisher", "tag")])


@QUERIES.add(query(BOOKS, body="SELECT count(*) AS total FROM books"))
def count_books(spark, d):
    return catalog.count_books(v.books(spark, d))


@QUERIES.add(query(BOOKS, body="""
SELECT id, title, ctime, count_visit FROM books WHERE count_visit = 0
ORDER BY ctime DESC, id LIMIT 10"""))
def recent_books(spark, d):
    return catalog.recent_books(v.books(spark, d, counts=True), 0).select(
        "id", "title", "ctime", "count_visit")


@QUERIES.add(query(BOOKS, body="""
SELECT id, title, ctime FROM books
WHERE count_visit = 0 AND id NOT IN (SELECT o_custkey FROM orders) ORDER BY ctime DESC, id LIMIT 25"""))
def recent_books_omit(spark, d):
    omit = v.table(spark, d, "orders").select("o_custkey")
    return catalog.recent_books(v.books(spark, d, counts=True), 25, omit).select("id", "title", "ctime")


@QUERIES.add(query(BOOKS, body="""
SELECT id, title FROM books WHERE id NOT IN (1, 2, 3) ORDER BY md5(id || ':7'), id LIMIT 10"""))
def random_books(spark, d):
    return catalog.random_books(v.books(spark, d), 10, [1, 2, 3], seed=7).select("id", "title")


@QUERIES.add(query(BOOKS, body="""
(SELECT id, title, 'random' AS section FROM books ORDER BY md5(id || ':7'), id LIMIT 10)
UNION ALL
(SELECT id, title, 'recent' AS section FROM books WHERE count_visit = 0 ORDER BY ctime DESC, id LIMIT 12)"""))
def home_feed(spark, d):
    return catalog.home_feed(v.books(spark, d, counts=True), seed=7).select("id", "title", "section")


@QUERIES.add(query(BOOKS, body="""
SELECT id, title, author, category, ctime, nullif(language, '') AS sub_title,
       nullif(publisher, '') AS description, size, '1970-01-01' AS pubdate FROM books"""))
def public_view(spark, d):
    books = v.books(spark, d, details=True).withColumnsRenamed(
        {"language": "sub_title", "publisher": "description"})
    return catalog.public_view(books.withColumn("publish_date", F.lit("1970-01-01")))


@QUERIES.add(query(BOOKS, body="""
SELECT id, '{"code":200,"message":"sucesss","data":{"id":' || id || ',"title":' || to_json(title)
  || CASE WHEN language = '' THEN '' ELSE ',"description":' || to_json(language) END || '}}' AS body
FROM books"""))
def reply_envelope(spark, d):
    books = v.books(spark, d, details=True).select(
        "id", "title", F.col("language").alias("description"))
    return catalog.to_envelope(catalog.public_view(books), key=["id"])


def _entries(spark, d):
    books = v.books(spark, d, details=True).withColumnsRenamed(
        {"ctime": "utime", "language": "description", "publisher": "cover_url"})
    return catalog.feed_entries(books, "http://lib/")


@QUERIES.add(query(BOOKS, body="""
SELECT CAST(id AS VARCHAR) AS id, strftime(ctime, '%Y-%m-%dT%H:%M:%SZ') AS updated, title,
       author AS author_name, language AS summary,
       'http://lib/books/' || id || '/download' AS book_href,
       CASE WHEN publisher <> '' THEN 'http://lib/covers/' || publisher END AS cover_href,
       CAST(CASE WHEN publisher <> '' THEN 2 ELSE 1 END AS INTEGER) AS links
FROM books"""))
def feed_entries(spark, d):
    return _entries(spark, d).select(
        "id", "updated", "title", F.col("author.name").alias("author_name"),
        F.col("summary._VALUE").alias("summary"),
        F.get("link", F.lit(0))["_href"].alias("book_href"),
        F.get("link", F.lit(1))["_href"].alias("cover_href"), F.size("link").alias("links"))


@QUERIES.add(query(BOOKS, body="""
SELECT CAST(id AS VARCHAR) AS id, title, author AS author_name,
       CAST(CASE WHEN publisher <> '' THEN 2 ELSE 1 END AS INTEGER) AS links
FROM books"""))
def feed_documents(spark, d):
    """Feed documents written and read back."""
    folder = shared_folder(spark, "feed")
    write_feed(_entries(spark, d), folder, "urn:lib", "Books", "http://lib/opds")
    entries = spark.read.format("xml").option("rowTag", "entry").schema(
        "id string, title string, author struct<name:string>, link array<struct<_href:string>>").load(folder)
    return entries.select("id", "title", F.col("author.name").alias("author_name"),
                          F.size("link").alias("links"))
