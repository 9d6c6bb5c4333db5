"""Reading state queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import progress
from lectern.plans import views as v
from lectern.plans.query import QuerySet
from lectern.plans.sql_views import BOOKS, FAVS, PROGRESS, query
from lectern.session import shared_folder

QUERIES = QuerySet()

# progress rows of one event type
_OF_TYPE = """{name} AS (
  SELECT book_id, user_id, min(ts) AS first_ts, max(ts) AS last_ts,
         arg_max(progress, (ts, event_id)) AS progress,
         arg_max(progress_index, (ts, event_id)) AS progress_index,
         arg_max(para_position, (ts, event_id)) AS para_position
  FROM valid_events WHERE event_type = '{kind}' GROUP BY book_id, user_id)"""
_VIEWED = _OF_TYPE.format(name="viewed", kind="view")
_CLICKED = _OF_TYPE.format(name="clicked", kind="click")


def _progress(spark, d, *types):
    return progress.upsert_progress(None, v.progress_events(spark, d, *types))


@QUERIES.add(query(BOOKS, PROGRESS, body="""
SELECT *, book_id <> 0 AND user_id <> 0 AS valid FROM (
  SELECT event_id, ts, book_id, user_id, progress, progress_index, para_position FROM progress_events)"""))
def valid_progress(spark, d):
    good, bad = progress.valid_progress(v.progress_events(spark, d))
    return good.withColumn("valid", F.lit(True)).unionByName(
        bad.drop("reason").withColumn("valid", F.lit(False)))


def progress_sql():
    return query(BOOKS, PROGRESS, body="SELECT * FROM progress_table")


@QUERIES.add(progress_sql())
def upsert_progress_first(spark, d):
    return _progress(spark, d)


@QUERIES.add(query(BOOKS, PROGRESS, _VIEWED, _CLICKED, body="""
SELECT coalesce(v.book_id, c.book_id) AS book_id, coalesce(v.user_id, c.user_id) AS user_id,
       coalesce(v.first_ts, c.first_ts) AS start_date, coalesce(c.last_ts, v.last_ts) AS updated_at,
       coalesce(v.first_ts, c.first_ts) + INTERVAL 15 DAY AS expt_end_date,
       CAST(NULL AS TIMESTAMP) AS end_date, coalesce(c.progress, v.progress) AS progress,
       coalesce(c.progress_index, v.progress_index) AS progress_index,
       coalesce(c.para_position, v.para_position) AS para_position
FROM viewed v FULL JOIN clicked c ON v.book_id = c.book_id AND v.user_id = c.user_id"""))
def upsert_progress(spark, d):
    return progress.upsert_progress(_progress(spark, d, "view"), v.progress_events(spark, d, "click"))


@QUERIES.add(query(BOOKS, PROGRESS, _VIEWED, _CLICKED, body="""
SELECT v.book_id, v.user_id, v.first_ts AS start_date, coalesce(c.last_ts, v.last_ts) AS updated_at,
       coalesce(c.progress, v.progress) AS progress,
       coalesce(c.progress_index, v.progress_index) AS progress_index,
       coalesce(c.para_position, v.para_position) AS para_position
FROM viewed v LEFT JOIN clicked c ON v.book_id = c.book_id AND v.user_id = c.user_id"""))
def update_progress(spark, d):
    return progress.update_progress(
        _progress(spark, d, "view"), v.progress_events(spark, d, "click")
    ).drop("expt_end_date", "end_date")


@QUERIES.add(query(BOOKS, FAVS, body="SELECT * FROM favs"))
def upsert_favs(spark, d):
    return progress.upsert_favs(v.fav_events(spark, d))


@QUERIES.add(query(BOOKS, PROGRESS, FAVS, body="""
SELECT f.book_id, f.user_id, p.progress, p.updated_at, p.book_id IS NOT NULL AS found
FROM favs f LEFT JOIN progress_table p ON p.book_id = f.book_id AND p.user_id = f.user_id"""))
def lookup_progress(spark, d):
    favs = progress.upsert_favs(v.fav_events(spark, d)).select("book_id", "user_id")
    return progress.lookup_progress(
        favs, _progress(spark, d).select("book_id", "user_id", "progress", "updated_at"))


@QUERIES.add(query(BOOKS, PROGRESS, body="""
SELECT id, title, updated_at, progress, progress_index, para_position FROM books JOIN (
  SELECT * FROM progress_table WHERE user_id = 7 ORDER BY updated_at DESC, book_id LIMIT 10 OFFSET 5
) ON book_id = id"""))
def reading_books(spark, d):
    return progress.reading_books(v.books(spark, d), _progress(spark, d), 7, 10, 5).select(
        "id", "title", "updated_at", "progress", "progress_index", "para_position")


@QUERIES.add(query(BOOKS, PROGRESS, FAVS, body="""
SELECT id, title, f.updated_at AS liked_at, progress, progress_index
FROM favs f JOIN books ON id = f.book_id
LEFT JOIN progress_table p ON p.book_id = f.book_id AND p.user_id = 7
WHERE f.user_id = 7 ORDER BY f.updated_at DESC, id LIMIT 10"""))
def liked_books(spark, d):
    return progress.liked_books(
        v.books(spark, d), progress.upsert_favs(v.fav_events(spark, d)), _progress(spark, d), 7,
    ).select("id", "title", "liked_at", "progress", "progress_index")


@QUERIES.add(query(BOOKS, PROGRESS, body="""
SELECT id, title, updated_at, progress, progress_index, para_position FROM books JOIN (
  SELECT * FROM progress_table WHERE user_id = 7 ORDER BY updated_at DESC, book_id LIMIT 10 OFFSET 5
) ON book_id = id"""))
def reading_page(spark, d):
    path = shared_folder(spark, "reading-pages")
    progress.write_reading_pages(_progress(spark, d), path)
    return progress.reading_page(v.books(spark, d), path, 7, 10, 5).select(
        "id", "title", "updated_at", "progress", "progress_index", "para_position")


@QUERIES.add(query(BOOKS, PROGRESS, FAVS, body="""
SELECT id, title, f.updated_at AS liked_at, progress, progress_index
FROM favs f JOIN books ON id = f.book_id
LEFT JOIN progress_table p ON p.book_id = f.book_id AND p.user_id = 7
WHERE f.user_id = 7 ORDER BY f.updated_at DESC, id LIMIT 3 OFFSET 2"""))
def liked_page(spark, d):
    path, books = shared_folder(spark, "liked-pages"), v.books(spark, d)
    progress.write_liked_pages(books, progress.upsert_favs(v.fav_events(spark, d)), path)
    return progress.liked_page(books, path, _progress(spark, d), 7, 3, 2).select(
        "id", "title", "liked_at", "progress", "progress_index")


@QUERIES.add(query(BOOKS, PROGRESS, FAVS, """reading AS (
  SELECT user_id, book_id, updated_at AS shelved_at, row_number() OVER (
    PARTITION BY user_id ORDER BY updated_at DESC, book_id) AS position FROM progress_table),
liked AS (
  SELECT user_id, book_id, updated_at AS shelved_at, row_number() OVER (
    PARTITION BY user_id ORDER BY updated_at DESC, book_id) AS position
  FROM favs WHERE book_id IN (SELECT id FROM books)),
shelves AS (
  SELECT *, 'reading' AS shelf FROM reading WHERE position <= 20
  UNION ALL SELECT *, 'liked' AS shelf FROM liked WHERE position <= 20)""", body="""
SELECT s.user_id, shelf, CAST(position AS INTEGER) AS position, s.book_id, title, author, shelved_at,
       progress, progress_index, para_position
FROM shelves s JOIN books ON id = s.book_id
LEFT JOIN progress_table p ON p.book_id = s.book_id AND p.user_id = s.user_id"""))
def all_shelves(spark, d):
    return progress.all_shelves(
        v.books(spark, d), progress.upsert_favs(v.fav_events(spark, d)), _progress(spark, d))
