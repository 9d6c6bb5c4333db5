"""Streaming queries over the given tables, run over everything that has arrived."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.plans import people
from lectern.plans import views as v
from lectern.plans.intake import BOOK_FILES, METADATA_SQL
from lectern.plans.query import QuerySet
from lectern.plans.reading import progress_sql
from lectern.plans.sql_views import SCANNED, query
from lectern.plans.talk import ASSEMBLED
from lectern.session import shared_folder
from lectern.streaming import ingest, progress, replies, sessions, status
from lectern.streaming.runs import read_table_stream, run_available, set_stream_settings

QUERIES = QuerySet()

# the stream's clock stops ten minutes before the last event
_CLOCK = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"


@QUERIES.add(query(SCANNED, body=f"""
SELECT * FROM (
  SELECT date_trunc('hour', ts) AS tick_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS tick,
         count(*) AS n, count(*) FILTER (WHERE NOT ok) AS new_errors FROM scanned GROUP BY 1, 2)
WHERE tick <= {_CLOCK}"""))
def status_tick_stream(spark, d):
    events = v.scanned_files(spark, d, read_table_stream(spark, d, "events"))
    return run_available(status.status_tick_stream(events, "1 hour", "10 minutes"), "ticks")


@QUERIES.add(query(people.SESSIONS_SQL.format(gap=1800), body=f"""
SELECT user_id, session_start, last_seen, events FROM sessions
WHERE last_seen + INTERVAL 1801 SECOND <= {_CLOCK}"""))
def session_stream(spark, d):
    set_stream_settings(spark)
    events = read_table_stream(spark, d, "events")
    return run_available(sessions.session_stream(events, 1800, "10 minutes"), "sessions")


@QUERIES.add(query(people.LAZY_SQL.format(gap=1800, refresh=60), body=f"""
SELECT * EXCLUDE (session_no) FROM ({people.LAZY_BODY})
WHERE refreshed_at + INTERVAL 1801 SECOND <= {_CLOCK}"""))
def lazy_session_stream(spark, d):
    set_stream_settings(spark)
    events = read_table_stream(spark, d, "events")
    return run_available(sessions.lazy_session_stream(events, 1800, 60, "10 minutes"), "lazy")


# frames come a second apart, the clock stops a minute before the last one
_REPLY_TIMES = """replied AS (
  SELECT request_id, (request_id % 1000000) * 60 + len(lines) AS last_s,
         (request_id % 1000000) * 60 + len(lines) + CASE WHEN broken THEN 1 ELSE 0 END AS any_s
  FROM replies)"""


@QUERIES.add(f"""
WITH {ASSEMBLED.removeprefix("WITH ").rpartition("SELECT request_id, array_to_string")[0].rstrip()},
{_REPLY_TIMES}
SELECT a.* FROM ({ASSEMBLED}) a JOIN replied r ON r.request_id = a.request_id
WHERE ended OR last_s + 600 < (SELECT max(any_s) - 60 FROM replied)""")
def reply_stream(spark, d):
    """Replies as they end; those without an ending frame come after ten silent minutes, if those are over."""
    set_stream_settings(spark)
    frames = v.frames(spark, d, read_table_stream(spark, d, "conversations"))
    return run_available(replies.reply_stream(frames, 600, "1 minute"), "replies")


@QUERIES.add(progress_sql())
def progress_stream(spark, d):
    path = shared_folder(spark, "progress")
    events = v.progress_events(spark, d, events=read_table_stream(spark, d, "events"))
    progress.progress_stream(events, path, f"{path}-checkpoint").awaitTermination()
    progress.compact_progress(spark, path)
    return progress.read_progress(spark, path)


@QUERIES.add(query(BOOK_FILES, body=METADATA_SQL.replace("SELECT path, size, ctime,", "SELECT path,")
                   + " WHERE source <> 'src7'"))
def ingest_batches(spark, d):
    """The step of the ingest stream, run twice on the same files: the second run adds nothing."""
    sink = shared_folder(spark, "library")
    made = v.epub_files(spark, d)
    made.write.parquet(f"{sink}/files")
    files = spark.read.schema(made.schema).parquet(f"{sink}/files")
    ingest.ingest_batch(files, sink, 0)
    ingest.ingest_batch(files, sink, 1)
    found = spark.read.parquet(f"{sink}/books")
    return found.withColumn("tags", F.array_join("tags", ",")).drop(
        "batch", "size", "ctime", "utime", "rating", "count_visit", "count_download", "cover_key",
        "bucket")
