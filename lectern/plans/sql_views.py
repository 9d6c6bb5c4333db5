"""The same domain tables as SQL, for the check."""

from __future__ import annotations

EVENT_ITEMS = """items AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""

BOOKS = EVENT_ITEMS + """,
seen AS (
  SELECT k, count(*) FILTER (WHERE event_type = 'view') AS views,
         count(*) FILTER (WHERE event_type = 'purchase') AS sales
  FROM items WHERE event_type IN ('view', 'purchase') GROUP BY k),
books AS (
  SELECT p_partkey AS id, p_name AS title, p_brand AS author, p_type AS category,
         TIMESTAMP '2020-01-01 00:00:00' + to_hours(CAST(p_partkey % 1000000 AS INTEGER)) AS ctime,
         '/library/' || p_type || '/' || p_partkey || '.epub' AS path,
         coalesce(lang, '') AS language, coalesce(source, '') AS publisher,
         coalesce(n_chars, 0) AS size, coalesce(views, 0) AS count_visit,
         coalesce(sales, 0) AS count_download
  FROM part LEFT JOIN documents ON doc_id = p_partkey LEFT JOIN seen ON k = p_partkey)"""

PROGRESS = """progress_events AS (
  SELECT event_id, ts, k AS book_id, user_id, value / 500 AS progress,
         event_id % 30 AS progress_index, event_id % 100 AS para_position, event_type
  FROM items WHERE event_type IN ('view', 'click')),
valid_events AS (SELECT * FROM progress_events WHERE book_id <> 0 AND user_id <> 0),
progress_table AS (
  SELECT book_id, user_id, min(ts) AS start_date, max(ts) AS updated_at,
         min(ts) + INTERVAL 15 DAY AS expt_end_date, CAST(NULL AS TIMESTAMP) AS end_date,
         arg_max(progress, (ts, event_id)) AS progress,
         arg_max(progress_index, (ts, event_id)) AS progress_index,
         arg_max(para_position, (ts, event_id)) AS para_position
  FROM valid_events GROUP BY book_id, user_id)"""

FAVS = """favs AS (
  SELECT k AS book_id, user_id, min(ts) AS created_at, max(ts) AS updated_at
  FROM items WHERE event_type = 'purchase' GROUP BY k, user_id)"""

USERS = """users AS (
  SELECT c_custkey AS id, c_name AS user_name, c_name || '@x.org' AS email,
         '555' || c_nationkey AS mobile,
         CAST(CASE WHEN c_custkey % 100 = 1 THEN 1 ELSE 2 END AS BIGINT) AS role_id,
         md5(c_name) AS credential, c_mktsegment AS segment
  FROM customer)"""

TOKENS = """tokens AS (
  SELECT o_orderkey AS id, o_custkey AS user_id, md5(CAST(o_orderkey AS VARCHAR)) AS api_key
  FROM orders)"""

SCANNED = """scanned AS (
  SELECT event_id, ts, '/library/' || event_id || '.epub' AS path, CAST(floor(value) AS BIGINT) AS size,
         event_type <> 'error' AS ok,
         CASE WHEN event_type = 'error'
              THEN 'bad item ' || json_extract_string(props, '$.k') END AS error
  FROM events)"""

MESSAGES = "messages AS (SELECT conv_id, turn, role, text AS content FROM conversations)"

REPLIES = """replies AS (
  SELECT conv_id, turn, text, string_split(text, chr(10)) AS lines,
         conv_id * 100 + turn AS request_id, conv_id % 2 = 0 AS nul, turn = 3 AS broken
  FROM conversations WHERE role = 'assistant')"""

CLEAN_TEXT = r"regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]', '', 'g')"

SPEAKERS = """speakers AS (
  SELECT 'voice_' || s_suppkey AS audio_id, CAST(s_nationkey AS INTEGER) AS gender, 1 AS default_type,
         s_name AS display_name, '' AS description, '' AS avatar_url, s_name || '.wav' AS path
  FROM supplier)"""


def query(*views: str, body: str) -> str:
    return "WITH " + ",\n".join(views) + "\n" + body.strip()
