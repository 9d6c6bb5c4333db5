"""Account and session queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import accounts, ingest, sessions
from lectern.plans import views as v
from lectern.plans.query import QuerySet
from lectern.plans.sql_views import TOKENS, USERS, query

QUERIES = QuerySet()


@QUERIES.add(query(USERS, """requests AS (
  SELECT o_orderkey AS request_id, CASE
    WHEN o_orderpriority = '5-LOW' THEN ''
    WHEN o_orderstatus = 'F' THEN 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0')
    WHEN o_orderstatus = 'O' THEN 'Customer#' || lpad(CAST(o_custkey * 2 AS VARCHAR), 9, '0') || '@x.org'
    ELSE '555' || (o_custkey % 40) END AS account
  FROM orders)""", """names AS (
  SELECT email AS a, id FROM users UNION ALL SELECT mobile, id FROM users
  UNION ALL SELECT user_name, id FROM users)""", body="""
SELECT request_id, account, user_id,
       CASE WHEN account = '' THEN 'empty account' WHEN user_id IS NULL THEN 'not found' END AS error
FROM requests LEFT JOIN (SELECT a, min(id) AS user_id FROM names GROUP BY a) ON a = account"""))
def resolve_accounts(spark, d):
    def name(key):
        return F.concat(F.lit("Customer#"), F.lpad(key.cast("string"), 9, "0"))

    key = F.col("o_custkey")
    requests = v.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("request_id"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit(""))
        .when(F.col("o_orderstatus") == "F", name(key))
        .when(F.col("o_orderstatus") == "O", F.concat(name(key * 2), F.lit("@x.org")))
        .otherwise(F.concat(F.lit("555"), key % 40)).alias("account"))
    return accounts.resolve_accounts(requests, v.users(spark, d))


@QUERIES.add(query(USERS, body="SELECT * REPLACE ('' AS credential) FROM users"))
def mask_users(spark, d):
    return accounts.mask_users(v.users(spark, d))


@QUERIES.add(query(USERS, TOKENS, body="""
SELECT id, user_id, api_key FROM tokens
WHERE user_id IN (SELECT id FROM users WHERE segment = 'BUILDING')"""))
def tokens_for(spark, d):
    builders = v.users(spark, d).filter(F.col("segment") == "BUILDING")
    return accounts.tokens_for(builders, v.tokens(spark, d))


@QUERIES.add(query(TOKENS, body="""
SELECT id, user_id, api_key FROM tokens WHERE id NOT IN (SELECT event_id FROM events)"""))
def delete_tokens(spark, d):
    return accounts.delete_tokens(
        v.tokens(spark, d), v.table(spark, d, "events").select(F.col("event_id").alias("id")))


@QUERIES.add(query(USERS, TOKENS, """log AS (
  SELECT event_id AS request_id, event_type = 'error' AS admin_route, CASE WHEN event_type = 'signup'
    THEN '' ELSE 'Bearer ' || md5(CAST(event_id * 2 AS VARCHAR)) END AS authorization_text
  FROM events)""", body="""
SELECT request_id, admin_route, user_id, CASE
  WHEN u.id IS NULL THEN 'unauthorized' WHEN admin_route AND role_id <> 1 THEN 'forbidden'
  ELSE 'ok' END AS outcome
FROM log LEFT JOIN tokens ON api_key = substr(authorization_text, 8)
LEFT JOIN users u ON u.id = user_id"""))
def authorize_requests(spark, d):
    return accounts.authorize_requests(
        v.access_log(spark, d), v.tokens(spark, d), v.users(spark, d)).drop("authorization")


@QUERIES.add(query(USERS, TOKENS, body="""
SELECT id AS user_id, sha1(id || 'pepper') AS api_key FROM users
WHERE id NOT IN (SELECT user_id * 2 FROM tokens)"""))
def missing_tokens(spark, d):
    # tokens of a wider range of users, so that some of the known ones lack one
    tokens = v.tokens(spark, d).withColumn("user_id", F.col("user_id") * 2)
    return accounts.missing_tokens(v.users(spark, d), tokens, "pepper")


@QUERIES.add(query(USERS, """seeds AS (
  SELECT 'Customer#' || lpad(CAST(o_custkey * 2 AS VARCHAR), 9, '0') AS user_name,
         min(o_orderkey) AS id FROM orders GROUP BY 1)""", body="""
SELECT id, user_name, 'existing' AS origin FROM users
UNION ALL
SELECT id, user_name, 'seed' AS origin FROM seeds
WHERE user_name NOT IN (SELECT user_name FROM users)"""))
def insert_new_users(spark, d):
    seeds = v.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("Customer#"), F.lpad((F.col("o_custkey") * 2).cast("string"), 9, "0"))
        .alias("user_name"), F.lit("seed").alias("origin"))
    existing = v.users(spark, d).select("id", "user_name", F.lit("existing").alias("origin"))
    return ingest.insert_new(existing, seeds, key="user_name", order=["id"])


@QUERIES.add("""
SELECT event_id, user_id, event_type, sha1('{"event_id":' || event_id || ',"user_id":' || user_id
  || ',"event_type":"' || event_type || '"}') AS session FROM events""")
def session_ids(spark, d):
    return sessions.session_ids(v.table(spark, d, "events").select("event_id", "user_id", "event_type"))


SESSIONS_SQL = """steps AS (
  SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts)
    < INTERVAL {gap} SECOND + INTERVAL 1 SECOND THEN 0 ELSE 1 END AS fresh FROM events),
numbered AS (
  SELECT user_id, ts, sum(fresh) OVER (
    PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session_no FROM steps),
sessions AS (
  SELECT user_id, CAST(session_no AS BIGINT) AS session_no, min(ts) AS session_start,
         max(ts) AS last_seen, count(*) AS events
  FROM numbered GROUP BY user_id, session_no)"""


@QUERIES.add(query(SESSIONS_SQL.format(gap=1800), body="SELECT * FROM sessions"))
def sessionize(spark, d):
    return sessions.sessionize(v.table(spark, d, "events"))


@QUERIES.add(query(SESSIONS_SQL.format(gap=21600), body="SELECT * FROM sessions"))
def sessionize_six_hours(spark, d):
    return sessions.sessionize(v.table(spark, d, "events"), gap=21600)


# the rule itself, one event after the other
LAZY_SQL = """RECURSIVE ordered AS (
  SELECT user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS rn
  FROM events),
walk AS (
  SELECT user_id, rn, us, us AS seen, CAST(1 AS BIGINT) AS session_no FROM ordered WHERE rn = 1
  UNION ALL
  SELECT o.user_id, o.rn, o.us,
         CASE WHEN (o.us - w.seen) // 1000000 > {refresh} THEN o.us ELSE w.seen END,
         w.session_no + CASE WHEN (o.us - w.seen) // 1000000 > {gap} THEN 1 ELSE 0 END
  FROM walk w JOIN ordered o ON o.user_id = w.user_id AND o.rn = w.rn + 1)"""
LAZY_BODY = """
SELECT user_id, session_no, make_timestamp(min(us)) AS session_start,
       make_timestamp(max(seen)) AS refreshed_at, make_timestamp(max(us)) AS last_seen,
       count(*) AS events FROM walk GROUP BY user_id, session_no"""


@QUERIES.add(query(LAZY_SQL.format(gap=1800, refresh=60), body=LAZY_BODY))
def sessionize_lazy(spark, d):
    return sessions.sessionize_lazy(v.table(spark, d, "events"))


@QUERIES.add(query(LAZY_SQL.format(gap=86400, refresh=36000), body=LAZY_BODY))
def sessionize_lazy_one_day(spark, d):
    return sessions.sessionize_lazy(v.table(spark, d, "events"), gap=86400, refresh=36000)


def _stored_sessions(spark, d):
    found = sessions.sessionize(v.table(spark, d, "events"))
    return found.select(
        F.sha1(F.concat_ws("-", "user_id", "session_no")).alias("session"), "user_id",
        F.col("session_start").alias("ctime"), F.col("last_seen").alias("utime"),
        F.lit(1800).cast("bigint").alias("duration"))


_STORED = SESSIONS_SQL.format(gap=1800) + """,
stored AS (
  SELECT sha1(user_id || '-' || session_no) AS session, user_id, session_start AS ctime,
         last_seen AS utime, CAST(1800 AS BIGINT) AS duration FROM sessions)"""


@QUERIES.add(query(_STORED, USERS, body="""
SELECT s.*, user_name, email, role_id, u.id IS NOT NULL AS user_found
FROM stored s LEFT JOIN users u ON u.id = s.user_id"""))
def session_users(spark, d):
    return sessions.session_users(_stored_sessions(spark, d), v.users(spark, d))


_AS_OF = "2024-01-15 12:00:00"


@QUERIES.add(query(_STORED, body=f"""
SELECT * FROM stored
WHERE (epoch_us(TIMESTAMP '{_AS_OF}') - epoch_us(utime)) // 1000000 > duration"""))
def expired_sessions(spark, d):
    return sessions.expired_sessions(_stored_sessions(spark, d), F.lit(_AS_OF).cast("timestamp"))


@QUERIES.add(query(_STORED, body=f"""
SELECT * FROM stored
WHERE NOT (epoch_us(TIMESTAMP '{_AS_OF}') - epoch_us(utime)) // 1000000 > duration"""))
def live_sessions(spark, d):
    return sessions.live_sessions(_stored_sessions(spark, d), F.lit(_AS_OF).cast("timestamp"))
