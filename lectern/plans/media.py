"""Vector and speech queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import speech, vectors
from lectern.plans import views as v
from lectern.plans.query import QuerySet
from lectern.plans.sql_views import SPEAKERS, query
from lectern.session import shared_folder
from lectern.sources import speakers as speaker_files

QUERIES = QuerySet()

DIM = 64

_POSITIONS = """positions AS (
  SELECT vec_id, label, unnest(range({dim})) AS pos, unnest(embedding) AS x FROM embeddings)""".format(dim=DIM)


@QUERIES.add(query(_POSITIONS, body="""
SELECT label, CAST(pos AS INTEGER) AS pos, count(*) AS token_num, round(avg(CAST(x AS DOUBLE)), 6) AS mean
FROM positions GROUP BY label, pos"""))
def mean_pool(spark, d):
    pooled = vectors.mean_pool(v.table(spark, d, "embeddings"), "label", "embedding", dim=DIM)
    return pooled.select("label", "token_num", F.posexplode("mean").alias("pos", "mean")).withColumn(
        "mean", F.round("mean", 6))


@QUERIES.add(query(_POSITIONS, """means AS (
  SELECT label, pos, count(*) AS token_num, avg(CAST(x AS DOUBLE)) AS mean FROM positions
  WHERE vec_id IN (SELECT vec_id FROM embeddings WHERE embedding[1] > 0) GROUP BY label, pos)""", body="""
SELECT label, CAST(pos AS INTEGER) AS pos, token_num,
       round(mean / sqrt(sum(mean * mean) OVER (PARTITION BY label)), 6) AS mean FROM means"""))
def mean_pool_masked(spark, d):
    rows = v.table(spark, d, "embeddings").withColumn(
        "mask", (F.get("embedding", F.lit(0)) > 0).cast("int"))
    pooled = vectors.l2_normalize(vectors.mean_pool(rows, "label", "embedding", mask="mask"), "mean")
    return pooled.select("label", "token_num", F.posexplode("mean").alias("pos", "mean")).withColumn(
        "mean", F.round("mean", 6))


@QUERIES.add(query(_POSITIONS, body="""
SELECT vec_id, CAST(pos AS INTEGER) AS pos,
       round(CAST(x AS DOUBLE) / sqrt(sum(CAST(x AS DOUBLE) * x) OVER (PARTITION BY vec_id)), 6) AS x
FROM positions"""))
def l2_normalize(spark, d):
    unit = vectors.l2_normalize(v.table(spark, d, "embeddings"), "embedding")
    return unit.select("vec_id", F.posexplode("embedding").alias("pos", "x")).withColumn(
        "x", F.round("x", 6))


@QUERIES.add(query(_POSITIONS, body="""
SELECT vec_id, CAST(pos AS INTEGER) AS pos, CAST(trunc(CAST(x * 32767::FLOAT AS DOUBLE)) AS SMALLINT) AS x
FROM positions"""))
def quantize_int16(spark, d):
    return vectors.quantize_int16(v.table(spark, d, "embeddings"), "embedding").select(
        "vec_id", F.posexplode("embedding").alias("pos", "x"))


# the merging rule itself, one piece after the other
_SEGMENTS = """RECURSIVE texts AS (
  SELECT doc_id, lang, replace(text, 'th', chr(64976)) AS text FROM documents),
sentences AS (
  SELECT doc_id, text, unnest(range(len(parts))) AS s_no, unnest(parts) AS s FROM (
    SELECT *, regexp_extract_all(text, '[^。！？!?.…；;]*[。！？!?.…；;]+|[^。！？!?.…；;]+') AS parts
    FROM texts WHERE length(text) >= 50)),
commas AS (
  SELECT doc_id, s_no, unnest(range(len(parts))) AS c_no, unnest(parts) AS c FROM (
    SELECT *, CASE WHEN length(s) > 50 THEN string_split(replace(s, '，', ','), ',') ELSE [s] END AS parts
    FROM sentences)),
halves AS (
  SELECT doc_id, s_no, c_no, unnest(range(len(parts))) AS h_no, unnest(parts) AS piece FROM (
    SELECT *, CASE WHEN length(c) > 50
      THEN [left(c, length(c) // 2), substr(c, length(c) // 2 + 1)] ELSE [c] END AS parts
    FROM commas)),
pieces AS MATERIALIZED (
  SELECT doc_id, piece, length(piece) AS size,
         row_number() OVER (PARTITION BY doc_id ORDER BY s_no, c_no, h_no) AS rn FROM halves),
walk AS (
  SELECT doc_id, rn, size AS joined, 0 AS run FROM pieces WHERE rn = 1
  UNION ALL
  SELECT p.doc_id, p.rn, CASE WHEN joined + 1 + size <= 20 THEN joined + 1 + size ELSE size END,
         run + CASE WHEN joined + 1 + size <= 20 THEN 0 ELSE 1 END
  FROM walk w JOIN pieces p ON p.doc_id = w.doc_id AND p.rn = w.rn + 1),
segments AS (
  SELECT doc_id AS id, CAST(run AS INTEGER) AS seg_idx, string_agg(piece, ',' ORDER BY rn) AS segment
  FROM walk JOIN pieces USING (doc_id, rn) GROUP BY doc_id, run
  UNION ALL SELECT doc_id, 0, text FROM texts WHERE length(text) < 50)"""


@QUERIES.add(query(_SEGMENTS, body="SELECT * FROM segments"))
def segment_text(spark, d):
    return speech.segment_text(v.texts(spark, d))


_ASSIGNED = SPEAKERS + """,
assigned AS (
  SELECT doc_id AS id, CASE WHEN lang = 'en' THEN 'zh-cn' ELSE lang END AS lang,
         'voice_' || (doc_id % 200) AS audio_id, coalesce(path, 'female-0-100.wav') AS voice_path
  FROM documents LEFT JOIN speakers s ON s.audio_id = 'voice_' || (doc_id % 200))"""


@QUERIES.add(query(_ASSIGNED, body="SELECT * FROM assigned"))
def assign_speaker(spark, d):
    return speech.assign_speaker(v.texts(spark, d).drop("text"), v.speakers(spark, d))


@QUERIES.add(query(_SEGMENTS, _ASSIGNED, body="""
SELECT a.*, seg_idx, segment FROM assigned a JOIN segments s ON s.id = a.id"""))
def speech_jobs(spark, d):
    return speech.speech_jobs(v.texts(spark, d), v.speakers(spark, d))


_EVENT_SPEAKERS = """added AS (
  SELECT 'voice_' || user_id AS audio_id, arg_max(event_type, event_id) AS path FROM events GROUP BY 1)"""


def _event_speakers(spark, d):
    return speech.latest_speakers(v.table(spark, d, "events").select(
        F.concat(F.lit("voice_"), "user_id").alias("audio_id"), F.col("event_type").alias("path"),
        "event_id"), "event_id")


@QUERIES.add(query(_EVENT_SPEAKERS, body="SELECT * FROM added"))
def latest_speakers(spark, d):
    return _event_speakers(spark, d)


@QUERIES.add(query(SPEAKERS, _EVENT_SPEAKERS, body="""
SELECT audio_id, path FROM speakers WHERE audio_id NOT IN (SELECT audio_id FROM added)
UNION ALL SELECT audio_id, path FROM added"""))
def add_speakers(spark, d):
    return speech.add_speakers(
        v.speakers(spark, d).select("audio_id", "path"), _event_speakers(spark, d))


@QUERIES.add(query(SPEAKERS, _EVENT_SPEAKERS, body="""
SELECT * FROM speakers WHERE audio_id NOT IN (
  SELECT audio_id FROM added WHERE path IN ('view', 'click'))"""))
def drop_speakers(spark, d):
    gone = _event_speakers(spark, d).filter(F.col("path").isin("view", "click"))
    return speech.drop_speakers(v.speakers(spark, d), gone)


@QUERIES.add(query(SPEAKERS, body="""
SELECT audio_id, gender, default_type, display_name, description, avatar_url,
       CASE WHEN substr(audio_id, 7)::BIGINT % 3 = 0 THEN 'later.wav' ELSE path END AS path
FROM speakers"""))
def load_speakers(spark, d):
    """Each supplier saved as a line of its own, every third again in a later folder, and read back."""
    folder = shared_folder(spark, "speakers")
    found = v.speakers(spark, d)
    again = F.substring("audio_id", 7, 20).cast("bigint") % 3 == 0
    speaker_files.save_speakers(found, f"{folder}/a")
    speaker_files.save_speakers(found.filter(again).withColumn("path", F.lit("later.wav")), f"{folder}/b")
    return speaker_files.load_speakers(spark, f"{folder}/*", multi_line=False)
