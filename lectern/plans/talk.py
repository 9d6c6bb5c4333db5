"""Conversation and reply queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import chat, requests, vectors
from lectern.plans import views as v
from lectern.plans.query import QuerySet
from lectern.plans.sql_views import MESSAGES, REPLIES, query
from lectern.session import shared_folder

QUERIES = QuerySet()

# kept messages by the unit rule: bytes of newer units below the limit
_KEPT = MESSAGES + """,
placed AS (
  SELECT *, strlen(content) AS bytes, role = 'user' AS is_user,
         lead(role = 'user') OVER w AS next_user, lead(strlen(content)) OVER w AS next_bytes,
         lag(role = 'user') OVER w AS prev_user
  FROM messages WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
units AS (
  SELECT *, is_user AND NOT coalesce(next_user, false) AS leads,
         NOT is_user AND coalesce(prev_user, false) AS follows FROM placed),
weighed AS (
  SELECT *, coalesce(sum(CASE WHEN leads THEN bytes + coalesce(next_bytes, 0) ELSE 0 END) OVER (
    PARTITION BY conv_id ORDER BY turn DESC
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS newer FROM units),
kept AS (
  SELECT conv_id, turn, role, content FROM weighed WHERE (leads OR follows) AND newer < {limit})"""


@QUERIES.add(query(_KEPT.format(limit=8192), body="SELECT * FROM kept"))
def cut_history(spark, d):
    return chat.cut_history(v.messages(spark, d))


@QUERIES.add(query(_KEPT.format(limit=1500), body="SELECT * FROM kept"))
def cut_history_short(spark, d):
    return chat.cut_history(v.messages(spark, d), 1500)


_PROMPT = """
SELECT c.conv_id, '你是一个助手。' || coalesce(string_agg(CASE role
    WHEN 'user' THEN 'USER: ' || content || ' '
    WHEN 'assistant' THEN 'ASSISTANT: ' || content || '</s>' ELSE '' END, '' ORDER BY turn), '')
  || 'ASSISTANT: ' AS prompt
FROM (SELECT DISTINCT conv_id FROM messages) c LEFT JOIN kept k ON k.conv_id = c.conv_id
GROUP BY c.conv_id"""


@QUERIES.add(query(_KEPT.format(limit=8192), body=_PROMPT))
def build_prompts(spark, d):
    return chat.build_prompts(v.messages(spark, d))


@QUERIES.add(query(_KEPT.format(limit=1500), body=_PROMPT))
def build_prompts_short(spark, d):
    return chat.build_prompts(v.messages(spark, d), 1500)


_MODEL = "vicuna-13b-v1.5-16k"

_OPTIONS = """options AS (
  SELECT DISTINCT conv_id, (conv_id % 10) / 10.0::DOUBLE AS temperature,
         CASE WHEN conv_id % 3 > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS top_p, least(conv_id % 4, 1) AS n,
         conv_id % 2 = 0 AS stream, CASE WHEN conv_id % 5 = 0 THEN ['</s>', 'USER:'] ELSE [] END AS stop,
         CASE WHEN (conv_id % 4) * 100 = 0 THEN 512 ELSE (conv_id % 4) * 100 END AS max_tokens,
         CASE WHEN conv_id % 6 > 0 THEN 'user-' || conv_id ELSE '' END AS user_name
  FROM conversations WHERE conv_id % 7 > 0)"""


@QUERIES.add(query(MESSAGES, _OPTIONS, body="""
SELECT m.conv_id, '{"model":"vicuna-13b-v1.5-16k","messages":[' || string_agg(
    '{"role":' || to_json(role) || ',"content":' || to_json(content) || '}', ',' ORDER BY turn) || ']'
  || any_value(coalesce(
    CASE WHEN temperature > 0 THEN ',"temperature":' || to_json(temperature) ELSE '' END
    || CASE WHEN top_p > 0 THEN ',"top_p":1.0' ELSE '' END
    || CASE WHEN n > 0 THEN ',"n":' || n ELSE '' END
    || CASE WHEN stream THEN ',"stream":true' ELSE '' END
    || CASE WHEN len(stop) > 0 THEN ',"stop":' || to_json(stop) ELSE '' END
    || ',"max_tokens":' || max_tokens
    || CASE WHEN user_name <> '' THEN ',"user":' || to_json(user_name) ELSE '' END, '')) || '}' AS request
FROM messages m LEFT JOIN options o ON o.conv_id = m.conv_id GROUP BY m.conv_id"""))
def build_requests(spark, d):
    return chat.build_requests(v.messages(spark, d), _MODEL, v.request_options(spark, d))


@QUERIES.add(query(_KEPT.format(limit=8192), _OPTIONS, body=f"""
SELECT p.conv_id, '{{"model":"{_MODEL}","prompt":' || to_json(prompt)
  || ',"temperature":' || to_json(coalesce(temperature, 0.0::DOUBLE))
  || ',"top_p":' || to_json(coalesce(top_p, 0.0::DOUBLE))
  || ',"max_new_tokens":' || coalesce(max_tokens, 0)
  || ',"stream":' || coalesce(stream, false)::VARCHAR || '}}' AS request
FROM ({_PROMPT}) p LEFT JOIN options o ON o.conv_id = p.conv_id"""))
def build_worker_requests(spark, d):
    return chat.build_worker_requests(v.messages(spark, d), _MODEL, v.request_options(spark, d))


@QUERIES.add("""
SELECT doc_id, lang, CAST(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')) AS BIGINT) AS tokens
FROM documents""")
def count_tokens(spark, d):
    return chat.count_tokens(v.table(spark, d, "documents"), "text", "[^ \\t\\n\\r]+").select(
        "doc_id", "lang", "tokens")


@QUERIES.add("""
SELECT lang, source, CAST(sum(len(regexp_extract_all(text, '[A-Za-z]+|[0-9]+'))) AS BIGINT) AS tokens
FROM documents GROUP BY lang, source""")
def count_tokens_by_source(spark, d):
    counted = chat.count_tokens(v.table(spark, d, "documents"), "text", "[A-Za-z]+|[0-9]+")
    return counted.groupBy("lang", "source").agg(F.sum("tokens").alias("tokens"))


@QUERIES.add("""
SELECT doc_id, array_to_string(list_slice(words, greatest(len(words) - 199, 0) + 1, len(words)), ' ')
  AS kept
FROM (SELECT doc_id, string_split(text, ' ') AS words FROM documents)""")
def truncate_tokens(spark, d):
    words = v.table(spark, d, "documents").select("doc_id", F.split("text", " ", -1).alias("tokens"))
    return chat.truncate_tokens(words, "tokens", 300, 100).select(
        "doc_id", F.array_join("tokens", " ").alias("kept"))


@QUERIES.add(query(REPLIES, body="""
SELECT conv_id, turn, conv_id || '-' || turn AS response_id, turn AS created,
       turn * 10 AS prompt_tokens, len(string_split(text, ' ')) AS completion_tokens,
       turn * 10 + len(string_split(text, ' ')) AS total_tokens,
       CAST(unnest(range(len(lines))) AS INTEGER) AS choice, 'stop' AS finish_reason,
       'assistant' AS role, unnest(lines) AS content
FROM replies"""))
def parse_responses(spark, d):
    return chat.parse_responses(v.responses(spark, d))


@QUERIES.add(query(REPLIES, body="""
SELECT conv_id, turn, array_to_string(lines, '') AS text FROM replies"""))
def join_choices(spark, d):
    return chat.join_choices(v.responses(spark, d)).drop("body")


@QUERIES.add(query(REPLIES, body="""
SELECT conv_id, CAST(sum(len(lines)) AS BIGINT) AS replies,
       CAST(sum(turn * 10 * len(lines)) AS BIGINT) AS prompt_tokens,
       CAST(sum(len(string_split(text, ' ')) * len(lines)) AS BIGINT) AS completion_tokens,
       CAST(sum((turn * 10 + len(string_split(text, ' '))) * len(lines)) AS BIGINT) AS total_tokens
FROM replies GROUP BY conv_id"""))
def usage_summary(spark, d):
    return chat.usage_summary(chat.parse_responses(v.responses(spark, d)), ["conv_id"])


@QUERIES.add("SELECT doc_id, text FROM documents")
def strip_echo(spark, d):
    prompt = F.concat("source", F.lit(": "))
    echoed = v.table(spark, d, "documents").select(
        "doc_id", prompt.alias("prompt"),
        F.when(F.col("lang") == "en", F.concat(prompt, "text")).otherwise(F.col("text")).alias("text"))
    return chat.strip_echo(echoed).drop("prompt")


_STOPS = ["###", "the ", "é"]


def _stop_sql(stops):
    cases, ends = [], []
    for stop in stops:
        cut = f"left(text, CAST(length(text) - length(string_split(text, '{stop}')[-1]) - {len(stop)} AS BIGINT))"
        partial = " OR ".join(f"ends_with(text, '{stop[:i]}')" for i in range(1, len(stop) + 1))
        cases.append((f"contains(text, '{stop}')", cut, "true", "false"))
        ends.append((f"({partial})", "text", "false", "true"))
    steps = [step for pair in zip(cases, ends) for step in pair]

    def column(place, otherwise):
        return "CASE " + " ".join(f"WHEN {s[0]} THEN {s[place]}" for s in steps) + f" ELSE {otherwise} END"

    return (f"SELECT doc_id, {column(1, 'text')} AS text, {column(2, 'false')} AS stopped, "
            f"{column(3, 'false')} AS partial FROM documents")


@QUERIES.add(_stop_sql(_STOPS))
def cut_at_stop(spark, d):
    return chat.cut_at_stop(v.table(spark, d, "documents").select("doc_id", "text"), "text", _STOPS)


@QUERIES.add("""
SELECT event_id, CASE WHEN event_id % 64 = 63 THEN 'length' WHEN event_type = 'click' THEN 'stop' END
  AS finish_reason FROM events""")
def finish_reason(spark, d):
    runs = v.table(spark, d, "events").select(
        "event_id", (F.col("event_id") % 64).alias("completion_tokens"),
        F.lit(64).alias("max_new_tokens"), (F.col("event_type") == "click").alias("stopped"))
    return chat.finish_reason(runs).select("event_id", "finish_reason")


@QUERIES.add(query(REPLIES, """lines AS (
  SELECT request_id, nul, turn, text, len(lines) AS n, unnest(range(len(lines))) AS seq,
         unnest(lines) AS line FROM replies)""", body="""
SELECT request_id, seq, CAST(0 AS INTEGER) AS pos, 'delta' AS kind, line AS text,
       CAST(NULL AS VARCHAR) AS finish_reason, CASE WHEN NOT nul THEN turn * 10 END AS prompt_tokens,
       CASE WHEN NOT nul THEN n END AS completion_tokens,
       CASE WHEN NOT nul THEN turn * 10 + n END AS total_tokens, CAST(NULL AS VARCHAR) AS error
FROM lines
UNION ALL
SELECT request_id, len(lines), 0, 'error', NULL, NULL, NULL, NULL, NULL,
       CASE WHEN nul THEN 'out of memory' ELSE 'malformed frame' END FROM replies WHERE broken
UNION ALL
SELECT request_id, len(lines), 0, CASE WHEN nul THEN 'final' ELSE 'delta' END,
       CASE WHEN nul THEN text ELSE '' END, 'stop', turn * 10, len(lines), turn * 10 + len(lines), NULL
FROM replies WHERE NOT broken
UNION ALL
SELECT request_id, len(lines), 1, 'done', NULL, NULL, NULL, NULL, NULL, NULL
FROM replies WHERE NOT broken AND NOT nul"""))
def parse_frames(spark, d):
    return chat.parse_frames(v.frames(spark, d))


ASSEMBLED = query(REPLIES, body="""
SELECT request_id, array_to_string(lines, '') AS text,
       CASE WHEN nul AND NOT broken THEN replies.text END AS message,
       CASE WHEN NOT broken THEN 'stop' END AS finish_reason,
       CASE WHEN NOT (nul AND broken) THEN turn * 10 END AS prompt_tokens,
       CASE WHEN NOT (nul AND broken) THEN len(lines) END AS completion_tokens,
       CASE WHEN NOT (nul AND broken) THEN turn * 10 + len(lines) END AS total_tokens,
       CASE WHEN broken THEN CASE WHEN nul THEN 'out of memory' ELSE 'malformed frame' END END AS error,
       broken OR NOT nul AS ended,
       len(lines) + CASE WHEN broken OR nul THEN 1 ELSE 2 END AS frames
FROM replies""")


@QUERIES.add(ASSEMBLED)
def assemble_cut_replies(spark, d):
    """The same replies from frames that were cut anywhere on their way."""
    return chat.assemble_replies(chat.whole_frames(v.cut_frames(spark, d)))


@QUERIES.add(ASSEMBLED)
def assemble_replies(spark, d):
    return chat.assemble_replies(v.frames(spark, d))


# model names by event type
_MODELS = {"view": "gpt-4", "click": "vicuna-13b-v1.5-16k", "error": "no-such-model",
           "purchase": "ggml-llama-7b"}
_REQUESTS = "requests AS (SELECT event_id AS request_id, CASE event_type " + " ".join(
    f"WHEN '{k}' THEN '{m}'" for k, m in _MODELS.items()) + " END AS model FROM events)"


def _requests(spark, d):
    model = F.lit(None)
    for kind, name in _MODELS.items():
        model = F.when(F.col("event_type") == kind, F.lit(name)).otherwise(model)
    return v.table(spark, d, "events").select(F.col("event_id").alias("request_id"), model.alias("model"))


@QUERIES.add(query(_REQUESTS, body="""
SELECT request_id, model, CAST(CASE model WHEN 'gpt-4' THEN 100 WHEN 'vicuna-13b-v1.5-16k' THEN 200
  WHEN 'ggml-llama-7b' THEN 300 ELSE 0 END AS INTEGER) AS type_code,
  coalesce(model, '') = 'vicuna-13b-v1.5-16k' AS supported FROM requests"""))
def classify_models(spark, d):
    return requests.classify_models(_requests(spark, d), requests.model_registry(spark))


@QUERIES.add(query(_REQUESTS, body="""
SELECT request_id, 'model: ' || coalesce(model, '') || ' not support' AS error FROM requests
WHERE coalesce(model, '') <> 'vicuna-13b-v1.5-16k'"""))
def rejected_models(spark, d):
    classified = requests.classify_models(_requests(spark, d), requests.model_registry(spark))
    return requests.split_supported(classified)[1].select("request_id", "error")


@QUERIES.add("""
SELECT event_id AS request_id, CAST(CASE WHEN event_id % 5 = 0 THEN 512 ELSE event_id % 5 END AS INTEGER)
  AS max_tokens, CAST(least(event_id % 4, 1) AS INTEGER) AS n FROM events""")
def apply_request_defaults(spark, d):
    return requests.apply_request_defaults(v.table(spark, d, "events").select(
        F.col("event_id").alias("request_id"), (F.col("event_id") % 5).cast("int").alias("max_tokens"),
        (F.col("event_id") % 4).cast("int").alias("n")))


@QUERIES.add("""
SELECT event_id AS request_id, CAST(CASE WHEN event_type = 'view' THEN 7000 ELSE 64 END AS INTEGER)
  AS max_tokens, CASE WHEN event_type = 'click' THEN 0.7 ELSE value END AS temperature FROM events""")
def merge_call_options(spark, d):
    kind = F.col("event_type")
    return requests.merge_call_options(v.table(spark, d, "events").select(
        F.col("event_id").alias("request_id"), F.when(kind != "view", 64).alias("max_tokens"),
        F.when(kind != "click", F.col("value")).alias("temperature")))


def _inputs(spark, d):
    """Documents as embedding inputs: a string, strings, a number, an object, by language."""
    text, lines = F.to_json(F.array("text")), F.to_json(F.split("text", "\n", -1))
    return v.table(spark, d, "documents").select(
        F.col("doc_id").alias("request_id"),
        F.when(F.col("lang") == "en", F.substr(text, F.lit(2), F.length(text) - 2))
        .when(F.col("lang") == "fr", lines)
        .when(F.col("lang") == "de", F.col("n_chars").cast("string"))
        .otherwise(F.to_json(F.struct("source"))).alias("input"))


@QUERIES.add("""
SELECT doc_id AS request_id, CASE WHEN lang NOT IN ('en', 'fr')
  THEN 'input field must be string or []string' END AS error FROM documents""")
def validate_inputs(spark, d):
    return requests.validate_inputs(_inputs(spark, d)).select("request_id", "error")


@QUERIES.add("""
SELECT doc_id AS request_id, CAST(0 AS INTEGER) AS index, text FROM documents WHERE lang = 'en'
UNION ALL
SELECT doc_id, CAST(unnest(range(len(string_split(text, chr(10))))) AS INTEGER),
       unnest(string_split(text, chr(10))) FROM documents WHERE lang = 'fr'""")
def explode_inputs(spark, d):
    return requests.explode_inputs(_inputs(spark, d))


_ENDPOINTS = ["http://a:1/", "nonsense", "http://b:2", "://c", "https://c/x/"]


@QUERIES.add("""
SELECT event_id, ['http://a:1', 'http://b:2', 'https://c/x'][
  CAST(('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8))::BIGINT % 3 AS INTEGER) + 1] AS endpoint
FROM events""")
def assign_endpoint(spark, d):
    return requests.assign_endpoint(
        v.table(spark, d, "events").select("event_id"), _ENDPOINTS, "event_id")


_WEIGHTS = dict(zip(requests.valid_endpoints(_ENDPOINTS), (1.0, 2.0, 3.0, 1.5, 2.5)))
_COST = ("-ln((('0x' || substr(md5(event_id::VARCHAR || ' {0}'), 1, 13))::BIGINT + 1)::DOUBLE / power(16, 13)) / {1}")


@QUERIES.add("SELECT event_id, CASE " + " ".join(
    f"WHEN c{i} = least({', '.join(f'c{j}' for j in range(len(_WEIGHTS)))}) THEN '{name}'"
    for i, name in enumerate(_WEIGHTS)) + " END AS endpoint FROM (SELECT event_id, " + ", ".join(
    f"{_COST.format(name, weight)} AS c{i}" for i, (name, weight) in enumerate(_WEIGHTS.items())) + " FROM events)")
def rendezvous_endpoint(spark, d):
    return requests.rendezvous_endpoint(v.table(spark, d, "events").select("event_id"), _WEIGHTS, "event_id")


@QUERIES.add("SELECT endpoint, true AS within FROM (VALUES "
             + ", ".join(f"('{name}')" for name in _WEIGHTS) + ") AS t(endpoint)")
def balanced_endpoint(spark, d):
    """The endpoints, and whether each has at most 1.25 times its share of the events."""
    events = v.table(spark, d, "events").select("event_id")
    shares = {n: w / sum(_WEIGHTS.values()) for n, w in _WEIGHTS.items()}
    most = F.element_at(F.create_map(*[F.lit(x) for pair in shares.items() for x in pair]), F.col("endpoint")) * 1.25
    return requests.balanced_endpoint(events, _WEIGHTS, "event_id").groupBy("endpoint").count().select(
        "endpoint", (F.col("count") <= most * events.count()).alias("within"))


def word_counter(prompts: list[str]) -> list[dict]:
    """A stand-in model that tells how long its prompt is, and refuses short ones."""
    if any(len(p) < 300 for p in prompts):
        raise ValueError("too short")
    return [{"text": f"{len(p)} characters", "finish_reason": "stop",
             "prompt_tokens": len(p.split(" ")), "completion_tokens": 2,
             "total_tokens": len(p.split(" ")) + 2} for p in prompts]


@QUERIES.add("""
SELECT doc_id, CASE WHEN ok THEN chars || ' characters' END AS text,
       CASE WHEN ok THEN 'stop' END AS finish_reason, CASE WHEN ok THEN words END AS prompt_tokens,
       CASE WHEN ok THEN CAST(2 AS BIGINT) END AS completion_tokens,
       CASE WHEN ok THEN words + 2 END AS total_tokens, CASE WHEN NOT ok THEN 'too short' END AS error
FROM (SELECT doc_id, length(text) AS chars, len(string_split(text, ' ')) AS words,
             length(text) >= 300 AS ok FROM documents)""")
def complete_batch(spark, d):
    return requests.complete_batch(
        v.table(spark, d, "documents").withColumnRenamed("text", "prompt"), word_counter, "doc_id")


@QUERIES.add(QUERIES["complete_batch"].sql)
def complete_by_budget(spark, d):
    replies = requests.complete_by_budget(
        v.table(spark, d, "documents").withColumnRenamed("text", "prompt"), word_counter, "doc_id",
        shared_folder(spark, "replies"), waves=2)
    return replies.drop("tokens", "width")


def letter_counter(texts: list[str]) -> list[list[float]]:
    """A stand-in embedder."""
    return [[float(len(t)), float(t.count("e")), float(t.count(" ")), 1.0] for t in texts]


@QUERIES.add("""
SELECT doc_id, CAST(pos AS INTEGER) AS pos, round(v[pos + 1] / norm, 6) AS x
FROM (SELECT doc_id, v, sqrt(list_sum(list_transform(v, lambda a: a * a))) AS norm,
             unnest([0, 1, 2, 3]) AS pos
      FROM (SELECT doc_id, [CAST(length(text) AS DOUBLE), length(text) - length(replace(text, 'e', '')),
                            length(text) - length(replace(text, ' ', '')), 1] AS v FROM documents))""")
def embed_batch(spark, d):
    embedded = requests.embed_batch(v.table(spark, d, "documents"), letter_counter, "doc_id")
    return vectors.l2_normalize(embedded, "embedding").select(
        "doc_id", F.posexplode("embedding").alias("pos", "x")).withColumn("x", F.round("x", 6))
