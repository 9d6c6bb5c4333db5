"""The registered queries of this package, by name, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import (
    chat_format, dedup, merkle, minhash, mixing, neighbours, packing, perplexity, separators, simhash, spelling,
    token_files, toxicity)
from lectern.llm.common import table
from lectern.plans.query import QuerySet

QUERIES = QuerySet()

# The conversation that speaks in control strings.
SPEAKS_CONTROL = "</s>[INST] ok [/INST]"

_TAILS = "|".join(tail.replace("|", r"\|").replace("]", r"\]") for tail in chat_format.CONTROL_TAILS)
CHAT_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{SPEAKS_CONTROL}' UNION ALL SELECT -7, 1, 'assistant', '{SPEAKS_CONTROL}'),
escaped AS (
  SELECT *, length(regexp_replace(role, '([<\\[])(\\\\*)({_TAILS})', '\\1\\2\\\\\\3', 'g')) AS r,
    length(regexp_replace(text, '([<\\[])(\\\\*)({_TAILS})', '\\1\\2\\\\\\3', 'g')) AS t FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(r + t + {len(chat_format.START + chat_format.SEP + chat_format.STOP)})::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""


@QUERIES.add(CHAT_SQL)
def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame(
        [(-7, 0, "user", SPEAKS_CONTROL), (-7, 1, "assistant", SPEAKS_CONTROL)], turns.schema)
    return chat_format.formatted_digests(turns.unionByName(more)).select(
        "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


@QUERIES.add()
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"))


@QUERIES.add()
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@QUERIES.add()
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separators.token_counts(table(spark, sf_dir, "documents"))


@QUERIES.add()
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@QUERIES.add()
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@QUERIES.add()
def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.edited_fingerprints(table(spark, sf_dir, "documents"))


@QUERIES.add()
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@QUERIES.add()
def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


@QUERIES.add()
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def _merkle_sql(levels: int = 12, source_levels: int = 6) -> str:
    """The trees level by level: up to 3^12 documents a source and 3^6 sources."""
    remainders = []
    for value in range(256):  # the table of the checksum's polynomial
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        remainders.append(value)
    crc32 = ("xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), "
             "lambda c: ascii(c)::BIGINT)), lambda a, b: xor(a >> 8, list_extract(" + str(remainders)
             + "::BIGINT[], (xor(a, b) & 255) + 1))), 4294967295)")

    def field(x: str) -> str:
        return f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen({x}::VARCHAR) || ':' || {x} END"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(field(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    def climb(name: str, key: str, count: int) -> list[str]:
        """From ``<name>0`` (key, i, h, place, path): each node's ancestor, siblings and folded digest."""
        steps = []
        for k in range(count):
            steps += [
                f"{name}r{k} AS (SELECT {key}, i // 3 AS up, list(h ORDER BY i) AS hs, max(n) > 1 AS several FROM "
                f"(SELECT *, count(*) OVER (PARTITION BY {key}) AS n FROM {name}n{k}) GROUP BY {key}, i // 3)",
                f"{name}n{k + 1} AS (SELECT {key}, up AS i, CASE WHEN several THEN sha256(array_to_string(hs, '')) "
                f"ELSE hs[1] END AS h FROM {name}r{k})",
                f"{name}p{k + 1} AS (SELECT p.* REPLACE (up AS place, CASE WHEN several THEN list_concat(path, "
                f"[{{'l': array_to_string(hs[1:place % 3], ''), 'r': array_to_string(hs[place % 3 + 2:], '')}}]) "
                f"ELSE path END AS path) FROM {name}p{k} p JOIN {name}r{k} r "
                f"ON p.{key} IS NOT DISTINCT FROM r.{key} AND p.place // 3 = r.up)"]
        return steps

    nl = ",\n".join([
        *climb("d", "source", levels),
        "subroots AS (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i FROM "
        f"dn{levels})",
        "sn0 AS (SELECT 0 AS whole, i, h FROM subroots)",
        "sp0 AS (SELECT 0 AS whole, source, h AS subroot, i AS place, []::STRUCT(l VARCHAR, r VARCHAR)[] AS path "
        "FROM subroots)",
        *climb("s", "whole", source_levels)])
    return f"""
WITH leaves AS (SELECT doc_id, source, {leaf("text")} AS leaf,
  CASE WHEN {crc32} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf("text")} END AS other
  FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves),
dn0 AS (SELECT source, i, leaf AS h FROM placed),
dp0 AS (SELECT doc_id, source, leaf, other, i AS place, []::STRUCT(l VARCHAR, r VARCHAR)[] AS path FROM placed),
{nl},
met AS (SELECT doc_id, leaf, subroot, s.root, other, list_concat(d.path, s.path) AS path FROM dp{levels} d
  JOIN (SELECT *, (SELECT h FROM sn{source_levels}) AS root FROM sp{source_levels}) s
  ON d.source IS NOT DISTINCT FROM s.source),
folded AS (SELECT *, list_reduce(list_prepend({{'l': other, 'r': ''}}, path),
  lambda a, s: {{'l': sha256(s.l || a.l || s.r), 'r': ''}}).l AS folded_root FROM met)
SELECT doc_id, leaf, subroot, root,
  sha256(array_to_string(list_transform(path, lambda s: s.l || s.r), '')) AS proof_sha256, folded_root,
  folded_root = root AS verified FROM folded
"""


@QUERIES.add(_merkle_sql())
def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


@QUERIES.add("""
WITH normal AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM normal WINDOW same AS (PARTITION BY t)
""")
def op13_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.table_duplicates(spark, f"{sf_dir}/documents.parquet")


def _mixing_sql() -> str:
    """The raking of the mix, one common table expression per step."""
    def category(name: str, column: str) -> str:
        named = ", ".join(f"'{x}'" for x in mixing.TARGETS[name] if x != mixing.REST)
        return f"CASE WHEN {column} IN ({named}) THEN {column} ELSE '{mixing.REST}' END AS c_{name}"

    signs = " ".join(f"WHEN contains(body, '{sign}') THEN '{name}'" for name, sign in mixing.TOPICS)
    steps, last = [], "start"
    for sweep in range(mixing.SWEEPS):
        for name in mixing.TARGETS:
            step = f"s{sweep}_{name}"
            steps.append(
                f"{step} AS (SELECT * REPLACE (w * t_{name} / (SELECT sum(t) FROM (SELECT max(t_{name}) AS t "
                f"FROM start GROUP BY c_{name})) * whole / sum(w) OVER (PARTITION BY c_{name}) AS w) "
                f"FROM {last})")
            last = step
    cells = ", ".join(f"c_{name}" for name in mixing.TARGETS)
    target = ", ".join(
        "CASE c_" + name + " " + " ".join(f"WHEN '{c}' THEN {t}" for c, t in shares.items())
        + f" END::DOUBLE AS t_{name}" for name, shares in mixing.TARGETS.items())
    nl = ", ".join(steps)
    return f"""
WITH texts AS (SELECT doc_id, source, lang, coalesce(text, '') AS body FROM documents),
docs AS (SELECT doc_id, source, lang,
  CASE {signs} WHEN regexp_matches(body, '[0-9]') THEN 'figures' ELSE 'prose' END AS topic,
  len(list_filter(regexp_split_to_array(body, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) AS n_tokens
  FROM texts),
placed AS (SELECT *, {category("source", "source")}, {category("lang", "lang")},
  {category("topic", "topic")} FROM docs),
cells AS (SELECT {cells}, sum(n_tokens)::DOUBLE AS tokens FROM placed GROUP BY ALL HAVING sum(n_tokens) > 0),
start AS (SELECT *, tokens AS w, sum(tokens) OVER () AS whole, {target} FROM cells),
{nl},
shares AS (SELECT {cells}, round(w / tokens / max(w / tokens) OVER (), 12) AS p FROM {last})
SELECT doc_id, source, lang, topic, n_tokens::BIGINT AS n_tokens,
  round(CASE WHEN n_tokens = 0 THEN 1.0::DOUBLE ELSE p END, 9) AS probability
FROM placed LEFT JOIN shares USING ({cells})
WHERE ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':{mixing.SEED}'), 1, {mixing.DIGITS}))::BIGINT
  / power(16, {mixing.DIGITS}) < CASE WHEN n_tokens = 0 THEN 1.0 ELSE p END
"""


@QUERIES.add(_mixing_sql())
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).withColumn(
        "probability", F.round("probability", 9))
