"""Model requests: classification, defaults, input checks, batch calls of a user's model."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from urllib.parse import urlsplit, urlunsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lectern.functions.text import token_count
from lectern.session import bound_batches

# Model names and their type codes, and the only type that is served.
UNKNOWN, OPENAI, WORKER, LLAMA_CPP, GPT4ALL = 0, 100, 200, 300, 400
MODEL_TYPES = {
    "gpt-4": OPENAI, "gpt-4-0314": OPENAI, "gpt-4-32k": OPENAI, "gpt-4-32k-0314": OPENAI,
    "gpt-3.5-turbo": OPENAI, "gpt-3.5-turbo-0301": OPENAI, "text-ada-001": OPENAI, "ada": OPENAI,
    "text-babbage-001": OPENAI, "babbage": OPENAI, "text-curie-001": OPENAI, "curie": OPENAI,
    "davinci": OPENAI, "text-davinci-003": OPENAI, "text-davinci-002": OPENAI,
    "code-davinci-002": OPENAI, "code-davinci-001": OPENAI, "code-cushman-002": OPENAI,
    "code-cushman-001": OPENAI, "ggml-llama-7b": LLAMA_CPP, "ggml-llama-13b": LLAMA_CPP,
    "ggml-vicuna-13b": LLAMA_CPP, "vicuna-13b-v1.5-16k": WORKER,
}
SUPPORTED = (WORKER,)

# Request defaults.
REPLY_TOKENS = 512
CALL_MAX_TOKENS, CALL_TEMPERATURE = 7000, 0.7


INPUT_ERROR = "input field must be string or []string"

USAGE_COLUMNS = "prompt_tokens bigint, completion_tokens bigint, total_tokens bigint"


def model_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(MODEL_TYPES.items()), "name string, type_code int")


def classify_models(
    requests: DataFrame, models: DataFrame, supported: Sequence[int] = SUPPORTED,
) -> DataFrame:
    """Requests with the type code of their model (0 when unknown) and whether it is served."""
    types = models.select(F.col("name").alias("model"), "type_code")
    code = F.coalesce("type_code", F.lit(UNKNOWN))
    return requests.join(types, "model", "left").select(
        *requests.columns, code.alias("type_code"), code.isin(*supported).alias("supported"))


def split_supported(classified: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Served requests, and the rejected rest with a reason."""
    return classified.filter("supported"), classified.filter("not supported").withColumn(
        "error", F.concat(F.lit("model: "), F.coalesce("model", F.lit("")), F.lit(" not support")))


def apply_request_defaults(df: DataFrame) -> DataFrame:
    """Reply limit 0 becomes the default, and only one choice is made."""
    return df.withColumn("max_tokens", F.when(
        F.coalesce("max_tokens", F.lit(0)) == 0, F.lit(REPLY_TOKENS)).otherwise(F.col("max_tokens"))
    ).withColumn("n", F.when(F.col("n") > 1, F.lit(1)).otherwise(F.col("n")))


def merge_call_options(df: DataFrame) -> DataFrame:
    """Missing call options take the base values."""
    return df.withColumn("max_tokens", F.coalesce("max_tokens", F.lit(CALL_MAX_TOKENS))).withColumn(
        "temperature", F.coalesce("temperature", F.lit(CALL_TEMPERATURE)))


def _checked(df: DataFrame, col: str) -> DataFrame:
    """Adds the parsed input as ``_input``, its type and the error; each input is parsed once."""
    kind = F.schema_of_variant("_input")
    valid = F.coalesce(kind.isin("STRING", "ARRAY<STRING>", "ARRAY<VOID>"), F.lit(False))
    return df.withColumn("_input", F.try_parse_json(col)).withColumns(
        {"input_type": kind, "error": F.when(~valid, F.lit(INPUT_ERROR))})


def validate_inputs(df: DataFrame, col: str = "input") -> DataFrame:
    """Adds ``input_type`` and, where the input is neither a string nor strings, ``error``."""
    return _checked(df, col).drop("_input")


def explode_inputs(df: DataFrame, col: str = "input") -> DataFrame:
    """One row (index, text) per text of each valid input."""
    texts = F.when(
        F.col("input_type") == "STRING", F.array(F.try_variant_get("_input", "$", "string"))
    ).otherwise(F.try_variant_get("_input", "$", "array<string>"))
    keep = [c for c in df.columns if c != col]
    return _checked(df, col).filter(F.col("error").isNull()).select(
        *keep, F.posexplode(texts).alias("index", "text"))


def valid_endpoints(endpoints: Iterable[str]) -> list[str]:
    """Endpoints with scheme and host, their path without a trailing slash; others are dropped."""
    found = []
    for text in endpoints:
        try:
            parts = urlsplit(text)
        except ValueError:
            continue
        if parts.scheme and parts.netloc:
            found.append(urlunsplit(parts._replace(path=parts.path.rstrip("/"))))
    return found


def assign_endpoint(df: DataFrame, endpoints: Sequence[str], key: str) -> DataFrame:
    """Spread rows over the valid endpoints, the same way each time."""
    usable = valid_endpoints(endpoints)
    if not usable:
        raise ValueError("no usable endpoint")
    digest = F.substring(F.md5(F.col(key).cast("string")), 1, 8)
    number = (F.conv(digest, 16, 10).cast("bigint") % len(usable)).cast("int")
    return df.withColumn("endpoint", F.get(F.array(*map(F.lit, usable)), number))


def _preferences(weights: dict[str, float], key: Column) -> Column:
    """The endpoints from the most to the least preferred of a key: highest random weight first."""
    def rank(name: str, weight: float) -> Column:
        digest = F.md5(F.concat(key, F.lit(" " + name)))
        chance = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 1) / float(16 ** 13)
        return F.struct((-F.log(chance) / weight).alias("cost"), F.lit(name).alias("name"))

    ranks = F.array(*[rank(name, weight) for name, weight in sorted(weights.items())])
    return F.transform(F.sort_array(ranks), lambda r: r["name"])


def _usable(weights: dict[str, float]) -> dict[str, float]:
    found = {u: float(w) for name, w in weights.items() if w > 0 for u in valid_endpoints([name])}
    if not found:
        raise ValueError("no usable endpoint")
    return found


def rendezvous_endpoint(df: DataFrame, weights: dict[str, float], key: str) -> DataFrame:
    """Each row's endpoint by weighted rendezvous hashing of its key.

    An endpoint gets rows in proportion to its weight, and if one goes only its own rows move. A null key
    counts as an empty one.
    """
    own = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return df.withColumn("endpoint", F.get(_preferences(_usable(weights), own), F.lit(0)))


def balanced_endpoint(df: DataFrame, weights: dict[str, float], key: str, bound: float = 1.25) -> DataFrame:
    """``rendezvous_endpoint`` with no endpoint above ``bound`` times its share of the rows.

    Rows that ask for an endpoint are counted by endpoint and hash of the key; it takes as many hash
    ranges as it has room for, and the others ask for their next choice. So a round sends a few thousand
    counts to the driver, whatever the rows. Rows of a key stay together: one that no endpoint has room
    for goes to its first choice and breaks the bound there.
    """
    if bound < 1:
        raise ValueError("bound must be at least 1")
    usable = _usable(weights)
    own = F.coalesce(F.col(key).cast("string"), F.lit(""))
    asked = F.col("_asked")
    slot = F.conv(F.substring(F.md5(F.concat(own, F.lit(" slot"))), 1, 4), 16, 10).cast("int").bitwiseAND(
        F.lit(_SLOTS - 1))
    ranked = df.select(_preferences(usable, own).alias("_asked"), slot.alias("_slot"))
    total = df.count()
    room = {name: bound * total * w / sum(usable.values()) for name, w in usable.items()}
    rounds: list[dict[str, int]] = []

    def taken(asked: Column, slot: Column) -> Column:
        """The first choice that has room for the slot, null if none so far has."""
        out = []
        for at, below in enumerate(rounds):
            choice = F.get(asked, F.lit(at))
            limit = F.element_at(F.create_map(*[F.lit(x) for pair in below.items() for x in pair]), choice)
            out.append(F.when(slot < limit, choice))
        return F.coalesce(*out) if out else F.lit(None).cast("string")

    for at in range(len(usable)):
        counts: dict[str, list[tuple[int, int]]] = {name: [] for name in usable}
        for name, slot_no, n in ranked.filter(taken(asked, F.col("_slot")).isNull()).groupBy(
                F.get(asked, F.lit(at)), "_slot").count().collect():
            counts[name].append((slot_no, n))
        rounds.append({})
        for name, found in counts.items():
            limit = 0 if found else _SLOTS
            for slot_no, n in sorted(found):
                if n > room[name]:
                    break
                room[name] -= n
                limit = slot_no + 1
            else:
                limit = _SLOTS
            rounds[-1][name] = limit
        if all(limit == _SLOTS for limit in rounds[-1].values()):
            break
    prefs = F.transform(F.array(_preferences(usable, own)), lambda p: F.coalesce(
        taken(p, slot), F.get(p, F.lit(0))))
    return df.withColumn("endpoint", F.get(prefs, F.lit(0)))


# Hash ranges by which an endpoint's rows are counted.
_SLOTS = 4096
# Tokens of a batch of prompts, padding included, and parts in which finished batches are kept.
TOKEN_BUDGET = 16_384
WAVES = 16
# Prompts that a task takes from a batch of Spark at once.
TAKEN = 64

Generator = Callable[[list[str]], list[dict]]
Embedder = Callable[[list[str]], list[list[float]]]


def complete_batch(df: DataFrame, generator: Generator, key: str, prompt: str = "prompt") -> DataFrame:
    """Replies of a user's model: ``generator(prompts)`` gives a dict per prompt.

    A dict holds text, finish_reason and the usage counts. When a batch fails its prompts are tried
    one by one, so an error stays with its own row.
    """
    kind = df.schema[key].dataType.simpleString()
    fields = ["text", "finish_reason", "prompt_tokens", "completion_tokens", "total_tokens", "error"]

    def one(text: str) -> dict:
        try:
            return generator([text])[0]
        except Exception as problem:  # noqa: BLE001 - a failing model call becomes an error row
            return {"error": str(problem)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            prompts = pdf[prompt].tolist()
            try:
                replies = generator(prompts)
                if len(replies) != len(prompts):
                    raise ValueError("one reply per prompt expected")
            except Exception:  # noqa: BLE001
                replies = [one(p) for p in prompts]
            out = {f: pd.Series([r.get(f) for r in replies], dtype="object") for f in fields}
            yield pd.DataFrame({key: pdf[key], **out})

    return df.select(key, prompt).mapInPandas(
        run, f"{key} {kind}, text string, finish_reason string, {USAGE_COLUMNS}, error string")


def _answer(generator: Generator, prompts: list[str]) -> list[dict]:
    """A reply for each prompt; if the batch fails they are tried one by one."""
    try:
        replies = generator(prompts)
        if len(replies) != len(prompts):
            raise ValueError("one reply per prompt expected")
        return replies
    except Exception as problem:  # noqa: BLE001 - a failing model call becomes an error row
        return [{"error": str(problem)}] if len(prompts) == 1 else [
            _answer(generator, [p])[0] for p in prompts]


def complete_by_budget(
    df: DataFrame, generator: Generator, key: str, path: str, prompt: str = "prompt", budget: int = TOKEN_BUDGET,
    waves: int = WAVES,
) -> DataFrame:
    """Replies as those of ``complete_batch``, from batches of like length, kept at ``path`` as they are made.

    Prompts are sorted by their tokens, and a batch is closed where its rows, each padded to the longest,
    would exceed ``budget`` tokens; a longer prompt is a batch of its own. Work goes in waves by hash of the
    key, each written as a whole. Called again, also after a run that was killed, it leaves out every key
    that has a reply. ``tokens`` and ``width`` are a prompt's own length and that of its batch. Keys name one
    row each.
    """
    spark, kind = df.sparkSession, df.schema[key].dataType
    fields = ["text", "finish_reason", "prompt_tokens", "completion_tokens", "total_tokens", "error"]
    kinds = (f"{key} {kind.simpleString()}, text string, finish_reason string, {USAGE_COLUMNS}, error string, "
             "tokens bigint, width bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def replies() -> pa.RecordBatch:
            keys, prompts, tokens = zip(*held)
            answers = _answer(generator, list(prompts))
            columns = [keys, *[[a.get(f) for a in answers] for f in fields], tokens, [max(tokens)] * len(tokens)]
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

        for batch in batches:
            for start in range(0, batch.num_rows, TAKEN):
                for row in zip(*(c.to_pylist() for c in batch.slice(start, TAKEN).columns)):
                    # rows come with rising length, so the new one is the longest
                    if held and (len(held) + 1) * max(1, row[2]) > budget:
                        yield replies()
                        held = []
                    held.append(row)
        if held:
            yield replies()

    def done() -> DataFrame:
        return spark.read.schema(kinds).parquet(path)

    bound_batches(spark)
    spark.createDataFrame([], kinds).write.mode("append").parquet(path)
    arrow = to_arrow_schema(done().schema)
    rows = df.select(key, F.coalesce(F.col(prompt), F.lit("")).alias("_prompt"))
    rows = rows.withColumn("_tokens", token_count(F.col("_prompt")).cast("bigint")).withColumn(
        "_wave", F.pmod(F.xxhash64(key), F.lit(waves)))
    for wave in range(waves):
        left = rows.filter(F.col("_wave") == wave).join(done().select(key), key, "left_anti")
        left.repartitionByRange("_tokens", key).sortWithinPartitions("_tokens", key).select(
            key, "_prompt", "_tokens").mapInArrow(run, kinds).write.mode("append").parquet(path)
    return done()


def padding_share(replies: DataFrame) -> DataFrame:
    """Share of the tokens given to the model that are padding, of replies by budget."""
    return replies.agg(F.coalesce(1 - F.try_divide(F.sum("tokens"), F.sum("width")), F.lit(0.0)).alias("padding"))


def embed_batch(df: DataFrame, embedder: Embedder, key: str, text: str = "text") -> DataFrame:
    """Vectors of a user's model: ``embedder(texts)`` gives one vector per text.

    As with replies, an error stays with its own row.
    """
    kind = df.schema[key].dataType.simpleString()

    def one(value: str) -> tuple[list[float] | None, str | None]:
        try:
            return embedder([value])[0], None
        except Exception as problem:  # noqa: BLE001 - a failing model call becomes an error row
            return None, str(problem)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf[text].tolist()
            try:
                rows = [(vector, None) for vector in embedder(texts)]
                if len(rows) != len(texts):
                    raise ValueError("one vector per text expected")
            except Exception:  # noqa: BLE001
                rows = [one(t) for t in texts]
            yield pd.DataFrame({
                key: pdf[key].to_numpy(), "embedding": [r[0] for r in rows],
                "error": pd.Series([r[1] for r in rows], dtype="object")})

    return df.select(key, text).mapInPandas(
        run, f"{key} {kind}, embedding array<float>, error string")
