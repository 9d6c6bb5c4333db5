"""Conversations to prompts, and reply streams back to replies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.arrays import keep_tail
from lectern.functions.text import last_position, stop_cut, token_count
from lectern.model import RESPONSE, WORKER_FRAME

# Fixed values of the prompt format.
MAX_HISTORY_BYTES = 8192
PREAMBLE = "你是一个助手。"
USER_TAG, ASSISTANT_TAG, TURN_END = "USER: ", "ASSISTANT: ", "</s>"

# Fixed values of the two stream formats.
NUL = "\x00"
DATA_PREFIX = "data: "
DONE = "[DONE]"

# Consecutive messages or frames handled as one array. A conversation or reply of any length is
# spread over tasks in chunks of this size.
CHUNK = 256


# --- conversations -------------------------------------------------------------------------------

def _chunks(df: DataFrame, key: str, order: str, item: Column, size: int) -> DataFrame:
    """One row per (key, chunk) with the chunk's items in order, at most ``size`` of them.

    Items are dealt by key and slot of their order; a slot in which the order repeats or is null may hold
    any number, so its items are numbered and cut once more. ``item`` begins with the order.
    """
    inside = F.row_number().over(Window.partitionBy(key, "slot").orderBy("item"))
    slots = df.select(key, F.floor(F.col(order) / size).alias("slot"), item.alias("item"))
    return slots.withColumn("part", F.floor((inside - 1) / size)).groupBy(key, "slot", "part").agg(
        F.sort_array(F.collect_list("item")).alias("items")).select(
        key, F.struct("slot", "part").alias("chunk"), "items")


def _sum(items: Column, field: str) -> Column:
    return F.aggregate(items, F.lit(0).cast("bigint"), lambda acc, m: acc + m[field])


def _units(items: Column, next_user: Column, next_bytes: Column, prev_user: Column) -> Column:
    """Items with ``size``, the bytes of the unit an item leads, and ``member``.

    A unit is a user message together with the reply that follows, or the last message alone when it
    is the user's. The three columns describe the neighbours outside of the chunk.
    """
    def unit(m: Column, i: Column) -> Column:
        after = F.get(items, i + 1)
        before = F.get(items, i - 1)
        following_user = F.when(after.isNotNull(), after["user"]).otherwise(next_user)
        following_bytes = F.when(after.isNotNull(), after["bytes"]).otherwise(next_bytes)
        preceding_user = F.when(before.isNotNull(), before["user"]).otherwise(prev_user)
        leads = m["user"] & ~F.coalesce(following_user, F.lit(False))
        follows = ~m["user"] & F.coalesce(preceding_user, F.lit(False))
        return F.struct(
            m["turn"].alias("turn"), m["role"].alias("role"), m["content"].alias("content"),
            F.when(leads, m["bytes"] + F.coalesce(following_bytes, F.lit(0)))
            .otherwise(F.lit(0)).cast("bigint").alias("size"),
            (leads | follows).alias("member"))

    return F.transform(items, unit)


def _kept_size(units: Column, newer: Column, max_bytes: int) -> Column:
    """How many items, from the newest, have less than ``max_bytes`` in the units after them."""
    start = F.struct(newer.cast("bigint").alias("newer"), F.lit(0).alias("n"))
    return F.aggregate(
        F.reverse(units), start,
        lambda acc, m: F.struct(
            (acc["newer"] + m["size"]).alias("newer"),
            (acc["n"] + (acc["newer"] < max_bytes).cast("int")).alias("n")),
        lambda acc: acc["n"])


def _newest(items: Column, n: Column) -> Column:
    """The last ``n`` items; ``n`` stands in an array so that it is worked out once."""
    return F.flatten(F.transform(F.array(n), lambda k: F.slice(items, F.size(items) - k + 1, k)))


def _kept_chunks(messages: DataFrame, max_bytes: int, chunk: int) -> DataFrame:
    """(conv_id, chunk, items) with the kept messages of each chunk.

    Chunks of a conversation are built in parallel. A user message at the end of a chunk might lead
    a unit or not; counting it as none gives a lower bound, and what that bound already cuts is
    dropped before chunks of a conversation meet.
    """
    if max_bytes < 1:
        raise ValueError("max_bytes must be positive")
    item = F.struct(
        "turn", "role", "content", F.coalesce(F.col("role") == "user", F.lit(False)).alias("user"),
        F.octet_length(F.coalesce("content", F.lit(""))).cast("bigint").alias("bytes"))
    head, tail = F.get("items", F.lit(0)), F.element_at("items", -1)
    bound = _units(F.col("items"), F.lit(True), F.lit(0), F.lit(False))
    chunks = (
        _chunks(messages, "conv_id", "turn", item, chunk)
        .withColumn("head", F.struct(head["user"].alias("user"), head["bytes"].alias("bytes")))
        .withColumn("tail_user", tail["user"])
        # one older message stays as the neighbour of the first
        .withColumn("n", _kept_size(bound, F.lit(0), max_bytes) + 1)
        .withColumn("whole", F.size("items") <= F.col("n"))
        .withColumn("items", F.when(F.col("whole"), F.col("items")).otherwise(
            _newest(F.col("items"), F.col("n"))))
        .drop("n"))
    newest_first = Window.partitionBy("conv_id").orderBy(F.desc("chunk"))
    after = F.lag("head").over(newest_first)
    before = F.lead("tail_user").over(newest_first)
    units = chunks.withColumn("after", after).withColumn("before", before).withColumn(
        "items", _units(F.col("items"), F.col("after.user"), F.col("after.bytes"),
                        F.when(F.col("whole"), F.col("before"))))
    newer = F.sum(F.col("bytes")).over(newest_first.rowsBetween(Window.unboundedPreceding, -1))
    return (
        units.withColumn("bytes", _sum(F.col("items"), "size"))
        .withColumn("newer", F.coalesce(newer, F.lit(0)))
        .filter(F.col("newer") < max_bytes)
        .select("conv_id", "chunk", F.filter(
            _newest(F.col("items"), _kept_size(F.col("items"), F.col("newer"), max_bytes)),
            lambda m: m["member"]).alias("items")))


def cut_history(
    messages: DataFrame, max_bytes: int = MAX_HISTORY_BYTES, chunk: int = CHUNK,
) -> DataFrame:
    """The newest whole units of each conversation, up to the one that reaches ``max_bytes``.

    ``turn`` orders a conversation; lengths are bytes of UTF-8.
    """
    kept = _kept_chunks(messages, max_bytes, chunk).select("conv_id", F.explode("items").alias("m"))
    return kept.select("conv_id", "m.turn", "m.role", "m.content")


def _spoken(messages: DataFrame, max_bytes: int, chunk: int) -> DataFrame:
    """Kept messages with text, one array per conversation; ``max_bytes`` bounds its size."""
    spoken = _kept_chunks(messages, max_bytes, chunk).withColumn(
        "items", F.filter("items", lambda m: F.length(m["content"]) > 0))
    return spoken.groupBy("conv_id").agg(F.flatten(F.transform(
        F.sort_array(F.collect_list(F.struct("chunk", "items"))), lambda c: c["items"],
    )).alias("items"))


def build_prompts(
    messages: DataFrame, max_bytes: int = MAX_HISTORY_BYTES, chunk: int = CHUNK,
) -> DataFrame:
    """One prompt per conversation from its cut history; system and empty messages are left out."""
    def spoken(m: Column) -> Column:
        return (
            F.when(m["role"] == "user", F.concat(F.lit(USER_TAG), m["content"], F.lit(" ")))
            .when(m["role"] == "assistant",
                  F.concat(F.lit(ASSISTANT_TAG), m["content"], F.lit(TURN_END)))
            .otherwise(F.lit("")))

    return _spoken(messages, max_bytes, chunk).select("conv_id", F.concat(
        F.lit(PREAMBLE), F.coalesce(F.array_join(F.transform("items", spoken), ""), F.lit("")),
        F.lit(ASSISTANT_TAG)).alias("prompt"))


def _messages(messages: DataFrame, max_bytes: int | None, chunk: int) -> DataFrame:
    """(conv_id, items): every message in turn order, or the cut history where a limit is given."""
    if max_bytes is not None:
        return _spoken(messages, max_bytes, chunk)
    chunks = _chunks(messages, "conv_id", "turn", F.struct("turn", "role", "content"), chunk)
    return chunks.groupBy("conv_id").agg(F.flatten(F.transform(
        F.sort_array(F.collect_list(F.struct("chunk", "items"))), lambda c: c["items"],
    )).alias("items"))


def _unless_zero(name: str, zero: object) -> Column:
    """The option, NULL and so left out of the document where it is not set."""
    return F.nullif(F.col(name), F.lit(zero)).alias(name)


def build_requests(
    messages: DataFrame, model: str, options: DataFrame | None = None, max_bytes: int | None = None,
    chunk: int = CHUNK,
) -> DataFrame:
    """One request document per conversation with all its messages and its options.

    ``options`` has one row per conv_id with temperature, top_p, n, stream, stop, max_tokens and user;
    options that are 0, false, empty or NULL are left out, as are those of conversations without a row.
    System and empty messages are kept. A document is one value, so it holds its conversation in one
    row; ``max_bytes`` cuts the history first, as prompts do.
    """
    said = _messages(messages, max_bytes, chunk).select("conv_id", F.transform("items", lambda m: F.struct(
        F.coalesce(m["role"], F.lit("")).alias("role"),
        F.coalesce(m["content"], F.lit("")).alias("content"))).alias("messages"))
    fields = [F.lit(model).alias("model"), F.col("messages")]
    if options is not None:
        said = said.join(options, "conv_id", "left")
        fields += [
            _unless_zero("temperature", 0.0), _unless_zero("top_p", 0.0), _unless_zero("n", 0),
            _unless_zero("stream", False), F.when(F.size("stop") > 0, F.col("stop")).alias("stop"),
            _unless_zero("max_tokens", 0), _unless_zero("user", "")]
    return said.select("conv_id", F.to_json(F.struct(*fields)).alias("request"))


def build_worker_requests(
    messages: DataFrame, model: str, options: DataFrame, max_bytes: int = MAX_HISTORY_BYTES,
    chunk: int = CHUNK,
) -> DataFrame:
    """One document per conversation for a model worker: its prompt and all options a worker takes.

    ``options`` is as for ``build_requests``, with its defaults filled in; what is missing is 0 or false.
    """
    def given(name: str, default: object) -> Column:
        return F.coalesce(F.col(name), F.lit(default))

    asked = build_prompts(messages, max_bytes, chunk).join(options, "conv_id", "left")
    return asked.select("conv_id", F.to_json(F.struct(
        F.lit(model).alias("model"), "prompt", given("temperature", 0.0).alias("temperature"),
        given("top_p", 0.0).alias("top_p"), given("max_tokens", 0).alias("max_new_tokens"),
        given("stream", False).alias("stream"))).alias("request"))


def truncate_tokens(df: DataFrame, col: str, context_len: int, max_new: int) -> DataFrame:
    """Token array cut on the left so that the reply still fits the context."""
    return df.withColumn(col, keep_tail(F.col(col), context_len - max_new - 1))


def count_tokens(df: DataFrame, col: str, pattern: str = r"\S+") -> DataFrame:
    """Adds ``tokens``, the number of pattern matches in the text."""
    return df.withColumn("tokens", token_count(F.col(col), pattern).cast("bigint"))


# --- complete responses --------------------------------------------------------------------------

def parse_responses(df: DataFrame, json_col: str = "body") -> DataFrame:
    """One row per choice of each response; a response without choices keeps one row."""
    keep = [c for c in df.columns if c != json_col]
    return (
        df.select(*keep, F.from_json(json_col, RESPONSE).alias("r"))
        .select(*keep, F.col("r.id").alias("response_id"), "r.created", "r.usage.*",
                F.explode_outer("r.choices").alias("c"))
        .select(*keep, "response_id", "created", "prompt_tokens", "completion_tokens",
                "total_tokens",
                # a first choice may leave out its index
                F.when(F.col("c").isNotNull(), F.coalesce("c.index", F.lit(0))).alias("choice"),
                "c.finish_reason",
                F.coalesce("c.message.role", "c.delta.role").alias("role"),
                F.coalesce("c.message.content", "c.delta.content", "c.text").alias("content")))


def join_choices(df: DataFrame, json_col: str = "body") -> DataFrame:
    """Adds ``text``, the messages of all choices of a response joined in order."""
    choices = F.from_json(json_col, RESPONSE)["choices"]
    return df.withColumn("text", F.coalesce(
        F.array_join(F.transform(choices, lambda c: c["message"]["content"]), ""), F.lit("")))


def usage_summary(responses: DataFrame, by: Sequence[str]) -> DataFrame:
    """Token totals per group from prompt_tokens, completion_tokens and total_tokens."""
    return responses.groupBy(*by).agg(
        F.count("*").alias("replies"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c)
          for c in ("prompt_tokens", "completion_tokens", "total_tokens")])


def strip_echo(df: DataFrame, prompt: str = "prompt", text: str = "text") -> DataFrame:
    """Text without the prompt it begins with; other text is left alone."""
    return df.withColumn(text, F.when(
        F.startswith(F.col(text), F.col(prompt)),
        F.substr(F.col(text), F.length(F.col(prompt)) + 1)).otherwise(F.col(text)))


def cut_at_stop(df: DataFrame, col: str, stops: Sequence[str]) -> DataFrame:
    """Text cut at its stop sequence, with ``stopped`` and ``partial``."""
    cut = df.withColumn("_cut", stop_cut(F.col(col), stops))
    return cut.withColumn(col, F.col("_cut.text")).withColumn(
        "stopped", F.col("_cut.stopped")).withColumn("partial", F.col("_cut.partial")).drop("_cut")


def finish_reason(df: DataFrame) -> DataFrame:
    """``length`` at the token limit, else ``stop`` when stopped, else NULL.

    Reads completion_tokens, max_new_tokens and stopped; the limit is reached at its last step.
    """
    return df.withColumn("finish_reason", F.when(
        F.col("completion_tokens") == F.col("max_new_tokens") - 1, F.lit("length")
    ).when(F.col("stopped"), F.lit("stop")))


# --- reply streams -------------------------------------------------------------------------------

_CORRUPT = "_corrupt_record"


def _parse(json: Column, schema: T.StructType) -> Column:
    return F.from_json(json, T.StructType([*schema, T.StructField(_CORRUPT, T.StringType())]),
                       {"columnNameOfCorruptRecord": _CORRUPT})


def _frame(kind: Column, text: Column, finish: Column, usage: Column, error: Column) -> Column:
    return F.struct(kind.alias("kind"), text.alias("text"),
                    F.nullif(finish, F.lit("")).alias("finish_reason"), usage.alias("usage"),
                    error.alias("error"))


def _worker_frame(body: Column) -> Column:
    broken = body[_CORRUPT].isNotNull()
    failed = broken | (F.coalesce(body["error_code"], F.lit(0)) != 0)
    final = F.coalesce(body["finish_reason"], F.lit("")) != ""
    return _frame(
        F.when(failed, F.lit("error")).when(final, F.lit("final")).otherwise(F.lit("delta")),
        F.when(~failed, body["text"]), F.when(~failed, body["finish_reason"]),
        F.when(~failed, body["usage"]),
        F.when(broken, F.lit("malformed frame")).when(failed, body["text"]))


def _data_line(done: Column, body: Column) -> Column:
    choice = F.get(body["choices"], F.lit(0))
    failed = ~done & body[_CORRUPT].isNotNull()
    good = ~done & ~failed
    return _frame(
        F.when(done, F.lit("done")).when(failed, F.lit("error"))
        .when(choice["message"].isNotNull(), F.lit("final")).otherwise(F.lit("delta")),
        F.when(good, F.coalesce(
            choice["message"]["content"], choice["delta"]["content"], choice["text"])),
        F.when(good, choice["finish_reason"]), F.when(good, body["usage"]),
        F.when(failed, F.lit("malformed frame")))


def whole_frames(df: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Rows (request_id, seq, raw) that hold whole frames, from pieces cut anywhere, in order of seq.

    What follows the last frame end of a row goes to the next row with a frame end, together with the
    rows between. Frame ends are counted in chunks first, so a long stream spreads over tasks.
    """
    pieces = df.select(
        "request_id", "seq", "raw", F.floor(F.col("seq") / chunk).alias("chunk"),
        F.contains("raw", F.lit(NUL)).cast("bigint").alias("nuls"),
        F.contains("raw", F.lit("\n")).cast("bigint").alias("lines"))
    stream = Window.partitionBy("request_id")
    earlier = stream.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = pieces.groupBy("request_id", "chunk").agg(F.sum("nuls").alias("n"), F.sum("lines").alias("l"))
    counts = counts.withColumn("is_nul", F.max("n").over(stream) > 0)
    counts = counts.select("request_id", "chunk", "is_nul", F.coalesce(F.sum(
        F.when(F.col("is_nul"), F.col("n")).otherwise(F.col("l"))).over(earlier), F.lit(0)).alias("ends"))
    inside = Window.partitionBy("request_id", "chunk").orderBy("seq").rowsBetween(
        Window.unboundedPreceding, -1)
    is_nul = F.col("is_nul")
    rows = pieces.join(counts, ["request_id", "chunk"]).withColumn(
        "ending", F.when(is_nul, F.col("nuls")).otherwise(F.col("lines"))).withColumn(
        "place", F.col("ends") + F.coalesce(F.sum("ending").over(inside), F.lit(0))).withColumn(
        "cut", F.when(F.col("ending") == 0, F.length("raw")).when(is_nul, last_position(
            F.col("raw"), NUL) + 1).otherwise(last_position(F.col("raw"), "\n") + 1))

    def part(number: int, text: Column) -> Column:
        return F.struct((F.col("place") + number).alias("place"), F.col("seq"),
                        F.lit(number).alias("part"), text.alias("text"))

    parts = F.array(part(0, F.substring("raw", F.lit(1), F.col("cut"))),
                    part(1, F.substr("raw", F.col("cut") + 1)))
    return rows.select("request_id", F.inline(F.filter(parts, lambda p: p["text"] != ""))).groupBy(
        "request_id", "place").agg(
        F.max(F.col("seq") + F.col("part")).alias("seq"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "part", "text"))),
                                 lambda p: p["text"]), "").alias("raw")).select("request_id", "seq", "raw")


def split_frames(df: DataFrame) -> DataFrame:
    """Every frame of df(request_id, seq, raw), terminal or not, in (seq, pos).

    ``raw`` holds whole frames (see ``whole_frames``), either JSON each ended by NUL or lines starting with ``data: ``.
    Text after the last NUL, blank lines and other lines are not frames.
    """
    keep = [c for c in df.columns if c != "raw"]
    by_nul = F.split("raw", NUL, -1)
    lines = F.filter(F.split("raw", "\r?\n", -1), lambda s: F.startswith(s, F.lit(DATA_PREFIX)))
    is_nul, done = F.col("is_nul"), F.col("done")
    pieces = F.when(is_nul, F.slice(by_nul, F.lit(1), F.size(by_nul) - 1)).otherwise(lines)
    # parsed bodies are columns of their own so that each frame is parsed once
    return (
        df.withColumn("is_nul", F.contains("raw", F.lit(NUL)))
        .select(*keep, "is_nul", F.posexplode(pieces).alias("pos", "piece"))
        .withColumn("done", ~is_nul & F.endswith("piece", F.lit(DONE)))
        .withColumn("worker", F.when(is_nul, _parse(F.col("piece"), WORKER_FRAME)))
        .withColumn("data", F.when(~is_nul & ~done, _parse(
            F.substr("piece", F.lit(len(DATA_PREFIX) + 1)), RESPONSE)))
        .select(*keep, "pos", F.when(is_nul, _worker_frame(F.col("worker"))).otherwise(
            _data_line(done, F.col("data"))).alias("f"))
        .select(*keep, "pos", "f.*"))


def _is_end(kind: Column) -> Column:
    return kind.isin("done", "error")


def _reply_chunks(df: DataFrame, chunk: int) -> DataFrame:
    """(request_id, chunk, items): frames up to and including the first that ends the reply.

    Each chunk is cut at its own first end before chunks of a reply meet; then chunks after an ended
    one are dropped.
    """
    item = F.struct("seq", "pos", "kind", "text", "finish_reason", "usage", "error")
    chunks = _chunks(split_frames(df), "request_id", "seq", item, chunk)
    ends = F.transform("items", lambda m: _is_end(m["kind"]))
    first_end = F.array_position(ends, True)
    chunks = chunks.withColumn("ended", first_end > 0).withColumn("items", F.when(
        F.col("ended"), F.slice("items", F.lit(1), first_end.cast("int"))).otherwise(F.col("items")))
    earlier = Window.partitionBy("request_id").orderBy("chunk").rowsBetween(
        Window.unboundedPreceding, -1)
    return chunks.withColumn("over", F.coalesce(F.max("ended").over(earlier), F.lit(False))).filter(
        ~F.col("over")).drop("over")


def parse_frames(df: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Frames of each reply up to the one that ends it; see ``split_frames`` for the input."""
    return _reply_chunks(df, chunk).select("request_id", F.explode("items").alias("m")).select(
        "request_id", "m.seq", "m.pos", "m.kind", "m.text", "m.finish_reason",
        "m.usage.prompt_tokens", "m.usage.completion_tokens", "m.usage.total_tokens", "m.error")


def assemble_replies(df: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per reply: joined deltas, final message, last usage and finish reason, error.

    Deltas are joined inside each chunk first, so a reply gathers few short rows.
    """
    def joined(kind: str) -> Column:
        return F.array_join(F.transform(
            F.filter("items", lambda m: m["kind"] == kind), lambda m: m["text"]), "")

    def last(field: str) -> Column:
        return F.get(F.reverse(F.filter("items", lambda m: m[field].isNotNull())), F.lit(0))[field]

    def latest(field: str) -> Column:
        return F.max_by(field, F.when(F.col(field).isNotNull(), F.col("chunk")))

    parts = _reply_chunks(df, chunk).select(
        "request_id", "chunk", "ended", F.size("items").alias("frames"),
        F.struct("chunk", joined("delta").alias("text")).alias("part"),
        F.get(F.reverse(F.filter("items", lambda m: m["kind"] == "final")), F.lit(0))["text"]
        .alias("message"),
        *[last(f).alias(f) for f in ("finish_reason", "usage", "error")])
    replies = parts.groupBy("request_id").agg(
        F.array_join(F.transform(
            F.sort_array(F.collect_list("part")), lambda p: p["text"]), "").alias("text"),
        *[latest(f).alias(f) for f in ("message", "finish_reason", "usage", "error")],
        F.max("ended").alias("ended"), F.sum("frames").alias("frames"))
    return replies.select(
        "request_id", "text", "message", "finish_reason", "usage.prompt_tokens",
        "usage.completion_tokens", "usage.total_tokens", "error", "ended", "frames")
