"""Chat formatting: conversations rendered whole, encoded once, masked by their offsets.

A turn is ``<|im_start|>`` role ``<|im_sep|>`` text ``<|im_end|>``. The three marks are special tokens,
so no token crosses a mark. Control strings inside roles and texts, those of this template and of other
common ones, get a backslash behind their first character; those that have backslashes there get one
more, so removing one gives the text back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import tokenizer_file, worker_store, written

START, SEP, STOP = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
# Control strings of common chat templates, without their first character.
CONTROL_TAILS = ("|im_start|>", "|im_sep|>", "|im_end|>", "|endoftext|>", "|startoftext|>", "s>", "/s>",
                 "INST]", "/INST]")
TAILS = "|".join(map(re.escape, CONTROL_TAILS))
ESCAPE = re.compile(rf"([<\[])(\\*)({TAILS})")
UNESCAPE = re.compile(rf"([<\[])\\(\\*)({TAILS})")
TURN = re.compile(
    rf"{re.escape(START)}(.*?){re.escape(SEP)}(.*?){re.escape(STOP)}", re.DOTALL)
# A conversation longer than this is rendered in pieces of whole turns; so much is encoded at once.
PIECE_CHARS = 1 << 20
FLUSH_CHARS = 1 << 19
LOSS_ROLE = "assistant"
PIECES = ("conv_id bigint, part bigint, piece bigint, n_turns bigint, formatted string, ids array<int>, "
          "starts array<int>, ends array<int>, loss_mask array<boolean>")
SCHEMA = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int64()), ("piece", pa.int64()), ("n_turns", pa.int64()),
    ("formatted", pa.string()), ("ids", pa.list_(pa.int32())), ("starts", pa.list_(pa.int32())),
    ("ends", pa.list_(pa.int32())), ("loss_mask", pa.list_(pa.bool_()))])


def escape(text: str) -> str:
    return ESCAPE.sub(r"\1\2\\\3", text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1\2\3", text)


def render(turns: Iterable[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text of (role, text) turns, and the spans of what the model shall learn."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEP}", escape(text)
        if role == LOSS_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += (head, body, STOP)
        at += len(head) + len(body) + len(STOP)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    return [(unescape(role), unescape(text)) for role, text in TURN.findall(formatted)]


def mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """True for the tokens that meet a span; both are sorted, so each span is two binary searches."""
    steps = np.zeros(len(starts) + 1, np.int32)
    if spans:
        begin, stop = np.array(spans).T
        np.add.at(steps, np.searchsorted(ends, begin, "right"), 1)
        np.add.at(steps, np.searchsorted(starts, stop, "left"), -1)
    return np.cumsum(steps)[:-1] > 0


def masked_text(formatted: str, starts: np.ndarray, ends: np.ndarray, loss: np.ndarray) -> Iterator[str]:
    """The text under each run of masked tokens, unescaped."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], loss, [False]]).astype(np.int8)))
    for first, behind in edges.reshape(-1, 2):
        yield unescape(formatted[starts[first]:ends[behind - 1]])


def _tokenizer(json: str):
    store, key = worker_store(), ("chat", hashlib.sha256(json.encode()).hexdigest())
    if key not in store:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(json)
        tokenizer.add_special_tokens([START, SEP, STOP])
        tokenizer.no_truncation()
        store[key] = tokenizer
    return store[key]


def format_conversations(turns: DataFrame, tokenizer_path: str | None = None,
                         piece_chars: int = PIECE_CHARS) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as formatted pieces with token ids and loss mask.

    (conv_id, part, piece, n_turns, formatted, ids, starts, ends, loss_mask): offsets count code points
    of ``formatted``. Most conversations are one piece; those beyond ``piece_chars`` and those that the
    range partitioning cuts are several, ordered by (part, piece), and since no token crosses a mark
    their ids are those of the whole. Rows are dealt by ranges of (conversation, turn), so not even one
    conversation with a third of all rows meets in one task. Null roles and texts are empty; rows of one
    turn, or with a null one (first), go by role and the hash of their text; a null conv_id is a
    conversation of its own; repeated rows are turns of their own; other columns are not read.
    """
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    json = turns.sparkSession.sparkContext.broadcast(tokenizer_file(tokenizer_path))

    def encoded(waiting: list[tuple], part: int) -> pa.RecordBatch:
        found = _tokenizer(json.value).encode_batch(
            [text for _, _, _, text, _ in waiting], add_special_tokens=False)
        columns = [[] for _ in range(4)]
        for one, (*_, spans) in zip(found, waiting):
            offsets = np.array(one.offsets, np.int32).reshape(-1, 2)
            starts, ends = offsets.T
            for column, value in zip(columns, (
                    np.array(one.ids, np.int32), starts, ends, mask(starts, ends, spans))):
                column.append(value)
        conv, piece, n, text, _ = zip(*waiting)
        return pa.record_batch([
            pa.array(conv, pa.int64()), pa.array([part] * len(conv), pa.int64()),
            pa.array(piece, pa.int64()), pa.array(n, pa.int64()), pa.array(text, pa.string()),
            *[pa.ListArray.from_arrays(
                np.cumsum([0, *map(len, column)]).astype(np.int32), pa.array(np.concatenate(column)))
              for column in columns]], schema=SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, piece, current, held = TaskContext.get().partitionId(), 0, None, []
        waiting, chars, size = [], 0, 0

        def close() -> None:
            nonlocal piece, held, size
            waiting.append((current, piece, len(held), *render(held)))
            piece, held, size = piece + 1, [], 0

        for batch in batches:
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if held and (conv != current or size >= piece_chars):
                    close()
                    chars += len(waiting[-1][3])
                    if chars >= FLUSH_CHARS or len(waiting) >= 1024:
                        yield encoded(waiting, part)
                        waiting, chars = [], 0
                current = conv
                held.append((role or "", text or ""))
                size += len(text or "")
        if held:
            close()
        if waiting:
            yield encoded(waiting, part)

    rows = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"), F.col("turn").cast("bigint").alias("turn"))
    order = ["conv_id", "turn", "role", F.xxhash64("text")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv_id", "role", "text").mapInArrow(run, PIECES)


def conversation_digests(pieces: DataFrame) -> DataFrame:
    """Per conversation, read back from its pieces: what was formatted and what is under the mask.

    (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens, loss_tokens).
    Pieces stream past in order, so only one piece of a conversation is held.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, out = None, None, []
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars",
                 "n_tokens", "loss_tokens"]

        def result() -> list:
            n, turns, chars, loss, size, tokens, learnt = state
            return [current, n, turns.hexdigest(), chars, loss.hexdigest(), size, tokens, learnt]

        def table(rows: list) -> pa.RecordBatch:
            kinds = [pa.string() if name.endswith("sha256") else pa.int64() for name in names]
            return pa.record_batch(
                [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for i, conv in enumerate(batch.column(0).to_pylist()):
                if state is None or conv != current:
                    if state is not None:
                        out.append(result())
                    current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                formatted = batch.column(1)[i].as_py()
                for role, text in parse(formatted):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                starts, ends = (batch.column(k)[i].values.to_numpy() for k in (2, 3))
                loss = batch.column(4)[i].values.to_numpy(zero_copy_only=False)
                for text in masked_text(formatted, starts, ends, loss):
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += len(formatted)
                state[5] += len(starts)
                state[6] += int(loss.sum())
            if out:
                yield table(out)
                out = []
        if state is not None:
            yield table([result()])

    order = ["conv_id", "part", "piece"]
    return pieces.select(*order, "formatted", "starts", "ends", "loss_mask").repartition(
        "conv_id").sortWithinPartitions(*order).select(
        "conv_id", "formatted", "starts", "ends", "loss_mask").mapInArrow(
        run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, "
        "loss_sha256 string, formatted_chars bigint, n_tokens bigint, loss_tokens bigint")


def formatted_digests(turns: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Formats the conversations, writes the pieces and reads their digests back."""
    return conversation_digests(written(format_conversations(turns, tokenizer_path), "chat"))
