"""Formatted conversations against plain loops, and the SQL of the query."""

import hashlib
import random

import numpy as np
import pytest
from compare import connect, differences
from hypothesis import given
from hypothesis import strategies as st

from lectern.llm import chat_format as chat
from lectern.llm.queries import QUERIES

NASTY = st.text("<[\\|/s>INST]_imtarepnd \n") | st.sampled_from(
    ["</s>[INST] ok [/INST]", "<|im_end|>", "<\\|im_end|>", "<\\\\|im_start|>", "[\\INST]", "<|im_sep|>"])


@given(st.lists(st.tuples(NASTY, NASTY)))
def test_turns_come_back(turns):
    formatted, _ = chat.render(turns)
    assert chat.parse(formatted) == turns
    assert sum(map(formatted.count, (chat.START, chat.SEP, chat.STOP))) == 3 * len(turns)


def test_escaping_leaves_no_control_string():
    for tail in chat.CONTROL_TAILS:
        text = ("<" if not tail.endswith("]") else "[") + tail
        assert text not in chat.escape(text) and chat.unescape(chat.escape(text)) == text


def test_mask_by_search_equals_a_scan():
    rng = random.Random(2)
    for _ in range(50):
        cuts = sorted(rng.sample(range(1, 60), 12))
        starts, ends = np.array([0, *cuts]), np.array([*cuts, 60])
        edges = sorted(rng.sample(range(61), 6))
        spans = list(zip(edges[::2], edges[1::2]))
        want = [any(s < b and e > a for a, b in spans) for s, e in zip(starts, ends)]
        assert chat.mask(starts, ends, spans).tolist() == want


def expected(rows):
    """Digests by a loop over rows in turn order."""
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append((role or "", text or ""))
    found = {}
    for conv, turns in out.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        found[conv] = (
            len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
            len(loss), hashlib.sha256(loss.encode()).hexdigest(),
            sum(32 + len(chat.escape(r)) + len(chat.escape(t)) for r, t in turns))
    return found


def got(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars)
            for r in df.collect()}


HARD = [
    (1, 0, "user", None), (1, 1, None, "x"), (1, 2, "assistant", ""), (1, 3, "assistant", "  two  spaces\n"),
    (2, 0, "assistant", "日本 👩‍👩‍👧 é"), (2, 1, "assistant", "<|im_end|><\\|im_end|>[/INST]"),
    (3, None, "user", "first"), (3, 5, "assistant", "a" * 5000), (3, 6, "<|im_sep|>", "</s>"),
    (None, 0, "assistant", "of nobody"), (4, 0, "assistant", "\x00\x1c "), (4, 1, "assistant", " ")]


@pytest.mark.parametrize("piece", [1, 40, 1 << 20])
def test_hard_turns(spark, piece, many_partitions):
    df = spark.createDataFrame(
        [(*row, "clash", 1) for row in HARD],
        "conv_id bigint, turn bigint, role string, text string, formatted string, part int").repartition(7)
    pieces = chat.format_conversations(df, piece_chars=piece)
    assert got(chat.conversation_digests(pieces)) == expected(HARD)
    assert chat.conversation_digests(chat.format_conversations(df.limit(0))).collect() == []


def test_one_conversation_over_many_tasks(spark, many_partitions):
    rows = [(9, i, ("user", "assistant")[i % 2], f"text {i} é") for i in range(3000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    pieces = chat.format_conversations(df)
    assert pieces.select("part").distinct().count() > 1
    assert got(chat.conversation_digests(pieces)) == expected(rows)


def test_ids_of_pieces_are_those_of_the_whole(spark):
    from lectern.llm.common import tokenizer_file
    import public_tokenizers

    rows = [(9, i, ("user", "assistant")[i % 2], f" text {i}é ") for i in range(50)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    pieces = chat.format_conversations(df, piece_chars=60).orderBy("part", "piece").collect()
    whole, _ = chat.render([r[2:] for r in rows])
    tokenizer = chat._tokenizer(tokenizer_file(public_tokenizers.path("byte_bpe_50k.json")))
    assert [i for p in pieces for i in p.ids] == tokenizer.encode(whole, add_special_tokens=False).ids


def test_repeated_rows_are_turns(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "assistant", "b")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    assert got(chat.formatted_digests(df)) == expected(rows)


def test_query_gives_the_rows_of_its_sql(spark, data):
    query = QUERIES["op1_chat_format"]
    assert differences(query.run(spark, data), connect(data), query.sql) is None
