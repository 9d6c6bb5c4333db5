"""Conversations and reply streams against plain loops and hand-made cases."""

import json
import random

import pytest

from lectern.operators import chat, requests
from lectern.streaming.replies import assemble


def kept_by_loop(messages, limit):
    """Walk back from the newest message, taking whole units until the limit is reached."""
    total, kept = 0, []
    for i in range(len(messages) - 1, -1, -1):
        role, content = messages[i]
        unit = []
        if i == len(messages) - 1:
            unit = [i] if role == "user" else []
        elif role == "user" and messages[i + 1][0] != "user":
            unit = [i, i + 1]
        kept += unit
        total += sum(len(messages[j][1].encode()) for j in unit)
        if total >= limit:
            break
    return sorted(kept)


def random_conversation(rng, size):
    return [(rng.choice(["user", "user", "assistant", "assistant", "system"]),
             rng.choice(["", "a", "éé", "你好", "x" * rng.randint(1, 40)])) for _ in range(size)]


@pytest.mark.parametrize("chunk", [1, 2, 3, 256])
@pytest.mark.parametrize("limit", [1, 30, 200, 100_000])
def test_cut_history_equals_loop(spark, chunk, limit):
    rng = random.Random(chunk * 1000 + limit)
    talks = {c: random_conversation(rng, rng.randint(1, 25)) for c in range(60)}
    rows = [(c, t, r, m) for c, talk in talks.items() for t, (r, m) in enumerate(talk)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, content string")
    found = {(r.conv_id, r.turn) for r in chat.cut_history(df, limit, chunk).collect()}
    assert found == {(c, t) for c, talk in talks.items() for t in kept_by_loop(talk, limit)}


def test_one_conversation_of_most_rows(spark):
    rng = random.Random(5)
    talk = random_conversation(rng, 5000)
    rows = [(1, t, r, m) for t, (r, m) in enumerate(talk)] + [(2, 0, "user", "hi")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, content string")
    found = sorted(r.turn for r in chat.cut_history(df, 20_000).filter("conv_id = 1").collect())
    assert found == kept_by_loop(talk, 20_000)


def test_unit_that_crosses_the_limit_is_kept(spark):
    rows = [(1, 0, "user", "aa"), (1, 1, "assistant", "bb"), (1, 2, "user", "cccc"),
            (1, 3, "assistant", "dddd"), (1, 4, "user", "ee")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, content string")
    turns = lambda n: sorted(r.turn for r in chat.cut_history(df, n).collect())
    assert turns(2) == [4]
    assert turns(3) == [2, 3, 4]
    assert turns(10) == [2, 3, 4]
    assert turns(11) == [0, 1, 2, 3, 4]


def test_prompt_text(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "r"), (1, 3, "user", ""),
            (1, 4, "assistant", "z"), (1, 5, "user", "last"), (2, 0, "system", "only")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, content string")
    prompts = {r.conv_id: r.prompt for r in chat.build_prompts(df).collect()}
    assert prompts[1] == "你是一个助手。USER: q ASSISTANT: r</s>ASSISTANT: z</s>USER: last ASSISTANT: "
    assert prompts[2] == "你是一个助手。ASSISTANT: "


def nul(text="", code=0, finish=None, usage=None):
    body = {"text": text, "error_code": code}
    if finish:
        body["finish_reason"] = finish
    if usage:
        body["usage"] = dict(zip(("prompt_tokens", "completion_tokens", "total_tokens"), usage))
    return json.dumps(body) + "\0"


def data_line(content, finish=None):
    choice = {"index": 0, "delta": {"role": "assistant", "content": content}}
    if finish:
        choice["finish_reason"] = finish
    return "data: " + json.dumps({"choices": [choice]}) + "\n\n"


FRAMES = [
    (1, 1, nul("b") + nul("c")), (1, 0, nul("a")), (1, 2, nul("abc", finish="stop", usage=(1, 3, 4))),
    (2, 0, nul("x")), (2, 1, nul("boom", code=50002)), (2, 2, nul("ignored")),
    (3, 0, data_line("he") + ": note\n" + data_line("llo", "stop")), (3, 1, "data: [DONE]\n\n"),
    (3, 2, data_line("ignored")),
    (4, 0, nul("cut") + '{"text": "no end'),
    (5, 0, nul("p")), (5, 1, "{broken\0" + nul("ignored")),
    (6, 0, "data: {broken\n\n" + data_line("ignored")),
]


@pytest.mark.parametrize("chunk", [1, 2, 256])
def test_replies(spark, chunk):
    df = spark.createDataFrame(FRAMES, "request_id bigint, seq bigint, raw string")
    got = {r.request_id: r for r in chat.assemble_replies(df, chunk).collect()}
    assert (got[1].text, got[1].message, got[1].finish_reason, got[1].total_tokens) == ("abc", "abc", "stop", 4)
    assert (got[2].text, got[2].error, got[2].ended, got[2].frames) == ("x", "boom", True, 2)
    assert (got[3].text, got[3].finish_reason, got[3].frames) == ("hello", "stop", 3)
    assert (got[4].text, got[4].ended) == ("cut", False)
    assert (got[5].text, got[5].error) == ("p", "malformed frame")
    assert (got[6].text, got[6].error, got[6].frames) == ("", "malformed frame", 1)
    kinds = [(r.request_id, r.seq, r.pos, r.kind) for r in chat.parse_frames(df, chunk).collect()]
    assert sorted(k for k in kinds if k[0] == 2) == [(2, 0, 0, "delta"), (2, 1, 0, "error")]
    assert len(kinds) == sum(r.frames for r in got.values())


def test_one_reply_of_most_frames(spark):
    frames = [(1, i, nul(f"{i},")) for i in range(4000)]
    frames[3000] = (1, 3000, nul("stopped", code=1))
    df = spark.createDataFrame(frames + [(2, 0, nul("x"))], "request_id bigint, seq bigint, raw string")
    reply = chat.assemble_replies(df.repartition(7)).filter("request_id = 1").first()
    assert reply.text == "".join(f"{i}," for i in range(3000))
    assert (reply.error, reply.frames) == ("stopped", 3001)


def test_streaming_assembly_equals_batch(spark):
    df = spark.createDataFrame(FRAMES, "request_id bigint, seq bigint, raw string")
    rows = chat.split_frames(df).select("request_id", "seq", "pos", "kind", "text", "finish_reason",
                                        "usage.*", "error").collect()
    for reply in chat.assemble_replies(df).collect():
        loop = assemble([tuple(r)[1:] for r in rows if r.request_id == reply.request_id])
        assert loop == {k: v for k, v in reply.asDict().items() if k != "request_id"}


def stop_by_loop(text, stops):
    for stop in stops:
        place = text.rfind(stop)
        if place != -1:
            return text[:place], True, False
        if any(text.endswith(stop[:n]) for n in range(1, len(stop) + 1)):
            return text, False, True
    return text, False, False


def test_stops(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("aab#é") for _ in range(rng.randint(0, 12))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    for stops in (["aa"], ["##", "ab"], ["é#", "b", "aab"]):
        got = chat.cut_at_stop(df, "text", stops).orderBy("id").collect()
        assert [(r.text, r.stopped, r.partial) for r in got] == [stop_by_loop(t, stops) for t in texts]


def test_truncate_and_echo(spark):
    df = spark.createDataFrame([(1, [1, 2, 3, 4]), (2, [1]), (3, [])], "id int, tokens array<int>")
    kept = [r.tokens for r in chat.truncate_tokens(df, "tokens", 5, 2).orderBy("id").collect()]
    assert kept == [[3, 4], [1], []]
    with pytest.raises(ValueError):
        chat.truncate_tokens(df, "tokens", 3, 2)
    echo = spark.createDataFrame([("ab", "abc"), ("ab", "xab"), ("é", "é")], "prompt string, text string")
    assert [r.text for r in chat.strip_echo(echo).collect()] == ["c", "xab", ""]


def test_inputs(spark):
    df = spark.createDataFrame(
        [(1, '"x"'), (2, '["x","y"]'), (3, "5"), (4, "{}"), (5, "[]"), (6, "[1]"), (7, "nonsense"), (8, None)],
        "id int, input string")
    errors = {r.id: r.error for r in requests.validate_inputs(df).collect()}
    assert [i for i, e in errors.items() if e is None] == [1, 2, 5]
    rows = sorted((r.id, r["index"], r.text) for r in requests.explode_inputs(df).collect())
    assert rows == [(1, 0, "x"), (2, 0, "x"), (2, 1, "y")]


def test_failing_model_call_stays_with_its_row(spark):
    def model(prompts):
        if any(p == "bad" for p in prompts):
            raise ValueError("no")
        return [{"text": p + "!", "total_tokens": 1} for p in prompts]

    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "c")], "id bigint, prompt string").coalesce(1)
    got = {r.id: (r.text, r.error) for r in requests.complete_batch(df, model, "id").collect()}
    assert got == {1: ("a!", None), 2: (None, "no"), 3: ("c!", None)}


def test_failing_embedder_stays_with_its_row(spark):
    def embedder(texts):
        return [[1.0 / len(t)] for t in texts]

    df = spark.createDataFrame([(1, "ab"), (2, ""), (3, "abcd")], "id bigint, text string").coalesce(1)
    got = {r.id: (r.embedding, r.error) for r in requests.embed_batch(df, embedder, "id").collect()}
    assert got == {1: ([0.5], None), 2: (None, "float division by zero"), 3: ([0.25], None)}


def test_endpoints():
    given = ["http://a:1/", "x", "https://b", "://c", "http://d/x/?q=1", "http://[bad"]
    assert requests.valid_endpoints(given) == ["http://a:1", "https://b", "http://d/x?q=1"]


def test_responses(spark):
    body = {"id": "r", "created": 3, "usage": {"prompt_tokens": 1, "completion_tokens": 2, "total_tokens": 3},
            "choices": [{"message": {"role": "assistant", "content": "a"}}, {"index": 1, "text": "b"}]}
    df = spark.createDataFrame([(1, json.dumps(body)), (2, "{}"), (3, "broken")], "request_id int, body string")
    rows = chat.parse_responses(df).orderBy("request_id", "choice").collect()
    assert [(r.request_id, r.choice, r.content, r.total_tokens) for r in rows] == [
        (1, 0, "a", 3), (1, 1, "b", 3), (2, None, None, None), (3, None, None, None)]
    assert [r.text for r in chat.join_choices(df).orderBy("request_id").collect()] == ["a", "", ""]
    totals = chat.usage_summary(chat.parse_responses(df), ["request_id"]).orderBy("request_id").collect()
    assert [(r.replies, r.total_tokens) for r in totals] == [(2, 6), (1, 0), (1, 0)]


def test_a_turn_of_very_many_rows_is_cut_into_chunks(spark):
    """Turns that repeat or are null: no array holds more than a chunk, and what is kept is the same."""
    rows = [(1, 5, "user" if i % 2 else "assistant", f"m{i:04d}") for i in range(900)]
    rows += [(1, None, "user", f"n{i:04d}") for i in range(300)] + [(2, i, "user", "x") for i in range(20)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, content string").repartition(4)
    from pyspark.sql import functions as F

    item = F.struct("turn", "role", "content")
    chunks = chat._chunks(df, "conv_id", "turn", item, 64).collect()
    assert max(len(r["items"]) for r in chunks) <= 64 and sum(len(r["items"]) for r in chunks) == len(rows)
    in_order = [x for r in sorted((r for r in chunks if r.conv_id == 1), key=lambda r: (
        r.chunk.slot is not None, r.chunk.slot or 0, r.chunk.part)) for x in r["items"]]
    assert [tuple(x) for x in in_order] == sorted(
        (r[1:] for r in rows if r[0] == 1), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    whole = chat.cut_history(df, 400, 100_000).collect()
    assert sorted(map(str, chat.cut_history(df, 400, 64).collect())) == sorted(map(str, whole)) and whole
