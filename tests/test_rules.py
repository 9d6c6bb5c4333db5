"""Cases that the given tables do not hold."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lectern.functions.text import contains_text
from lectern.operators import catalog, chat, ingest, progress, speech, vectors
from lectern.plans import views
from lectern.sources.speakers import load_speakers, save_speakers

SPEAKER = "audio_id string, gender int, default_type int, display_name string, description string, avatar_url string, path string"


def test_requests_hold_every_message(spark):
    said = [("system", "be kind"), ("user", "a"), ("assistant", ""), ("assistant", "b" * 9000), ("user", "c")]
    df = spark.createDataFrame(
        [(1, i, r, t) for i, (r, t) in enumerate(said)] + [(2, 0, "user", None)],
        "conv_id bigint, turn bigint, role string, content string")
    options = spark.createDataFrame(
        [(1, 0.5, 0.0, 1, True, ["x"], 512, "")],
        "conv_id bigint, temperature double, top_p double, n int, stream boolean, stop array<string>, "
        "max_tokens int, user string")
    got = {r.conv_id: json.loads(r.request) for r in chat.build_requests(df, "m", options, chunk=2).collect()}
    assert got[1] == {
        "model": "m", "messages": [{"role": r, "content": t} for r, t in said], "temperature": 0.5, "n": 1,
        "stream": True, "stop": ["x"], "max_tokens": 512}
    assert got[2] == {"model": "m", "messages": [{"role": "user", "content": ""}]}
    cut = json.loads(chat.build_requests(df, "m", max_bytes=100).filter("conv_id = 1").first().request)
    assert len(cut["messages"]) < len(said)
    worker = json.loads(chat.build_worker_requests(df, "m", options).filter("conv_id = 2").first().request)
    assert worker.pop("prompt").endswith("ASSISTANT: ")
    assert worker == {"model": "m", "temperature": 0.0, "top_p": 0.0, "max_new_tokens": 0, "stream": False}


def test_frames_cut_anywhere(spark):
    rng = random.Random(1)
    streams = {
        1: '{"text":"hel","error_code":0}\0{"text":"lo","error_code":0}\0', 2: 'data: {oops\n\n',
        3: 'data: {"choices":[{"index":0,"delta":{"content":"a"}}]}\n\ndata: [DONE]\n\n',
        4: '{"text":"whole","error_code":0}\0{"text":"rest'}
    whole = spark.createDataFrame([(k, 0, raw) for k, raw in streams.items()], "request_id bigint, seq bigint, raw string")
    want = sorted(map(str, chat.assemble_replies(whole).collect()))
    for size in (1, 2, 7, 1000):
        rows = []
        for key, raw in streams.items():
            at, seq = 0, 0
            while at < len(raw):
                step = rng.randint(1, size)
                rows.append((key, seq, raw[at:at + step]))
                at, seq = at + step, seq + 1
        df = spark.createDataFrame(rows, "request_id bigint, seq bigint, raw string").repartition(5)
        for chunk in (2, 256):
            got = chat.assemble_replies(chat.whole_frames(df, chunk), chunk).collect()
            assert sorted(map(str, got)) == want


def test_any_number_of_omitted_ids(spark):
    books = spark.range(1, 1100).select(
        "id", F.lit(0).alias("count_visit"), F.lit(None).cast("timestamp").alias("ctime"))
    assert [r.id for r in catalog.recent_books(books, 5, list(range(1, 1096))).collect()] == [1096, 1097, 1098, 1099]
    assert len(catalog.random_books(books, 5, []).collect()) == 5


def test_pages_after_an_id(spark):
    books = spark.range(10).select("id", F.lit("t").alias("title"), F.lit("a").alias("author"))
    assert [r.id for r in catalog.search_books(books, page_size=3, after_id=4).collect()] == [5, 6, 7]


def test_backslash_in_a_search(spark):
    df = spark.createDataFrame([("a\\b_c",), ("abxc",)], "t string")
    match = lambda q: [r.t for r in df.filter(contains_text(F.col("t"), q, wildcards=True)).collect()]
    assert match("\\b") == ["a\\b_c"] and match("b_c") == ["a\\b_c", "abxc"] and match("\\") == ["a\\b_c"]


def test_vector_of_another_size_fails(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0, 3.0])], "k int, v array<double>")
    with pytest.raises(Exception, match="not of size 2"):
        vectors.mean_pool(df, "k", "v", dim=2).collect()
    assert vectors.mean_pool(df, "k", "v").first()["mean"] == [1.0, 2.0, 3.0]


def test_samples_wrap(spark):
    df = spark.createDataFrame([([1.0, -1.0, 1.01, -1.1, 3.5, float("nan"), None],)], "v array<float>")
    wrap = lambda n: (n + 32768) % 65536 - 32768
    assert vectors.quantize_int16(df, "v").first().v == [32767, -32767, wrap(33094), wrap(-36043), wrap(114684), 0, 0]


def test_repeated_speakers_do_not_multiply_jobs(spark):
    texts = spark.createDataFrame([(1, "hi", "", "a"), (2, "ho", "en", "b")], "id bigint, text string, lang string, audio_id string")
    speakers = spark.createDataFrame([("a", "x.wav"), ("a", "y.wav")], "audio_id string, path string")
    got = speech.assign_speaker(texts, speakers).orderBy("id").collect()
    assert [(r.id, r.voice_path) for r in got] == [(1, "y.wav"), (2, speech.DEFAULT_VOICE_PATH)]
    old = spark.createDataFrame([("a", "0"), ("c", "0")], "audio_id string, path string")
    assert sorted(map(tuple, speech.add_speakers(old, speakers).collect())) == [("a", "y.wav"), ("c", "0")]
    placed = spark.createDataFrame([("a", "late", 2), ("a", "z", 1)], "audio_id string, path string, at int")
    assert sorted(map(tuple, speech.add_speakers(old, placed, "at").collect())) == [("a", "late"), ("c", "0")]


def test_registry_files_in_order_of_names(spark, tmp_path):
    def entry(i, name, text=""):
        return {"audio_id": i, "gender": 1, "default_type": 1, "display_name": name, "description": text,
                "avatar_url": "", "path": "p"}

    (tmp_path / "a.json").write_text(json.dumps([entry("x", "first"), entry("y", "one"), entry("y", "two")]))
    (tmp_path / "b.json").write_text(json.dumps([entry("x", "last", "long " * 5000)]))
    found = load_speakers(spark, str(tmp_path / "*.json"))
    assert {r.audio_id: r.display_name for r in found.collect()} == {"x": "last", "y": "two"}
    save_speakers(found, str(tmp_path / "saved"))
    again = load_speakers(spark, str(tmp_path / "saved"), multi_line=False)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, found.collect()))


def test_markup_entities_and_language_forms(spark):
    pages = spark.createDataFrame([
        (1, "u", "<html lang='de'><title>a &amp; b &lt;&#39;&quot;&amp;lt;</title>"),
        (2, "u", "<HTML class=x LANG=fr dir='l'><title></title>"), (3, "u", '<html data-lang="no">'),
        (4, "u", '<html\nlang = "es">'), (5, "u", None)], "page_id bigint, url string, html string")
    got = {r.page_id: (r.title, r.language) for r in ingest.markup_metadata(pages).collect()}
    assert got == {1: ("a & b <'\"&lt;", "de"), 2: ("", "fr"), 3: ("", ""), 4: ("", "es"), 5: ("", "")}


def test_a_noncharacter_is_text(spark):
    text = "ab﷐, " * 14
    df = spark.createDataFrame([(1, text)], "id bigint, text string")
    assert ",".join(r.segment for r in speech.segment_text(df).orderBy("seg_idx").collect()) == text


def test_first_rows_win_with_null_orders(spark):
    old = spark.createDataFrame([("a", 1)], "k string, o int")
    new = spark.createDataFrame([("a", 0), ("b", 2), ("b", 1), ("c", None), (None, 3)], "k string, o int")
    got = ingest.insert_new(old, new, "k", ["o"]).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [("a", 1), ("b", 1), ("c", None), (None, 3)]))


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]


def test_progress_is_hashed_and_worked_out_once(spark, data):
    events = views.progress_events(spark, data)
    table = progress.upsert_progress(None, events)
    plan = executed(progress.upsert_progress(table, events))
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    shelves = executed(progress.all_shelves(
        views.books(spark, data), progress.upsert_favs(views.fav_events(spark, data)), table))
    assert "SortAggregate" not in shelves and "ReusedExchange" in shelves
