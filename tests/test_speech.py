"""Segments against a plain loop, speakers, vectors."""

import json
import random
import re

from lectern.operators import speech, vectors
from lectern.sources.speakers import load_speakers


def segments_by_loop(text):
    if len(text) < 50:
        return [text]
    ends = "。！？!?.…；;"
    pieces = []
    for sentence in re.findall(f"[^{ends}]*[{ends}]+|[^{ends}]+", text):
        if len(sentence) <= 50:
            pieces.append(sentence)
            continue
        for part in re.split("[，,]", sentence):
            half = len(part) // 2
            pieces += [part[:half], part[half:]] if len(part) > 50 else [part]
    out = [pieces[0]]
    for piece in pieces[1:]:
        if len(out[-1]) + len(piece) + 1 <= 20:
            out[-1] += "," + piece
        else:
            out.append(piece)
    return out


def test_segments_equal_loop(spark):
    rng = random.Random(3)
    texts = ["", "a" * 49, "a" * 50, "a" * 51, "a" * 101, "。" * 60, "，" * 60, ",," + "b" * 60 + ","]
    for _ in range(400):
        letters = rng.choice(["ab ", "你好é\U0001f600", "a,，"])
        marks = rng.choice([".", "。！", ";…?", ",，."])
        texts.append("".join(
            rng.choice(letters) if rng.random() < rng.choice([0.8, 0.95, 0.99]) else rng.choice(marks)
            for _ in range(rng.randint(40, 400))))
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    found = {}
    for r in speech.segment_text(df).orderBy("id", "seg_idx").collect():
        found.setdefault(r.id, []).append(r.segment)
    assert found == {i: segments_by_loop(t) for i, t in enumerate(texts)}


def test_given_documents_equal_loop(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").withColumnRenamed("doc_id", "id")
    found = {}
    for r in speech.segment_text(docs).orderBy("id", "seg_idx").collect():
        found.setdefault(r.id, []).append(r.segment)
    assert found == {r.id: segments_by_loop(r.text) for r in docs.collect()}


def test_speaker_registry(spark, tmp_path):
    path = tmp_path / "speakers.json"
    path.write_text(json.dumps([
        {"audio_id": "a", "path": "1.wav", "default_type": 1}, {"audio_id": "b", "path": "2.wav"},
        {"audio_id": "a", "path": "3.wav"}], indent=2))
    speakers = load_speakers(spark, str(path))
    assert {r.audio_id: r.path for r in speakers.collect()} == {"a": "3.wav", "b": "2.wav"}
    texts = spark.createDataFrame(
        [(1, "hello", None, "a"), (2, "hi", "en", "nobody")], "id int, text string, lang string, audio_id string")
    jobs = {r.id: (r.lang, r.voice_path, r.segment) for r in speech.speech_jobs(texts, speakers).collect()}
    assert jobs == {1: ("zh-cn", "3.wav", "hello"), 2: ("en", "female-0-100.wav", "hi")}


def test_vectors(spark):
    rows = [(1, [3.0, 0.0], 1), (1, [3.0, 8.0], 1), (1, [100.0, 100.0], 0), (2, [0.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "k int, v array<float>, m int")
    for dim in (None, 2):
        pooled = vectors.mean_pool(df, "k", "v", "m", dim)
        assert {r.k: (r.token_num, r["mean"]) for r in pooled.collect()} == {1: (2, [3.0, 4.0]), 2: (1, [0.0, 0.0])}
        unit = {r.k: r["mean"] for r in vectors.l2_normalize(pooled, "mean").collect()}
        assert unit == {1: [0.6, 0.8], 2: [0.0, 0.0]}
    samples = spark.createDataFrame([([-1.0, 1.0, 0.00005, -0.00005],)], "v array<float>")
    assert vectors.quantize_int16(samples, "v").first().v == [-32767, 32767, 1, -1]
