"""Streams fed in several batches, with rows out of order, against the batch forms."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import chat, sessions, status
from lectern.streaming.replies import reply_stream
from lectern.streaming.runs import run_available
from lectern.streaming.sessions import lazy_session_stream, session_stream
from lectern.streaming.status import status_tick_stream

START = datetime.datetime(2024, 1, 1)


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def arrive(spark, folder, batches, schema):
    """A stream of one file per batch."""
    for number, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{number}")
    return (
        spark.readStream.schema(schema).option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", 1).parquet(*[str(folder)]))


@pytest.fixture(scope="module")
def events():
    """Events in time order, moved by less than the watermark."""
    rng = random.Random(11)
    rows, now = [], 0
    for _ in range(900):
        now += rng.choice([1, 20, 59, 61, 400, 1790, 1805]) * rng.random()
        rows.append((rng.randint(1, 6), at(now)))
    order = sorted(rows, key=lambda r: r[1] + datetime.timedelta(seconds=rng.random() * 400))
    end = at(now + 40_000)
    return order + [(9, end)], end - datetime.timedelta(minutes=10)


SCHEMA = "user_id bigint, ts timestamp"


def batches_of(rows, n=4):
    size = len(rows) // n + 1
    return [rows[i:i + size] for i in range(0, len(rows), size)]


def test_lazy_sessions(spark, tmp_path, events):
    rows, _ = events
    stream = lazy_session_stream(arrive(spark, tmp_path, batches_of(rows), SCHEMA), watermark="10 minutes")
    got = run_available(stream, "lazy").filter("user_id < 9").collect()
    want = sessions.sessionize_lazy(spark.createDataFrame(rows, SCHEMA)).filter("user_id < 9").drop("session_no")
    assert sorted(map(tuple, got)) == sorted(map(tuple, want.collect()))


def test_waiting_times_are_read_when_they_are_due(spark, tmp_path):
    """A busy user whose events wait for two hours: batches read no more state as more of them wait."""
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        rows = [(1, at(i * 0.5)) for i in range(12_000)]
        batches = [*batches_of(rows, 12), [(9, at(50_000))]]
        stream = lazy_session_stream(arrive(spark, tmp_path / "in", batches, SCHEMA), watermark="2 hours")
        out = str(tmp_path / "out")
        query = stream.writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    got = spark.read.parquet(out).filter("user_id = 1").collect()
    want = sessions.sessionize_lazy(spark.createDataFrame(rows, SCHEMA)).drop("session_no").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    read = [p.stateOperators[0].customMetrics["rocksdbTotalBytesRead"] for p in query.recentProgress if p.numInputRows][:12]
    steps = [b - a for a, b in zip(read, read[1:])]
    # the index of slots grows by 24 bytes a minute, the events, 8 bytes each, are not read
    assert max(steps[6:]) <= max(steps[:4]) + 6000, read


def test_sessions(spark, tmp_path, events):
    rows, _ = events
    stream = session_stream(arrive(spark, tmp_path, batches_of(rows), SCHEMA), watermark="10 minutes")
    got = run_available(stream, "sessions").filter("user_id < 9").collect()
    want = sessions.sessionize(spark.createDataFrame(rows, SCHEMA)).filter("user_id < 9").drop("session_no")
    assert sorted(map(tuple, got)) == sorted(map(tuple, want.collect()))


def test_late_rows_are_dropped(spark, tmp_path, events):
    rows, clock = events
    # a batch filters by the watermark that the batch before it started with
    late, fresh = [(1, clock - datetime.timedelta(hours=3))], [rows[-1]]
    stream = session_stream(arrive(spark, tmp_path, [rows, fresh, late], SCHEMA), watermark="10 minutes")
    assert run_available(stream, "late").filter("user_id < 9").agg(F.sum("events")).first()[0] == len(rows) - 1


def test_ticks(spark, tmp_path, events):
    rows, clock = events
    scans = [(ts, user % 2 == 0) for user, ts in rows]
    schema = "ts timestamp, ok boolean"
    ticks = run_available(status_tick_stream(
        arrive(spark, tmp_path, batches_of(scans), schema), "1 minute", "10 minutes"), "ticks")
    got = status.running_ticks(ticks).collect()
    want = status.status_ticks(spark.createDataFrame(scans, schema), "1 minute").filter(F.col("tick") <= F.lit(clock))
    assert sorted(map(tuple, got)) == sorted(map(tuple, want.collect()))


def test_a_long_reply_reads_no_more_state_than_a_short_one(spark, tmp_path):
    """3,000 frames in 30 batches, neighbours exchanged, a hole that stays open for ten of them."""
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        order = list(range(3000))
        for i in range(0, 3000, 2):
            order[i:i + 2] = order[i + 1], order[i]
        order.remove(1000)
        order.insert(2000, 1000)
        frames = [(1, i, at(i * 0.01), f'{{"text": "piece {i} ", "error_code": 0}}\0') for i in order]
        frames.append((1, 3000, at(40), '{"text": "", "error_code": 9}\0'))
        schema = "request_id bigint, seq bigint, ts timestamp, raw string"
        stream = reply_stream(arrive(spark, tmp_path / "in", batches_of(frames, 30), schema), 600, "1 minute")
        out = str(tmp_path / "out")
        query = stream.writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    row = spark.read.parquet(out).first()
    assert row.text == "".join(f"piece {i} " for i in range(3000)) and row.ended and row.frames == 3001
    read = [p.stateOperators[0].customMetrics["rocksdbTotalBytesRead"] for p in query.recentProgress if p.numInputRows]
    assert len(read) >= 30
    # the store counts on; the batch that ends the reply reads its text, and late ones before it no more than early ones
    steps = [b - a for a, b in zip(read, read[1:])]
    assert max(sorted(steps[22:28])[:5]) <= 2 * max(steps[2:8]), read


def test_replies(spark, tmp_path):
    """Frames of a reply in several batches and out of order; one reply never ends."""
    frames, rng = [], random.Random(4)
    for reply in range(1, 21):
        parts = [f"part{i} " for i in range(rng.randint(1, 8))]
        raws = [f'{{"text": "{p}", "error_code": 0}}\0' for p in parts]
        if reply % 5 == 0:
            raws.append('{"text": "bad", "error_code": 7}\0')
            raws.append('{"text": "after", "error_code": 0}\0')
        elif reply % 3 == 0:
            raws = [r.replace("\0", "\n\n").replace('{"text"', 'data: {"choices": [{"text"')
                    .replace(', "error_code": 0}', "}]}") for r in raws] + ["data: [DONE]\n\n"]
        else:
            raws.append('{"text": "all", "error_code": 0, "finish_reason": "stop", '
                        '"usage": {"prompt_tokens": 1, "completion_tokens": 2, "total_tokens": 3}}\0')
        frames += [(reply, i, at(reply * 10 + i), raw) for i, raw in enumerate(raws)]
    order = sorted(frames, key=lambda f: f[2] + datetime.timedelta(seconds=rng.random() * 30))
    order.append((99, 0, at(100_000), '{"text": "later", "error_code": 0}\0'))
    schema = "request_id bigint, seq bigint, ts timestamp, raw string"
    stream = reply_stream(arrive(spark, tmp_path, batches_of(order), schema), 600, "1 minute")
    got = {r.request_id: r.asDict() for r in run_available(stream, "replies").collect()}
    want = {r.request_id: r.asDict() for r in chat.assemble_replies(
        spark.createDataFrame(frames, schema).drop("ts")).collect()}
    assert got == want
