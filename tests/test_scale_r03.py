"""What the work of larger tables must not do: held batches, parses, state calls and processes for each row."""

import os
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from lectern.operators import ingest, requests
from lectern.operators.sessions import LazyFollower
from lectern.plans import intake, live
from lectern.plans import views as v
from lectern.sources import library, texts
from lectern.streaming import sessions

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_text_file_for_each_row(spark, tmp_path):
    """The folders and bytes of Spark's own writer, listed by few tasks; no checksum file beside each one."""
    rows = [(f"s{i % 3}", f"text {i}\nof é") for i in range(300)]
    rows += [(None, "none"), ("", "empty"), ("a/b=c", None), ("a/b=c", ""), ("a/b=c", "")]
    df = spark.createDataFrame(rows, "source string, text string").repartition(4)
    texts.write_texts(df, str(tmp_path / "ours"), "source")
    df.write.partitionBy("source").option("maxRecordsPerFile", 1).text(str(tmp_path / "sparks"))

    def found(root):
        return Counter((f.parent.name, f.read_bytes()) for f in root.rglob("*.txt"))

    assert found(tmp_path / "ours") == found(tmp_path / "sparks") and sum(found(tmp_path / "ours").values()) == 305
    assert not [f for f in os.listdir(tmp_path / "ours" / "source=s1") if f.startswith(".")]
    cost = spark.conf.get(library.OPEN_COST)
    listing = library.scan_library(spark, str(tmp_path / "ours"), "*.txt")
    assert listing.count() == 305 and listing.rdd.getNumPartitions() <= 10
    assert spark.conf.get(library.OPEN_COST) == cost


def test_files_of_both_batches_are_made_once(spark, data, monkeypatch):
    plans = []
    monkeypatch.setattr(live.ingest, "ingest_batch", lambda files, sink, batch: plans.append(plan(files)))
    with pytest.raises(Exception, match="books"):
        live.QUERIES["ingest_batches"].run(spark, data)
    assert len(plans) == 2 and not any("MapIn" in p for p in plans)
    assert "RoundRobinPartitioning" in plan(v.epub_files(spark, data))


def test_covers_are_found_without_parsing_again(spark, data, tmp_path):
    packages = v.packages(spark, data)
    got = ingest.covers_of(packages, str(tmp_path / "books"))
    assert "from_xml" not in plan(got) and "opf_xml" not in plan(got)
    got = intake.QUERIES["covers_round_trip"].run(spark, data)
    assert "xml" not in plan(got) and got.count() == packages.count()


def test_batches_to_python_are_bounded(spark, tmp_path):
    """Texts of 20,000 characters: at most some hundred of them go to Python at once."""
    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.nbytes], pa.int64())], names=["id"])

    df = spark.range(0, 1500, 1, 1).selectExpr("id", "repeat('ab ', 7000) AS prompt")

    def model(prompts):
        return [{"text": str(len(p)), "finish_reason": "stop"} for p in prompts]

    for call in (
            lambda: requests.complete_by_budget(df, model, "id", str(tmp_path / "out"), waves=1).count(),
            lambda: library.read_packages(df.selectExpr(
                "string(id) AS path", "timestamp '2020-01-01' AS modificationTime", "1L AS length",
                "binary(prompt) AS content")).filter("error LIKE 'BadZipFile%'").count(),
            lambda: v.epub_files(spark, os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")).limit(0).count() + 1500):
        spark.conf.set(BATCH, str((1 << 31) - 1))
        assert call() == 1500
        assert max(r.id for r in df.mapInArrow(sizes, "id bigint").collect()) <= 9 << 20


class Kept:
    """State of a user in memory that counts calls."""

    def __init__(self):
        self.rows, self.calls, self.timers = {}, 0, set()

    def getValueState(self, *_):
        return self

    getMapState = getValueState

    def get(self):
        self.calls += 1
        return self.rows.get("value")

    def update(self, row):
        self.calls += 1
        self.rows["value"] = row

    def clear(self):
        self.calls += 1
        self.rows.pop("value", None)

    def getValue(self, key):
        self.calls += 1
        return self.rows[key]

    def updateValue(self, key, row):
        self.calls += 1
        self.rows[key] = row

    def removeKey(self, key):
        self.calls += 1
        del self.rows[key]

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.add(ms)


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_few_events_take_few_state_calls():
    """A hundred events, each in a minute of its own: one read, one write and a timer."""
    kept, user = Kept(), sessions.LazySessions(1800, 60)
    user.init(kept)
    times = np.arange(100, dtype=np.int64) * 60_000_000
    list(user.handleInputRows((1,), iter([pd.DataFrame({"us": times})]), Clock(0)))
    assert kept.calls <= 4
    (closed,) = user.handleExpiredTimer((1,), Clock(10**7), None)
    assert closed["events"].tolist() == [100] and kept.calls <= 8 and not kept.rows


@pytest.mark.parametrize("many", [5, 300, 3000])
def test_batches_in_any_order_give_the_sessions_of_the_whole(many, monkeypatch):
    """Eight batches that overlap, the watermark behind what is still to come, parts that reach into other slots."""
    monkeypatch.setattr(sessions, "_PART", 70)
    draw = np.random.default_rng(many)
    times = np.sort(draw.integers(0, 4 * 10**5, many * 8)) * 1_000_000
    arriving = times[np.argsort(times + draw.integers(0, 10**11, len(times)))]
    kept, user, got = Kept(), sessions.LazySessions(100, 20), []
    user.init(kept)

    def wake(ms):
        for frame in user.handleExpiredTimer((1,), Clock(ms), None):
            got.extend(map(tuple, frame[["start", "seen", "last", "events"]].to_numpy().tolist()))

    for at in range(8):
        batch = arriving[at * many:(at + 1) * many]
        list(user.handleInputRows((1,), iter([pd.DataFrame({"us": batch})]), Clock(0)))
        if at < 7:
            wake(int(arriving[(at + 1) * many:].min()) // 1000 - 1)
    wake(10**10)
    whole = LazyFollower(100, 20)
    assert got == [*whole.feed(times), whole.open] and not kept.rows
