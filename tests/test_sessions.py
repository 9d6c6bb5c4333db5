"""Sessions against plain loops."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import sessions

START = datetime.datetime(2024, 1, 1)


def at(us):
    return START + datetime.timedelta(microseconds=us)


def frame(spark, events):
    return spark.createDataFrame([(u, at(us)) for u, us in events], "user_id bigint, ts timestamp_ntz")


def lazy_by_loop(times, gap, refresh):
    out, seen = [], None
    for us in sorted(times):
        idle = None if seen is None else (us - seen) // 1_000_000
        if idle is None or idle > gap:
            out.append([us, us, us, 1])
            seen = us
            continue
        if idle > refresh:
            seen = us
        out[-1] = [out[-1][0], seen, us, out[-1][3] + 1]
    return [(at(a), at(b), at(c), n) for a, b, c, n in out]


def lazy_rows(spark, events, gap, refresh):
    rows = sessions.sessionize_lazy(frame(spark, events), gap, refresh).collect()
    found = {}
    for r in sorted(rows, key=lambda r: (r.user_id, r.session_no)):
        found.setdefault(r.user_id, []).append((r.session_start, r.refreshed_at, r.last_seen, r.events))
    return found


@pytest.mark.parametrize("gap,refresh", [(1800, 60), (10, 3), (5, 2), (100, 60), (5, 5), (3, 10), (0, 0)])
def test_lazy_sessions_equal_loop(spark, gap, refresh):
    rng = random.Random(gap)
    events = []
    for user in range(40):
        us = rng.randint(0, 10**9)
        for _ in range(rng.randint(1, 400)):
            pause = rng.choice([0, rng.random(), rng.random() * refresh, refresh, refresh + 1,
                                rng.random() * gap * (rng.random() < 0.1), gap, gap + 1])
            us += int(pause * 10**6) if rng.random() < 0.5 else int(rng.random() * refresh * 10**6)
            events.append((user, us))
    want = {}
    for user in range(40):
        want[user] = lazy_by_loop([us for u, us in events if u == user], gap, refresh)
    assert lazy_rows(spark, events, gap, refresh) == want


def test_one_user_without_pauses(spark):
    rng = random.Random(2)
    times, us = [], 0
    for _ in range(20_000):
        us += rng.randint(0, 40_000_000)
        times.append(us)
    events = [(1, us) for us in times] + [(2, 5)]
    assert lazy_rows(spark, events, 1800, 60)[1] == lazy_by_loop(times, 1800, 60)


def test_a_busy_user_is_never_one_array(spark, monkeypatch):
    """Three million events of one user within an hour, beside others."""
    monkeypatch.setattr(sessions, "_BLOCK", 10_000)
    busy = spark.range(3_000_000).select(
        F.lit(7).cast("bigint").alias("user_id"),
        F.timestamp_micros(F.col("id") * 1200).cast("timestamp_ntz").alias("ts"))
    other = spark.createDataFrame([(None, at(0)), (None, at(5)), (8, at(0))], "user_id bigint, ts timestamp_ntz")
    rows = {r.user_id: r for r in sessions.sessionize_lazy(busy.unionByName(other), 100, 60).collect()}
    assert {u: r.events for u, r in rows.items()} == {None: 2, 7: 3_000_000, 8: 1}
    epoch = datetime.datetime(1970, 1, 1)
    # the first refresh at 61 s, then one at each first event 61 s later
    seen = 0
    while (due := -(-(seen + 61_000_000) // 1200) * 1200) < 3_600_000_000:
        seen = due
    assert rows[7].refreshed_at == epoch + datetime.timedelta(microseconds=seen)


@pytest.mark.parametrize("pace", [0, 900, 20_000, 3_000_000, 70_000_000])
def test_a_busy_user_over_many_rounds(spark, monkeypatch, pace):
    """Blocks of 16 events, joined by threes, from far less than a refresh to far more; equal times too."""
    monkeypatch.setattr(sessions, "_BLOCK", 16)
    monkeypatch.setattr(sessions, "_FAN", 3)
    rng = random.Random(pace)
    times = [0]
    for _ in range(1500):
        times.append(times[-1] + rng.choice([0, pace, rng.randint(0, 2 * pace), rng.choice([0, 0, 0, 65]) * 10**6]))
    few = [rng.randint(0, 10**9) for _ in range(20)]
    events = [(1, us) for us in times] + [(2, us) for us in few] + [(None, us) for us in times[:200]]
    rng.shuffle(events)
    assert lazy_rows_by_user(spark, events, 100, 60) == {
        1: lazy_by_loop(times, 100, 60), 2: lazy_by_loop(few, 100, 60), None: lazy_by_loop(times[:200], 100, 60)}


def lazy_rows_by_user(spark, events, gap, refresh):
    found = {}
    for r in sorted(sessions.sessionize_lazy(frame(spark, events), gap, refresh).collect(), key=lambda r: r.session_no):
        found.setdefault(r.user_id, []).append((r.session_start, r.refreshed_at, r.last_seen, r.events))
    return found


def test_passages_join_to_the_passage_of_all():
    rng = random.Random(9)
    for pace in (1, 7, 40, 200):
        times = np.cumsum([rng.choice([0, 1, pace, rng.randint(0, 3 * pace)]) for _ in range(300)])
        cuts = [0, *sorted(rng.sample(range(1, 300), 7)), 300]
        parts = [sessions.Passage.of(times[i:j], 50) for i, j in zip(cuts, cuts[1:])]
        whole = parts[0]
        for part in parts[1:]:
            whole = sessions.Passage.unpacked(whole.then(part).packed())
        for due in range(int(times[0]) - 3, int(times[0]) + 51):
            seen = due - 50
            for t in times.tolist():
                seen = t if t - seen >= 50 else seen
            assert int(whole(np.array([due]))[0]) == seen + 50
        assert len(whole.upto) <= len(times[times <= times[0] + 50]) + 1


def test_lazy_edges(spark):
    with pytest.raises(ValueError):
        lazy_rows(spark, [(1, 0)], -1, 3)
    second = 10**6
    # 60 s does not refresh, so 1800 s later counts from the first event
    assert len(lazy_rows(spark, [(1, 0), (1, 60 * second), (1, 1800 * second)], 1800, 60)[1]) == 1
    assert len(lazy_rows(spark, [(1, 0), (1, 60 * second), (1, 1801 * second)], 1800, 60)[1]) == 2
    assert len(lazy_rows(spark, [(1, 0), (1, 61 * second), (1, 1801 * second)], 1800, 60)[1]) == 1


def test_sessions_keep_an_exact_gap_together(spark):
    second = 10**6
    # idle for 1800.5 s, then for 1801 s
    events = [(1, 0), (1, 1800 * second + second // 2), (1, 3601 * second + second // 2), (2, 7), (2, 7)]
    rows = sessions.sessionize(frame(spark, events)).orderBy("user_id", "session_no").collect()
    assert [(r.user_id, r.session_start, r.last_seen, r.events) for r in rows] == [
        (1, at(0), at(1800 * second + second // 2), 2),
        (1, at(3601 * second + second // 2), at(3601 * second + second // 2), 1),
        (2, at(7), at(7), 2)]


def test_expiry_uses_whole_seconds(spark):
    rows = [("a", 1, at(0), 1800), ("b", 1, at(1), 1800), ("c", 1, at(10**6), 1800)]
    df = spark.createDataFrame(rows, "session string, user_id bigint, utime timestamp_ntz, duration bigint")
    now = F.lit(at(1801 * 10**6))
    assert [r.session for r in sessions.expired_sessions(df, now).collect()] == ["a"]
    assert sorted(r.session for r in sessions.live_sessions(df, now).collect()) == ["b", "c"]
