"""Sessions from a stream of events(user_id, ts)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lectern.operators.sessions import GAP_SECONDS, REFRESH_SECONDS, LazyFollower
from lectern.streaming.runs import check_state_on_disk

# Microseconds of a slot of waiting event times.
_SLOT = 60_000_000
# Waiting event times of a user that are kept with the index, and those of a part beyond that, at most.
_FEW, _PART = 256, 4096


def session_stream(events: DataFrame, gap: int = GAP_SECONDS, watermark: str = "10 minutes") -> DataFrame:
    """Closed sessions; the streaming form of ``sessionize``."""
    # whole seconds count, so a pause of less than gap + 1 seconds keeps a session open
    window = F.session_window("ts", f"{gap + 1} seconds")
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
        .groupBy("user_id", window)
        .agg(F.min("ts").alias("session_start"), F.max("ts").alias("last_seen"),
             F.count("*").alias("events"))
        .drop("session_window"))


class LazySessions(StatefulProcessor):
    """One open session per user; events wait until the watermark has passed them.

    State: one value with the open session, an index and the waiting event times while these are few; when they
    are many, they lie sorted in parts, by the slot of time in which a part begins. The index holds the number
    of parts and the first time of each slot. So a batch of few events of a user takes one read and one write,
    one of many adds parts without reading any, and a timer reads the slots that are due, however many events
    wait behind them.
    """

    def __init__(self, gap: int, refresh: int) -> None:
        self.gap, self.refresh = gap, refresh

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "packed binary")
        self.waiting = handle.getMapState("waiting", "slot bigint, part bigint", "times binary")

    def _load(self) -> tuple[tuple | None, dict[int, tuple[int, int]], np.ndarray]:
        """The open session, the index, and the few waiting times."""
        packed = self.kept.get()
        if not packed:
            return None, {}, np.empty(0, np.int64)
        data = np.frombuffer(packed[0], np.int64)
        ends = 6 + 3 * int(data[5])
        session = tuple(data[1:5].tolist()) if data[0] else None
        return session, {slot: (parts, first) for slot, parts, first in data[6:ends].reshape(-1, 3).tolist()}, data[ends:]

    def _save(self, session: tuple | None, index: dict[int, tuple[int, int]], times: np.ndarray) -> None:
        """Keeps the state, with the sorted times as parts if they are many, and wakes at the first time."""
        if len(times) > _FEW:
            for part in np.split(times, range(_PART, len(times), _PART)):
                slot = int(part[0] // _SLOT)
                number, first = index.get(slot, (0, int(part[0])))
                self.waiting.updateValue((slot, number), (part.tobytes(),))
                index[slot] = (number + 1, min(first, int(part[0])))
            times = times[:0]
        if session is None and not index and not len(times):
            self.kept.clear()
            return
        rows = [x for slot in sorted(index) for x in (slot, *index[slot])]
        head = np.array([session is not None, *(session or (0,) * 4), len(index), *rows], np.int64)
        self.kept.update((head.tobytes() + times.tobytes(),))
        firsts = [first for _, first in index.values()] + times[:1].tolist()
        if firsts:
            self._wake(min(firsts))

    def _wake(self, us: int) -> None:
        """Timer at the first millisecond after the given time."""
        self.handle.registerTimer(us // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        session, index, few = self._load()
        self._save(session, index, np.sort(np.concatenate([few, *[pdf["us"].to_numpy(np.int64) for pdf in rows]])))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # everything before the watermark has arrived
        now = timerValues.getCurrentWatermarkInMs() * 1000
        follower = LazyFollower(self.gap, self.refresh)
        follower.open, index, times = self._load()
        due = [(first, slot) for slot, (_, first) in sorted(index.items()) if first < now]
        closed = []
        # what a slot holds may reach beyond the first time of the next one
        for (_, slot), (ends, _) in zip(due, [*due[1:], (now, None)]):
            parts = [times]
            for number in range(index.pop(slot)[0]):
                parts.append(np.frombuffer(self.waiting.getValue((slot, number))[0], np.int64))
                self.waiting.removeKey((slot, number))
            times = np.sort(np.concatenate(parts))
            done = int(np.searchsorted(times, ends))
            closed += follower.feed(times[:done])
            times = times[done:]
        done = int(np.searchsorted(times, now))
        closed += follower.feed(times[:done])
        session = follower.open
        if session is not None and session[1] + follower.limit <= now:
            closed.append(session)
            session = None
        self._save(session, index, times[done:])
        if session is not None:
            self._wake(session[1] + follower.limit)
        if closed:
            yield pd.DataFrame({
                "user_id": [key[0]] * len(closed),
                **{name: [s[i] for s in closed] for i, name in enumerate(("start", "seen", "last", "events"))}})

    def close(self) -> None:
        pass


def lazy_session_stream(
    events: DataFrame, gap: int = GAP_SECONDS, refresh: int = REFRESH_SECONDS,
    watermark: str = "10 minutes",
) -> DataFrame:
    """Closed sessions; the streaming form of ``sessionize_lazy``."""
    check_state_on_disk(events.sparkSession)
    timed = events.select(
        "user_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", watermark)
    closed = timed.withColumn("us", F.unix_micros("ts")).groupBy("user_id").transformWithStateInPandas(
        LazySessions(gap, refresh),
        "user_id bigint, start bigint, seen bigint, last bigint, events bigint", "Append", "EventTime")
    return closed.select(
        "user_id", F.timestamp_micros("start").alias("session_start"),
        F.timestamp_micros("seen").alias("refreshed_at"),
        F.timestamp_micros("last").alias("last_seen"), "events")
