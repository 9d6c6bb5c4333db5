"""Sessions: ids, users, idle limits and cleanup."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lectern.session import shared_folder

GAP_SECONDS = 1800
REFRESH_SECONDS = 60
_SECOND = 1_000_000

# Event times that are handled as one block, and neighbours that are joined in one round.
_BLOCK = 1 << 16
_FAN = 16


def session_ids(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Adds ``session``, the sha1 of the record's JSON."""
    return df.withColumn("session", F.sha1(F.to_json(F.struct(*(columns or df.columns)))))


def session_users(sessions: DataFrame, users: DataFrame) -> DataFrame:
    """Sessions with their user, ``user_found`` false where the account is gone."""
    shown = users.select(
        F.col("id").alias("user_id"), "user_name", "email", "role_id", F.lit(True).alias("_hit"))
    return sessions.join(shown, "user_id", "left").select(
        *sessions.columns, "user_name", "email", "role_id",
        F.coalesce("_hit", F.lit(False)).alias("user_found"))


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _slot(micros: Column, width: int) -> Column:
    return micros - F.pmod(micros, F.lit(width))


def sessionize(events: DataFrame, gap: int = GAP_SECONDS) -> DataFrame:
    """Sessions of each user: a new one starts after more than ``gap`` whole idle seconds.

    Two events in one slot as wide as the gap always share a session, so events are first counted
    per (user, slot) before the shuffle. What remains per user is at most one row per slot of the
    covered time span, whatever the number of events.
    """
    slots = events.groupBy("user_id", _slot(_micros("ts"), gap * _SECOND).alias("slot")).agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))
    by_user = Window.partitionBy("user_id").orderBy("slot")
    idle = _micros("first_ts") - F.lag(_micros("last_ts")).over(by_user)
    starts = F.coalesce(idle >= (gap + 1) * _SECOND, F.lit(True)).cast("bigint")
    return (
        slots.withColumn("starts", starts)
        .withColumn("session_no", F.sum("starts").over(by_user))
        .groupBy("user_id", "session_no").agg(
            F.min("first_ts").alias("session_start"), F.max("last_ts").alias("last_seen"),
            F.sum("n").alias("events")))


class LazyFollower:
    """The session of one user, carried over sorted event times in microseconds.

    Only refreshes matter: the next one is the first event at least ``step`` after the last, found by a
    search, so the events between are counted but never visited. A refresh that comes ``limit`` or more
    after the last one starts a session.
    """

    def __init__(self, gap: int, refresh: int) -> None:
        self.limit = (gap + 1) * _SECOND
        self.step = min((refresh + 1) * _SECOND, self.limit)
        self.open: tuple[int | None, int, int, int] | None = None

    def feed(self, times: np.ndarray) -> list[tuple[int | None, int, int, int]]:
        """Takes later events and gives the sessions (start, refreshed, last, events) they close."""
        closed, at = [], 0
        if self.open is None and len(times):
            self.open, at = (int(times[0]), int(times[0]), int(times[0]), 1), 1
        while at < len(times):
            start, seen, last, n = self.open
            due = int(np.searchsorted(times, seen + self.step))
            if due > at:
                last, n = int(times[due - 1]), n + due - at
            if due < len(times):
                now = int(times[due])
                if now - seen >= self.limit:
                    closed.append((start, seen, last, n))
                    start, n = now, 0
                seen, last, n, due = now, now, n + 1, due + 1
            self.open, at = (start, seen, last, n), due
        return closed

    def pieces(self, times: np.ndarray, due: int | None) -> list[tuple[int | None, int, int, int]]:
        """What a block of events adds to sessions, if the next refresh is due at ``due``.

        The first piece has no start where it goes on with a session of earlier events.
        """
        self.open = None if due is None else (None, due - self.step, due - self.step, 0)
        return [x for x in [*self.feed(times), self.open] if x and x[3]]


class Passage:
    """How a run of events turns the time a refresh is due before it into the one after it.

    A step function: if the refresh is due at or before ``upto[i]``, and after the one before, the next one
    is due at ``out[i]`` when all is over. Due after all of them it stays due as it was. ``latest``: the
    refresh before the events is not later than the first of them, so it is not due after this time.
    """

    def __init__(self, upto: np.ndarray, out: np.ndarray, latest: int) -> None:
        last = np.append(out[1:] != out[:-1], True)[:len(out)]
        upto, out = upto[last], out[last]
        reached = int(np.searchsorted(upto, latest)) + 1
        self.upto, self.out, self.latest = upto[:reached], out[:reached], latest

    @classmethod
    def of(cls, times: np.ndarray, step: int) -> Passage:
        """Of sorted events: each points to the refresh after it, and doubling finds the last one."""
        after = np.searchsorted(times, times + step)
        last = np.where(after < len(times), after, np.arange(len(times)))
        while True:
            further = last[last]
            if (further == last).all():
                break
            last = further
        return cls(times, times[last] + step, int(times[0]) + step)

    def __call__(self, due: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.upto, due)
        return np.where(at < len(self.upto), np.append(self.out, 0)[at], due)

    def then(self, later: Passage) -> Passage:
        """This run and the one after it."""
        beyond = later.upto > self.upto[-1]
        return Passage(np.append(self.upto, later.upto[beyond]), np.append(later(self.out), later.out[beyond]),
                       self.latest)

    def packed(self) -> bytes:
        return np.concatenate([[self.latest], self.upto, self.out]).astype("<i8").tobytes()

    @classmethod
    def unpacked(cls, data: bytes) -> Passage:
        both = np.frombuffer(data, "<i8")
        half = len(both) // 2
        return cls(both[1:half + 1], both[half + 1:], int(both[0]))


def _written(df: DataFrame, name: str) -> DataFrame:
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _time_blocks(events: DataFrame, kind: str) -> DataFrame:
    """(user_id, block, first_us, last_us, times): sorted event times of a user in blocks of bounded size.

    Events are dealt and sorted by ranges of (user, time), so those of a busy user spread over tasks.
    """
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            users, times = batch.column(0), batch.column(1).to_numpy()
            if not len(times):
                continue
            ends = np.append(np.flatnonzero(_changes(users)) + 1, len(times))
            cuts = sorted({*ends.tolist(), *range(_BLOCK, len(times), _BLOCK)})
            begins = [0, *cuts[:-1]]
            yield pa.record_batch([
                users.take(pa.array(begins)), np.arange(number, number + len(cuts)), times[begins],
                times[np.array(cuts) - 1],
                pa.array([times[i:j].tobytes() for i, j in zip(begins, cuts)], pa.binary())],
                names=["user_id", "block", "first_us", "last_us", "times"])
            number += len(cuts)

    stamps = events.select("user_id", _micros("ts").alias("us")).filter(F.col("us").isNotNull())
    return stamps.repartitionByRange("user_id", "us").sortWithinPartitions("user_id", "us").mapInArrow(
        pack, f"user_id {kind}, block bigint, first_us bigint, last_us bigint, times binary")


def _entries(nodes: DataFrame, kind: str) -> DataFrame:
    """(user_id, no, due) of the nodes (user_id, no, passage): when a refresh is due before each one.

    Nodes of a user follow each other by ``no`` from 0; before the first nothing is due. Passages of
    ``_FAN`` neighbours make one of the next round, until one node is left; then each node hands on to
    its parts what is due. So a task of either way reads the parts of one node at a time.
    """
    if nodes.agg(F.max("no")).first()[0] in (None, 0):
        return nodes.select("user_id", "no", F.lit(None).cast("bigint").alias("due"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, whole = None, None

        def node() -> pa.RecordBatch:
            return pa.record_batch([pa.array([current[0]], users), pa.array([current[1]], pa.int64()),
                                    pa.array([whole.packed()], pa.binary())], names=["user_id", "no", "passage"])

        for batch in batches:
            for user, no, passage in zip(*(batch.column(i) for i in (0, 1, 3))):
                key, part = (user.as_py(), no.as_py()), Passage.unpacked(passage.as_py())
                if current == key:
                    whole = whole.then(part)
                    continue
                if current is not None:
                    yield node()
                current, whole = key, part
        if current is not None:
            yield node()

    def hand_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        due = None
        for batch in batches:
            rows = []
            for user, no, passage, told in zip(*(batch.column(i) for i in (0, 2, 3, 4))):
                if not passage.is_valid:  # the node itself, before its parts
                    due = told.as_py()
                    continue
                rows.append((user.as_py(), no.as_py(), due))
                passage = Passage.unpacked(passage.as_py())
                # before the first events of a user, the first of them is a refresh
                due = int(passage.out[0] if due is None else passage(np.array([due]))[0])
            if rows:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), (users, pa.int64(), pa.int64()))],
                                      names=["user_id", "no", "due"])

    users = to_arrow_type(nodes.schema["user_id"].dataType)
    group = F.floor(F.col("no") / _FAN).cast("bigint").alias("whole")
    parts = nodes.select("user_id", group, "no", "passage")
    above = _written(parts.repartition("user_id", "whole").sortWithinPartitions("user_id", "whole", "no").mapInArrow(
        join, f"user_id {kind}, no bigint, passage binary"), "session-nodes")
    told = _entries(above, kind).select(
        "user_id", F.col("no").alias("whole"), F.lit(-1).cast("bigint").alias("no"),
        F.lit(None).cast("binary").alias("passage"), "due")
    both = parts.withColumn("due", F.lit(None).cast("bigint")).unionByName(told)
    return both.repartition("user_id", "whole").sortWithinPartitions("user_id", "whole", "no").mapInArrow(
        hand_on, f"user_id {kind}, no bigint, due bigint")


def sessionize_lazy(
    events: DataFrame, gap: int = GAP_SECONDS, refresh: int = REFRESH_SECONDS,
) -> DataFrame:
    """Sessions as kept by a store that refreshes its last-seen time only when it is old.

    With whole seconds since the last refresh: above ``gap`` a new session starts, else above
    ``refresh`` the time is refreshed, else it stays. Expiry therefore counts from the last refresh.

    Event times are packed into blocks of bounded size, which are written. Where a user has several, each
    block tells how it turns the time a refresh is due before it into the one after it; these are joined
    in rounds, and every block then finds its sessions by itself. What a user's blocks add to sessions is
    put together at the end: at most a row per block and one per session.
    """
    if gap < 0 or refresh < 0:
        raise ValueError("gap and refresh must not be negative")
    user, kind = events.schema["user_id"].dataType.simpleString(), events.schema["ts"].dataType
    step = LazyFollower(gap, refresh).step

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Passage.of(np.frombuffer(x.as_buffer(), np.int64), step).packed() for x in batch.column(2)]
            yield pa.record_batch([*batch.columns[:2], pa.array(found, pa.binary())],
                                  names=["user_id", "no", "passage"])

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        follower = LazyFollower(gap, refresh)
        names = ["user_id", "no", "piece", "start", "seen", "last", "events"]
        kinds = [users, *[pa.int64()] * 6]
        for batch in batches:
            rows = []
            for who, no, times, due in zip(*(batch.column(i) for i in range(4))):
                found = follower.pieces(np.frombuffer(times.as_buffer(), np.int64), due.as_py())
                rows += [(who.as_py(), no.as_py(), at, *piece) for at, piece in enumerate(found)]
            if rows:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    users = to_arrow_type(events.schema["user_id"].dataType)
    blocks = _written(_time_blocks(events, user), "session-blocks")
    mine = Window.partitionBy("user_id")
    placed = _written(blocks.select(
        "user_id", "block", (F.row_number().over(mine.orderBy("first_us", "last_us", "block")) - 1).cast(
            "bigint").alias("no"), F.count(F.lit(1)).over(mine).alias("many")), "session-places")
    several = placed.filter(F.col("many") > 1)
    asked = placed.withColumn("due", F.lit(None).cast("bigint"))
    if not several.isEmpty():
        nodes = _written(several.join(blocks.select("block", "times"), "block").select(
            "user_id", "no", "times").mapInArrow(passages, f"user_id {user}, no bigint, passage binary"), "session-nodes")
        entries = _entries(nodes, user).select(F.col("user_id").alias("_user"), F.col("no").alias("_no"), "due")
        asked = placed.join(
            entries, F.col("user_id").eqNullSafe(F.col("_user")) & (F.col("no") == F.col("_no")), "left")
    pieces = blocks.select("block", "times").join(asked.select("user_id", "no", "block", "due"), "block").select(
        "user_id", "no", "times", "due").mapInArrow(
        follow, f"user_id {user}, no bigint, piece bigint, start bigint, seen bigint, last bigint, events bigint")
    begun = F.sum(F.col("start").isNotNull().cast("bigint")).over(mine.orderBy("no", "piece"))
    sessions = pieces.withColumn("session_no", begun).groupBy("user_id", "session_no").agg(
        F.min("start").alias("start"), F.max("seen").alias("seen"), F.max("last").alias("last"),
        F.sum("events").alias("events"))

    def at(micros: str) -> Column:
        return F.timestamp_micros(micros).cast(kind)

    return sessions.select("user_id", "session_no", at("start").alias("session_start"),
                           at("seen").alias("refreshed_at"), at("last").alias("last_seen"), "events")


def _changes(values: pa.Array) -> np.ndarray:
    """Where neighbours differ; nulls equal each other."""
    same = pc.equal(values[1:], values[:-1]).fill_null(False).to_numpy(zero_copy_only=False)
    none = values.is_null().to_numpy(zero_copy_only=False)
    return ~(same | (none[1:] & none[:-1]))


def expired_sessions(sessions: DataFrame, as_of: Column) -> DataFrame:
    """Sessions whose whole idle seconds at ``as_of`` exceed their duration."""
    return sessions.filter(_idle(as_of) > F.col("duration"))


def live_sessions(sessions: DataFrame, as_of: Column) -> DataFrame:
    """What is left after the expired sessions are deleted."""
    return sessions.filter(~(_idle(as_of) > F.col("duration")))


def _idle(as_of: Column) -> Column:
    idle = F.unix_micros(as_of.cast("timestamp")) - _micros("utime")
    return F.floor(idle / _SECOND)
