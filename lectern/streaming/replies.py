"""Replies from a stream of frames(request_id, seq, ts, raw)."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lectern.operators.chat import split_frames
from lectern.streaming.runs import check_state_on_disk

FRAME = ("seq bigint, pos int, kind string, text string, finish_reason string, prompt_tokens bigint, "
         "completion_tokens bigint, total_tokens bigint, error string")
NAMES = [part.split()[0] for part in FRAME.split(", ")]
COUNTS = ("prompt_tokens", "completion_tokens", "total_tokens")
# what the head keeps of the frames: the last of each that was there
LAST = ("finish_reason", *COUNTS, "error")
HEAD = ("next bigint, count bigint, due bigint, ended boolean, ahead bigint, finish_reason string, "
        + ", ".join(f"{n} bigint" for n in COUNTS) + ", error string")
REPLY = ("request_id bigint, text string, message string, finish_reason string, prompt_tokens bigint, "
         "completion_tokens bigint, total_tokens bigint, error string, ended boolean, frames bigint")


class Reply:
    """What is known of a reply from its first frames, without their texts."""

    def __init__(self, row: tuple | None = None) -> None:
        self.next, self.count, self.due, self.ended, self.ahead = 0, 0, 0, False, 0
        self.last = dict.fromkeys(LAST)
        if row is not None:
            self.next, self.count, self.due, self.ended, self.ahead, *last = row
            self.last = dict(zip(LAST, last))

    def row(self) -> tuple:
        return (self.next, self.count, self.due, self.ended, self.ahead, *self.last.values())

    def result(self) -> dict:
        """What a reply has besides its texts."""
        return {**{n: self.last[n] for n in ("finish_reason", *COUNTS, "error")}, "ended": self.ended, "frames": self.count}

    def take(self, frames: list[list]) -> tuple[str, list[str]]:
        """Goes on with frames in order, up to the one that ends the reply: their text, and final messages."""
        text, messages = [], []
        for frame in frames:
            if self.ended:
                break
            f = dict(zip(NAMES[2:], frame))
            self.count += 1
            self.ended = f["kind"] in ("done", "error")
            if f["kind"] == "delta":
                text.append(f["text"] or "")
            elif f["kind"] == "final" and f["text"] is not None:
                messages.append(f["text"])
            counted = COUNTS if f["total_tokens"] is not None else ()
            self.last |= {n: f[n] for n in ("finish_reason", "error") if f[n] is not None}
            self.last |= {n: f[n] for n in counted}
        return "".join(text), messages


def assemble(frames: list[tuple]) -> dict:
    """One reply from its frames, cut after the first frame that ends it."""
    reply = Reply()
    text, messages = reply.take([list(f[2:]) for f in sorted(frames, key=lambda f: f[:2])])
    return {"text": text, "message": messages[-1] if messages else None, **reply.result()}


class Replies(StatefulProcessor):
    """Frames of a reply are taken up in order of seq as they come, until one ends it or it falls silent.

    State of a reply: a short head, the text so far as pieces that are only added to, and a map by seq of
    the frames that came before their turn. So a batch touches its own frames and those it was waiting
    for, however long the reply is; the text is read when the reply is given out. Its key is then marked
    until the timeout, so frames that follow the end do not open a second reply. A seq that comes again
    after its turn is a repetition and is left out.
    """

    def __init__(self, timeout_ms: int) -> None:
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", HEAD)
        self.parts = handle.getListState("parts", "text string")
        self.message = handle.getValueState("message", "text string")
        self.ahead = handle.getMapState("ahead", "seq bigint", "frames string")

    def _take(self, reply: Reply, frames: list[list]) -> None:
        text, messages = reply.take(frames)
        if text:
            self.parts.appendValue((text,))
        if messages:
            self.message.update((messages[-1],))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found: dict[int, list[list]] = {}
        latest = 0
        for pdf in rows:
            # whole numbers with gaps arrive as floats
            plain = pdf[NAMES].astype({c: "Int64" for c in COUNTS}).astype(object)
            for seq, pos, *frame in plain.where(plain.notna(), None).itertuples(index=False, name=None):
                found.setdefault(int(seq), []).append([int(pos), *frame])
            latest = max(latest, int(pdf["ms"].max()))
        reply = Reply(self.head.get())
        open_before = not reply.ended
        if reply.due:
            self.handle.deleteTimer(reply.due)
        reply.due = max(reply.due, latest + self.timeout_ms)
        self.handle.registerTimer(reply.due)
        if open_before:
            # one piece of text a batch, unless frames that waited come between
            ready: list[list] = []
            for seq in sorted(found):
                frames = [f[1:] for f in sorted(found[seq], key=lambda f: f[0])]
                if seq == reply.next:
                    ready += frames
                    reply.next += 1
                    while reply.ahead and self.ahead.containsKey((reply.next,)):
                        ready += json.loads(self.ahead.getValue((reply.next,))[0])
                        self.ahead.removeKey((reply.next,))
                        reply.ahead -= 1
                        reply.next += 1
                elif seq > reply.next and not self.ahead.containsKey((seq,)):
                    self.ahead.updateValue((seq,), (json.dumps(frames),))
                    reply.ahead += 1
            self._take(reply, ready)
        out = self._given_out(key, reply) if open_before and reply.ended else self._rows([])
        self.head.update(reply.row())
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        reply = Reply(self.head.get())
        out = self._rows([])
        if not reply.ended:
            # frames before a gap that never closed, then those behind it
            behind = sorted((k[0], v[0]) for k, v in self.ahead.iterator()) if reply.ahead else []
            self._take(reply, [frame for _, frames in behind for frame in json.loads(frames)])
            out = self._given_out(key, reply)
        self.head.clear()
        yield out

    def _given_out(self, key, reply: Reply) -> pd.DataFrame:
        message = self.message.get()
        row = {"request_id": key[0], "text": "".join(x[0] for x in self.parts.get()),
               "message": message[0] if message else None, **reply.result()}
        self.parts.clear()
        self.message.clear()
        self.ahead.clear()
        reply.ahead = 0
        return self._rows([row])

    def _rows(self, rows: list[dict]) -> pd.DataFrame:
        return pd.DataFrame(rows, dtype=object)

    def close(self) -> None:
        pass


def reply_stream(frames: DataFrame, timeout_seconds: int = 600, watermark: str = "1 minute") -> DataFrame:
    """Replies as they complete; the streaming form of ``assemble_replies``."""
    check_state_on_disk(frames.sparkSession)
    timed = frames.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    rows = split_frames(timed).select(
        "request_id", "ts", F.unix_millis("ts").alias("ms"), "seq", "pos", "kind", "text",
        "finish_reason", "usage.*", "error")
    return rows.groupBy("request_id").transformWithStateInPandas(
        Replies(timeout_seconds * 1000), REPLY, "Append", "EventTime")
