"""Replies as they arrive: event streams and whole bodies in one table, with timers and expiry.

A row is a piece of a reply: stream_id, seq, bytes, and on a reply's first row its schema, content_type and vault (a map
from placeholder to original, put there by a join with the table of vaults). `is_end` or `failed` ends it. A reply whose
content type is not text/event-stream is kept until its end and restored as one JSON body; an upstream that gives neither
events nor JSON is answered by an error body. An event stream that fails gets what was held, then a terminal error event.
A reply without a vault passes as it is.

State of a stream is kept in parts, so that a batch writes what it changed only: the head (kinds, unfinished line), each
held piece under its own key, each piece of a body, the vault once. A timer ends a reply after `idle` without a row, as its
end would have; with processing time all state has a time to live besides. A reply's end removes all of it.

Rows of a batch are taken in order of seq; rows of a later batch come after them. A row after the end begins a new reply,
which has no vault unless it brings one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.scan import Blocked
from ..functions.walks import dump, restore_reply
from .events import ERROR, FAILED, Events

OUT = "stream_id string, seq long, bytes binary"
HEAD = "schema string, kind string, line binary, event string, seq long, timer long, open boolean"
#: The content type that tells an event stream, anywhere in the header and in any case; no header counts as one.
EVENT_STREAM = "text/event-stream"
STORE = "spark.sql.streaming.stateStore.providerClass"


def error_body(message: str) -> bytes:
    return dump({"error": {"message": message, "type": ERROR}}).encode()


class Reply:
    """One reply: rows in, bytes out. The caller loads and keeps its parts."""

    def __init__(self):
        self.schema, self.kind, self.vault, self.parts, self.open = "openai", None, {}, [], False
        self.events = Events(self.schema, {})

    def take(self, row) -> bytes:
        if isinstance(row.schema, str):
            self.schema = row.schema
        if isinstance(row.vault, dict):
            self.vault.update(row.vault)
        if self.kind is None:
            self.kind = "events" if not isinstance(row.content_type, str) or EVENT_STREAM in row.content_type.lower() else "body"
        data = b"" if row.bytes is None else bytes(row.bytes)
        if self.kind == "body":
            self.parts.append(data)
            return b""
        self.events.schema, self.events.vault = self.schema, self.vault
        if data:
            self.open = not data.endswith(b"\n")
        return self.events.push(data)

    def end(self, failed: bool) -> bytes:
        if self.kind == "body":
            return self._body(failed)
        self.events.schema, self.events.vault = self.schema, self.vault
        out = self.events.flush()
        if failed:  # a line that went out unfinished is ended first
            out += b"\n\n" * (self.open and not self.vault) + FAILED.encode()
        return out

    def _body(self, failed: bool) -> bytes:
        whole = b"".join(self.parts)
        if failed:
            return error_body("the upstream failed before its reply ended")
        try:
            value = json.loads(whole)
            if not self.vault:
                return whole
            restore_reply(value, self.schema, self.vault)
            return dump(value).encode()
        except Blocked:
            return whole  # JSON that can't be written again: as it came
        except (ValueError, RecursionError):
            return error_body("the upstream's reply is neither events nor JSON")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["stream_id", "seq", "bytes"])


def _key(text: str) -> tuple:
    return tuple(json.loads(text))


class Restorer(StatefulProcessor):
    def __init__(self, idle_ms: int, event_time: bool, ttl_ms: int):
        self.idle, self.event_time, self.ttl = idle_ms, event_time, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = None if self.event_time else self.ttl
        self.handle = handle
        self.head = handle.getValueState("head", HEAD, ttl)
        self.vault = handle.getValueState("vault", "vault map<string,string>", ttl)
        self.held = handle.getMapState("held", "key string", "text string", ttl)
        self.parts = handle.getListState("parts", "bytes binary", ttl)

    def _load(self) -> tuple[Reply, int, int | None]:
        reply = Reply()
        if not self.head.exists():
            return reply, -1, None
        schema, reply.kind, line, reply.events.event, seq, timer, reply.open = self.head.get()
        reply.schema, reply.events.line = schema, bytes(line or b"")
        if self.vault.exists():
            reply.vault = dict(self.vault.get()[0])
        reply.events.held = {_key(k[0]): v[0] for k, v in self.held.iterator()}
        return reply, seq, timer

    def _drop(self, timer: int | None) -> None:
        for state in (self.head, self.vault, self.held, self.parts):
            state.clear()
        if timer is not None:
            self.handle.deleteTimer(timer)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        reply, seq, timer = self._load()
        before, known, out = dict(reply.events.held), bool(reply.vault), []
        frame, ended = pd.concat(list(rows)).sort_values("seq", kind="stable"), False
        latest = int(frame["at"].max().timestamp() * 1000) if self.event_time else 0
        for r in frame.itertuples():
            if ended:
                self._drop(timer)
                reply, before, known, timer, ended = Reply(), {}, False, None, False
            seq = int(r.seq)
            data = reply.take(r)
            if r.is_end or r.failed:
                if reply.kind == "body":
                    reply.parts = [bytes(p[0]) for p in self.parts.get()] + reply.parts
                data += reply.end(bool(r.failed))
                ended = True
            if data:
                out.append((key[0], seq, data))
        if ended:
            self._drop(timer)
        else:
            self._keep(reply, before, known, seq, timer, timerValues, latest)
        yield _frame(out)

    def _keep(self, reply: Reply, before: dict, known: bool, seq: int, timer: int | None, times, latest: int) -> None:
        now = latest if self.event_time else times.getCurrentProcessingTimeInMs()
        due = max(timer or 0, now + self.idle)
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        if timer != due:
            self.handle.registerTimer(due)
        self.head.update((reply.schema, reply.kind, reply.events.line, reply.events.event, seq, due, reply.open))
        if reply.vault and not known:
            self.vault.update((reply.vault,))
        for k, text in reply.events.held.items():
            if before.get(k) != text:
                self.held.updateValue((json.dumps(k),), (text,))
        for k in before.keys() - reply.events.held.keys():
            self.held.removeKey((json.dumps(k),))
        if reply.parts:
            self.parts.appendList([(p,) for p in reply.parts])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        reply, seq, _ = self._load()
        if seq >= 0 or reply.kind is not None:
            reply.parts = [bytes(p[0]) for p in self.parts.get()]
            data = reply.end(False)
            self._drop(None)
            if data:
                yield _frame([(key[0], seq + 1, data)])

    def close(self) -> None:
        pass


def keep_state_on_disk(spark: SparkSession) -> None:
    """State with timers needs the RocksDB store; a session that names another keeps it."""
    if spark.conf.get(STORE, None) in (None, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"):
        spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def with_vaults(chunks: DataFrame, vaults: DataFrame) -> DataFrame:
    """Puts its vault on the first row (seq = 0) of each reply. vaults: stream_id, placeholder, original. A stream meets the
    table by a stream-static join; only first rows take part, so that a vault is sent once. A reply without rows in the
    table has no vault: it passes as it is. Of two originals of one placeholder the smaller counts."""
    once = vaults.groupBy("stream_id", "placeholder").agg(F.min("original").alias("original"))
    per = once.groupBy(F.col("stream_id").alias("of")).agg(F.map_from_entries(F.collect_list(F.struct("placeholder", "original"))).alias("vault"))
    return chunks.drop("vault").join(per, (F.col("stream_id") == F.col("of")) & (F.col("seq") == 0), "left").drop("of")


def restore(chunks: DataFrame, idle: str = "10 minutes", event_time: str | None = None, ttl: str = "1 day") -> DataFrame:
    """stream_id, seq, bytes of a streaming table of pieces. ttl: how long state may outlive its last write by the clock, a
    safeguard besides the timers; what a query that was down for longer held is lost. event_time: a timestamp column that drives the timers through
    a watermark of the same length; else the clock does. By the clock Spark runs batches without rows for the timers'
    sake, which an availableNow query never ends; run that with spark.sql.streaming.noDataMicroBatches.enabled = false."""
    spark = chunks.sparkSession
    keep_state_on_disk(spark)
    ms, ttl_ms = (int(pd.Timedelta(x).total_seconds() * 1000) for x in (idle, ttl))
    cols = ["stream_id", "seq", "bytes", "schema", "content_type", "vault", "is_end", "failed"]
    d = chunks.select(*cols, F.col(event_time).alias("at")).withWatermark("at", idle) if event_time else chunks.select(*cols)
    return d.groupBy("stream_id").transformWithStateInPandas(Restorer(ms, event_time is not None, max(ttl_ms, 4 * ms)), OUT, "Append", "EventTime" if event_time else "ProcessingTime")


def restore_recorded(chunks: DataFrame) -> DataFrame:
    """As restore, for a table of whole replies; one without an end is ended as by its timer, one after its last row."""

    def whole(key, frame):
        reply, out, seq, ended = Reply(), [], -1, True
        for r in frame.sort_values("seq", kind="stable").itertuples():
            if ended and seq >= 0:
                reply = Reply()
            seq, data, ended = int(r.seq), reply.take(r), bool(r.is_end or r.failed)
            data += reply.end(bool(r.failed)) if ended else b""
            if data:
                out.append((key[0], seq, data))
        if not ended and (data := reply.end(False)):
            out.append((key[0], seq + 1, data))
        return _frame(out)

    return chunks.groupBy("stream_id").applyInPandas(whole, OUT)
