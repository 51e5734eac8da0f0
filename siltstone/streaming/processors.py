"""Keys and jobs as streams: state with timers for each key, by transformWithState.

Rows of a key are taken by event time inside a micro-batch; batches must come in that order, as they do from a queue that is
partitioned by key.  What a key holds is a few values, and a timer of event time clears it when it is over.  Streams need the
RocksDB state store (``with_state_store``) and a watermark on the event time.  A key mostly brings few rows to a batch, so
they are taken as rows, not as a frame a key, and its state is read once: what a key costs is what a run takes.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from siltstone.operators.keys import KEEPALIVE_SECONDS
from siltstone.streaming.state import CACHE_SECONDS, STALE_MINUTES, TRANSITIONAL

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FINAL = ("done", "error")
#: What an action makes of a queued id; indexed and skipped ids are final, errors are tried again.
MOVES = {
    ("queued", "claim"): "fetching", ("error", "claim"): "fetching", ("fetching", "parse"): "parsing", ("fetching", "skip"): "skipped",
    ("fetching", "fail"): "error", ("parsing", "fail"): "error", ("parsing", "index"): "indexed",
}


def with_state_store(spark: SparkSession) -> SparkSession:
    """A session of its own with the state store that the processors need; other sessions keep theirs."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    return own


def _in_order(rows: Iterator[Row], by: list[str]) -> list[Row]:
    """The rows of a key of this batch, in order, nulls last; a micro-batch bounds them."""
    return sorted(rows, key=lambda r: [(r[c] is None, r[c]) for c in by])


def _seconds(row: Row) -> float:
    return (-(1 << 63) if row["_us"] is None else row["_us"]) / 1e6


def _timed(events: DataFrame, ts: str) -> DataFrame:
    """``events`` with their time in microseconds beside it."""
    return events.withColumn("_us", F.unix_micros(ts))


class KeyCache(StatefulProcessor):
    """Whether each look-up is answered from the cache: within ``ttl`` seconds of the fill, which a hit does not renew.

    Actions: ``invalidate`` drops the key, ``missing`` finds none and drops what is over, others find it.
    """

    def __init__(self, key: str, ts: str, order: str, action: str, ttl: float = CACHE_SECONDS) -> None:
        self.key, self.ts, self.order, self.action, self.ttl = key, ts, order, action, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.until = handle, handle.getValueState("until", "until double")
        self.row = Row(self.key, self.order, "hit")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        held = self.until.get()
        until = before = held[0] if held else None
        for row in _in_order(rows, ["_us", self.order]):
            now, what = _seconds(row), row[self.action]
            hit = what != "invalidate" and until is not None and now < until
            if not hit:
                until = None if what in ("invalidate", "missing") else now + self.ttl
            yield self.row(key[0], row[self.order], hit)
        if until is None:
            if held:
                self.until.clear()
        elif until != before:
            self.until.update((until,))
            self.handle.registerTimer(int(until * 1000) + 1)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        # A later fill has a timer of its own.
        held = self.until.get()
        if held and held[0] * 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.until.clear()
        return iter(())

    def close(self) -> None:
        pass


class JobStore(StatefulProcessor):
    """The state of each job after every batch in which it was updated; done and error are final.

    Nulls say nothing about their field.  With ``ttl`` a job is forgotten so many seconds after it began: a row with the
    status ``expired`` says so, and a later update begins a new job.
    """

    FIELDS = ("status", "stage", "payload", "error")

    def __init__(self, key: str, ts: str, order: str, ttl: float | None = None) -> None:
        self.key, self.ts, self.order, self.ttl = key, ts, order, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fields = handle.getMapState("fields", "field string", "value string")
        self.begun = handle.getValueState("begun", "created double, upto long")
        self.row = Row(self.key, *self.FIELDS, "upto")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        begun = self.begun.get()
        known = {f: value[0] for (f,), value in self.fields.iterator()} if begun else {}
        old, upto, created = dict(known), None, begun[0] if begun else None
        for row in _in_order(rows, [self.order]):
            created = _seconds(row) if created is None else min(created, _seconds(row))
            if known.get("status") in FINAL:
                continue
            known |= {f: row[f] for f in self.FIELDS if isinstance(row[f], str)}
            upto = int(row[self.order])
        for f, value in known.items():
            if old.get(f) != value:
                self.fields.updateValue((f,), (value,))
        if upto is None:
            return
        if self.ttl is not None and not begun:
            self.handle.registerTimer(int((created + self.ttl) * 1000))
        self.begun.update((created, upto))
        yield self._row(key, known, upto)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        begun = self.begun.get()
        upto = int(begun[1]) if begun else 0
        self.fields.clear()
        self.begun.clear()
        yield self._row(key, {"status": "expired"}, upto)

    def _row(self, key: tuple, known: dict[str, str], upto: int) -> Row:
        return self.row(key[0], *(known.get(f, "pending" if f == "status" else None) for f in self.FIELDS), upto)

    def close(self) -> None:
        pass


class KeepAlive(StatefulProcessor):
    """How many signs of life the silence before each event needs, one every ``seconds``."""

    def __init__(self, key: str, ts: str, order: str, seconds: float = KEEPALIVE_SECONDS) -> None:
        self.key, self.ts, self.order, self.seconds = key, ts, order, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last, self.row = handle.getValueState("last", "last double"), Row(self.key, self.order, "beats")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        held = self.last.get()
        last = held[0] if held else None
        for row in _in_order(rows, ["_us", self.order]):
            now = _seconds(row)
            yield self.row(key[0], row[self.order], 0 if last is None else max(0, -int(-round(now - last, 6) // self.seconds) - 1))
            last = now
        self.last.update((last,))

    def close(self) -> None:
        pass


def key_cache_stream(events: DataFrame, key: str, ts: str, order: str, action: str, ttl: float = CACHE_SECONDS) -> DataFrame:
    """(key, order, hit) of each look-up of the stream ``events``, which has a watermark on ``ts``."""
    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    out = f"{key} {kinds[key]}, {order} {kinds[order]}, hit boolean"
    return _timed(events, ts).groupBy(key).transformWithState(KeyCache(key, ts, order, action, ttl), out, "Append", "EventTime")


def job_stream(updates: DataFrame, key: str, ts: str, order: str, ttl: float | None = None) -> DataFrame:
    """(key, status, stage, payload, error, upto) after each batch; the row with the largest ``upto`` is a job's state."""
    kind = updates.schema[key].dataType.simpleString()
    out = f"{key} {kind}, status string, stage string, payload string, error string, upto long"
    return _timed(updates, ts).groupBy(key).transformWithState(JobStore(key, ts, order, ttl), out, "Append", "EventTime")


def keepalive_stream(events: DataFrame, key: str, ts: str, order: str, seconds: float = KEEPALIVE_SECONDS) -> DataFrame:
    """(key, order, beats) of each event of the stream."""
    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    out = f"{key} {kinds[key]}, {order} {kinds[order]}, beats long"
    return _timed(events, ts).groupBy(key).transformWithState(KeepAlive(key, ts, order, seconds), out, "Append", "None")


class WorkQueue(StatefulProcessor):
    """The state of each queued id after every event, by the moves that a state allows; other events change nothing.

    A claim that hears nothing for ``stale`` seconds goes back to the queue.  Every error counts a retry.
    """

    def __init__(self, key: str, ts: str, order: str, action: str, stale: float = STALE_MINUTES * 60) -> None:
        self.key, self.ts, self.order, self.action, self.stale = key, ts, order, action, stale

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("held", "status string, retries long, since double")
        self.row = Row(self.key, self.order, "status", "retries", "moved")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        before = status, retries, since = self.held.get() or ("queued", 0, 0.0)
        for row in _in_order(rows, ["_us", self.order]):
            now, action = _seconds(row), row[self.action]
            if status in TRANSITIONAL and now - since > self.stale:
                status = "queued"
            to = MOVES.get((status, action))
            if to:
                status, retries, since = to, retries + (to == "error"), now
            yield self.row(key[0], row[self.order], status, retries, to is not None)
        if (status, retries, since) != before:
            self.held.update((status, retries, since))
            if status in TRANSITIONAL:
                self.handle.registerTimer(int((since + self.stale) * 1000) + 1)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        status, retries, since = self.held.get()
        # A claim made since then has a timer of its own.
        if status in TRANSITIONAL and (since + self.stale) * 1000 < expiredTimerInfo.getExpiryTimeInMs():
            self.held.update(("queued", retries, since))
        return iter(())

    def close(self) -> None:
        pass


def queue_stream(events: DataFrame, key: str, ts: str, order: str, action: str, stale: float = STALE_MINUTES * 60) -> DataFrame:
    """(key, order, status, retries, moved) after each event of the stream, which has a watermark on ``ts``."""
    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    out = f"{key} {kinds[key]}, {order} {kinds[order]}, status string, retries long, moved boolean"
    return _timed(events, ts).groupBy(key).transformWithState(WorkQueue(key, ts, order, action, stale), out, "Append", "EventTime")


def run_available(stream: DataFrame, sink: str, checkpoint: str) -> None:
    """Everything that has arrived, into Parquet files below ``sink``; run again it goes on from ``checkpoint``."""
    stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
