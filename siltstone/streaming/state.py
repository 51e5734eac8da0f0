"""Queue, cache and slot state: batch replay over event tables, and the same rules as Structured Streaming.

Rules in which a refused event leaves no trace (a slot that was not granted, a hit that does not renew a time to live)
are folds, not windows.  Rows are sorted by key inside partitions and folded batch by batch; what a fold carries from one
batch to the next is the state of one key, a few numbers, so no key's history is ever held.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STALE_MINUTES, TRANSITIONAL, CACHE_SECONDS, SLOTS, JOB_SECONDS, JOB_CAP = 60, ("fetching", "parsing"), 60, 3, 1200, 4096


def latest_state(events: DataFrame, key: str, status: str, order: list[str]) -> DataFrame:
    """(key, status, ts): each key's last event."""
    last = F.max_by(F.struct(F.col(status).alias("status"), F.col(order[0]).alias("ts")), F.struct(*order))
    return events.groupBy(key).agg(last.alias("s")).select(key, "s.status", "s.ts")


def reset_stale(states: DataFrame, as_of: Column, transitional: tuple[str, ...] = TRANSITIONAL, minutes: int = STALE_MINUTES) -> DataFrame:
    """States with ``reset``: transitional ones older than ``minutes`` go back to queued; exactly that old ones stay."""
    old = F.col("status").isin(*transitional) & (F.col("ts") < as_of - F.expr(f"INTERVAL {minutes} MINUTES"))
    return states.withColumn("reset", old).withColumn("status", F.when(old, "queued").otherwise(F.col("status")))


def claim(states: DataFrame, key: str, queued: str = "queued", n: int = 200) -> DataFrame:
    """The n queued keys that wait longest, ties by key."""
    return states.where(F.col("status") == queued).orderBy("ts", key).limit(n)


def _folded(rows: DataFrame, key: str, order: list[str], step, begin, out: list[tuple[str, str]], keep: list[str]) -> DataFrame:
    """``keep`` and ``out`` of every row: ``step(state, row) -> (state, values)`` runs over each key's rows in order."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + [f"`{c}` {kind}" for c, kind in out])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, begin
        for frame in frames:
            found: list[tuple] = []
            for k, row in zip(frame[key].tolist(), frame.itertuples(index=False), strict=True):
                if last is None or k != last[0]:
                    last, state = (k,), begin
                state, values = step(state, row)
                found.append(values)
            got = pd.DataFrame(found, columns=[c for c, _ in out], index=frame.index)
            yield pd.concat([frame[keep], got], axis=1)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def cache_replay(events: DataFrame, key: str, second: str, order: str, ttl: float = CACHE_SECONDS, action: str | None = None) -> DataFrame:
    """(key, order, hit): a hit within ``ttl`` of the key's last fill, its end excluded; a hit does not renew it.

    With ``action`` a row may be ``missing`` (a lookup that finds nothing: never cached, and what was cached goes if it is
    over) or ``invalidate`` (what is cached goes; never a hit); others are lookups that find the key.
    """

    def step(until: float | None, row) -> tuple[float | None, tuple[bool]]:
        now, what = row[1], row[3]
        hit = what != "invalidate" and until is not None and now < until
        if what == "invalidate":
            return None, (False,)
        return (until if hit else None if what == "missing" else now + ttl), (hit,)

    rows = events.select(key, second, order, F.coalesce(F.col(action), F.lit("")).alias("_action") if action else F.lit("").alias("_action"))
    return _folded(rows, key, [second, order], step, None, [("hit", "boolean")], [key, order])


def slot_replay(events: DataFrame, key: str, action: str, order: str, slots: int = SLOTS) -> DataFrame:
    """(key, order, granted, held): ``acquire`` is refused while ``slots`` are held; other actions release one.

    Rows lie in ranges of key and order, so a hot key has as many tasks as it needs.  What a run of rows does to the number
    held is a step between two bounds, and such steps compose to one: each range tells what it does to the key that it ends
    with, a scan over the ranges gives what each begins with, and a second pass fills the rows in.  A null key is a key.
    """
    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    take = F.coalesce(F.col(action) == "acquire", F.lit(False))
    rows = events.select(key, order, take.alias("_take"), F.to_json(F.struct(F.col(key).alias("k"))).alias("_key"))
    laid = rows.repartitionByRange(key, order).sortWithinPartitions(key, order).withColumn("_range", F.spark_partition_id()).checkpoint()

    def effects(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = first = last = None
        low, high, shift = 0, slots, 0
        for frame in frames:
            keys = frame["_key"].to_numpy()
            if not len(keys):
                continue
            if first is None:
                place, first, last = int(frame["_range"].iloc[0]), keys[0], keys[0]
            other = np.flatnonzero(keys != keys[-1])
            begin = int(other[-1]) + 1 if len(other) else 0
            if begin or keys[0] != last:
                low, high, shift = 0, slots, 0
            last = keys[-1]
            for up in frame["_take"].to_numpy()[begin:].tolist():
                if up:
                    low, high, shift = min(low + 1, slots), min(high + 1, slots), shift + 1
                else:
                    low, high, shift = max(low - 1, 0), max(high - 1, 0), shift - 1
        if first is not None:
            yield pd.DataFrame({"place": [place], "first": [first], "last": [last], "low": [low], "high": [high], "shift": [shift]})

    # As many rows as ranges.
    found = laid.mapInPandas(effects, "place int, first string, last string, low int, high int, shift long").collect()
    begins, carried = {}, (None, 0)
    for r in sorted(found, key=lambda r: r["place"]):
        held = begins[r["place"]] = carried[1] if r["first"] == carried[0] else 0
        held = held if r["first"] == r["last"] else 0
        carried = r["last"], min(r["high"], max(r["low"], held + r["shift"]))

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, 0
        for frame in frames:
            granted, after = [], []
            for k, up, place in zip(frame["_key"].tolist(), frame["_take"].tolist(), frame["_range"].tolist(), strict=True):
                if k != last:
                    held = begins[place] if last is None else 0
                    last = k
                ok = held < slots if up else held > 0
                held += (1 if up else -1) if ok else 0
                granted.append(ok)
                after.append(held)
            yield pd.DataFrame({key: frame[key], order: frame[order], "granted": granted, "held": after})

    return laid.mapInPandas(fill, f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, granted boolean, held int")


def gaps(events: DataFrame, key: str, ts: str, order: str, least_seconds: float) -> DataFrame:
    """Each event with the seconds since the key's previous one and whether that is too soon."""
    before = F.lag(ts).over(Window.partitionBy(key).orderBy(ts, order))
    seconds = F.timestamp_diff("MICROSECOND", before, F.col(ts)) / 1e6
    return events.withColumn("gap", seconds).withColumn("throttled", F.coalesce(F.col("gap") < least_seconds, F.lit(False)))


def live_jobs(jobs: DataFrame, job: str, created: str, now: Column, ttl: int = JOB_SECONDS, cap: int = JOB_CAP) -> DataFrame:
    """Jobs younger than ``ttl`` seconds, of these the ``cap`` newest: what the store still answers for."""
    young = jobs.where(F.timestamp_diff("SECOND", F.col(created), now) < ttl)
    return young.orderBy(F.desc(created), F.desc(job)).limit(cap)


def last_token(results: DataFrame, key: str, token: str, value: str) -> DataFrame:
    """Only the result of the largest token of a key is applied."""
    return results.groupBy(key).agg(F.max_by(value, token).alias(value))


def slot_stream(events: DataFrame, key: str, action: str, slots: int = SLOTS, idle_ms: int = 86_400_000) -> DataFrame:
    """(key, action, granted, held) of a stream, by arbitrary state for each key; rows are taken in arrival order.

    The state of a key without events for ``idle_ms`` of processing time is dropped: its holders count as gone.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = state.get[0] if state.exists else 0
        for frame in frames:
            granted, after = [], []
            for what in frame[action]:
                ok = held < slots if what == "acquire" else held > 0
                held += (1 if what == "acquire" else -1) if ok else 0
                granted.append(ok)
                after.append(held)
            yield pd.DataFrame({key: frame[key], action: frame[action], "granted": granted, "held": after})
        state.update((held,))
        state.setTimeoutDuration(idle_ms)

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {action} string, granted boolean, held int", "held int", "append", GroupStateTimeout.ProcessingTimeTimeout)


def windowed_counts(events: DataFrame, ts: str, kind: str, width: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """(window_start, kind, n): tumbling or sliding counts; with ``late`` a watermark lets a stream end its windows."""
    rows = events.withWatermark(ts, late) if late else events
    return rows.groupBy(F.window(ts, width, slide) if slide else F.window(ts, width), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), kind, "n")


def sessions(events: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """(key, session_start, n): bursts of events without a pause of ``gap``."""
    return events.groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("session_start"), "n")
