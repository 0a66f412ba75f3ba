"""Stateful streams that forget: attempts inside a window, cached rows until they expire.

State is kept by key in typed variables; event-time timers clear it once the watermark has
passed what it is good for, so it is bounded by the keys that are live. Rows of a batch come in
chunks of Arrow; late rows are dropped by the watermark before they reach a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from labelloom.operators.timeline import MOVES

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The setting of the session that these jobs need.
SETTINGS = {"spark.sql.streaming.stateStore.providerClass": ROCKS}


def _micros(c: pd.Series) -> np.ndarray:
    return c.to_numpy("datetime64[us]").astype(np.int64)


class Attempts(StatefulProcessor):
    """Times of a key's failures inside the window, since its last success."""

    def __init__(self, seconds: int, most: int):
        self.window, self.most = seconds * 1_000_000, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [(p.event_id.to_numpy(), _micros(p.ts), p.failure.to_numpy(), p.success.to_numpy()) for p in rows]
        event, at, failure, success = (np.concatenate(c) for c in zip(*parts, strict=True))
        seen = [t for (t,) in self.times.get()] if self.times.exists() else []
        out = []
        for i in np.lexsort((event, at)).tolist():
            if success[i]:
                seen = []
            if failure[i]:
                now = int(at[i])
                seen = [t for t in seen if t > now - self.window] + [now]
                out.append((int(event[i]), key[0], np.datetime64(now, "us"), len(seen), len(seen) >= self.most))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        if seen:
            self.times.put([(t,) for t in seen])
            self.handle.registerTimer(-(-(seen[-1] + self.window) // 1000))
        else:
            self.times.clear()
        yield pd.DataFrame(out, columns=["event_id", "key", "ts", "failures", "blocked"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.times.clear()
        return iter([])

    def close(self) -> None:
        pass


def limiter(attempts: DataFrame, seconds: int, most: int, late: str = "0 seconds") -> DataFrame:
    """For each failure the failures of its key in the window before it since the last success, and whether it is blocked.

    attempts: event_id, key, ts, failure, success. A key's state is gone once no failure of it is inside the window.
    """
    rows = attempts.withWatermark("ts", late).groupBy("key")
    return rows.transformWithStateInPandas(Attempts(seconds, most), "event_id long, key long, ts timestamp, failures long, blocked boolean", "Append", "EventTime")


class Entry(StatefulProcessor):
    """A key's cached row, until it expires."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "at long, event long, ttl long")

    def _row(self, key: tuple, at: int, event: int, ttl: int, expired: bool) -> pd.DataFrame:
        return pd.DataFrame([(event, *key, np.datetime64(at, "us"), ttl, expired)], columns=["event_id", "identifier_type", "identifier_value", "cached_at", "ttl", "expired"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = tuple(self.entry.get()) if self.entry.exists() else None
        newest = before
        for p in rows:
            at, event, ttl = _micros(p.cached_at), p.event_id.to_numpy(), p.ttl.to_numpy()
            i = np.lexsort((event, at))[-1]
            row = (int(at[i]), int(event[i]), int(ttl[i]))
            if newest is None or row[:2] > newest[:2]:
                newest = row
        if newest != before:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
            self.entry.update(newest)
            self.handle.registerTimer(-(-(newest[0] + newest[2] * 1_000_000) // 1000))
            yield self._row(key, *newest, False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.entry.exists():
            gone = tuple(self.entry.get())
            self.entry.clear()
            yield self._row(key, *gone, True)

    def close(self) -> None:
        pass


def cache(rows: DataFrame, late: str = "0 seconds") -> DataFrame:
    """Changes of a cache: each key's row whenever a newer one is written, and again, expired, once its time is over.

    rows: event_id, identifier_type, identifier_value, cached_at, ttl (seconds); the last write by time wins.
    """
    keys = rows.withWatermark("cached_at", late).groupBy("identifier_type", "identifier_value")
    return keys.transformWithStateInPandas(Entry(), "event_id long, identifier_type string, identifier_value string, cached_at timestamp, ttl long, expired boolean", "Append", "EventTime")


class Review(StatefulProcessor):
    """The state of a review; a move that is not legal leaves it as it is."""

    def __init__(self, moves: dict[str, tuple[str, ...]]):
        self.legal = {(a, b) for a, to in moves.items() for b in to}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "status string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [(p.event_id.to_numpy(), _micros(p.ts), p.status.to_numpy()) for p in rows]
        event, at, status = (np.concatenate(c) for c in zip(*parts, strict=True))
        now = self.state.get()[0] if self.state.exists() else None
        out = []
        for i in np.lexsort((event, at)).tolist():
            legal = now is None or now == status[i] or (now, status[i]) in self.legal
            out.append((int(event[i]), key[0], status[i], now, legal))
            now = status[i] if legal else now
        self.state.update((now,))
        yield pd.DataFrame(out, columns=["event_id", "review_id", "status", "before", "legal"])

    def close(self) -> None:
        pass


def review_workflow(log: DataFrame) -> DataFrame:
    """Every move of a review with the state it meets and whether it is legal; what is not is never the next state.

    log: event_id, review_id, ts, status. A review's first status is taken as it is.
    """
    schema = "event_id long, review_id long, status string, before string, legal boolean"
    return log.groupBy("review_id").transformWithStateInPandas(Review(MOVES), schema, "Append", "None")
