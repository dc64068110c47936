"""Stateful processors whose results come by event-time timers.

State is small and closes by itself: a user's open runs of events, with one timer at the
time from which nothing can be added to the first of them.  When it is up, all runs that
the watermark has passed are given at once, so calls follow users, not runs.  Rows of a
batch may come in any order.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that timers need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_RUNS = "starts array<long>, ends array<long>, counts array<long>, ids array<long>, types array<string>"


class Runs(StatefulProcessor):
    """A user's runs of events less than a gap apart; each is given once the watermark passes its end by the gap.

    ``emit`` makes a row of a closed run: user, start, end (microseconds), events, and id and type of the last one.
    """

    def __init__(self, gap_seconds: int, emit):
        self.gap, self.emit = gap_seconds * 1_000_000, emit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("runs", _RUNS)

    def _load(self) -> list[list]:
        return [list(r) for r in zip(*self.state.get(), strict=True)] if self.state.exists() else []

    def _store(self, runs: list[list]) -> None:
        if runs:
            self.state.update(tuple(list(c) for c in zip(*runs, strict=True)))
        else:
            self.state.clear()

    def _timer(self, run: list) -> int:
        return -(-(run[1] + self.gap) // 1000)

    def _first_timer(self, runs: list[list]) -> int | None:
        return min(map(self._timer, runs), default=None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        runs = self._load()
        before = self._first_timer(runs)
        for frame in rows:
            at = frame["at"].to_numpy("datetime64[us]").astype("int64").tolist()
            runs += [[t, t, 1, ident, kind] for t, ident, kind in zip(at, frame["event_id"].tolist(), frame["event_type"].tolist(), strict=True)]
        runs = self._merged(runs)
        after = self._first_timer(runs)
        if before != after:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(after)
        self._store(runs)
        return iter(())

    def _merged(self, parts: list[list]) -> list[list]:
        """Runs and single events, those less than the gap apart as one; in order of their starts."""
        runs: list[list] = []
        for own in sorted(parts, key=lambda r: r[:2]):
            if runs and own[0] < runs[-1][1] + self.gap:
                r = runs[-1]
                last = max(r, own, key=lambda x: (x[1], x[3]))
                runs[-1] = [r[0], last[1], r[2] + own[2], last[3], last[4]]
            else:
                runs.append(own)
        return runs

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        runs = self._load()
        left = [r for r in runs if self._timer(r) > now]
        self._store(left)
        if left:
            self.handle.registerTimer(self._first_timer(left))
        closed = [self.emit(key[0], *r) for r in sorted(runs) if self._timer(r) <= now]
        if closed:
            yield pd.DataFrame(closed)

    def close(self) -> None:
        pass


def _timed(events: DataFrame, late: str) -> DataFrame:
    if not events.isStreaming:
        raise ValueError("timers need a stream")
    return events.where("user_id is not null and at is not null").select("user_id", "at", "event_id", "event_type").withWatermark("at", late)


@contextmanager
def timer_store(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside use the state store that timers need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, STORE)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def _last(user: int, start: int, end: int, n: int, event_id: int, event_type: str) -> dict:
    return {"user_id": user, "event_id": event_id, "event_type": event_type}


def _whole(user: int, start: int, end: int, n: int, event_id: int, event_type: str) -> dict:
    return {"user_id": user, "start": pd.Timestamp(start, unit="us"), "last_at": pd.Timestamp(end, unit="us"), "n": n}


def debounced_stream(events: DataFrame, gap_seconds: int = 1800, late: str = "10 minutes") -> DataFrame:
    """user_id, event_id and event_type of each event that nothing of its user follows within the gap, once that is certain."""
    runs = Runs(gap_seconds, _last)
    return _timed(events, late).groupBy("user_id").transformWithStateInPandas(runs, "user_id long, event_id long, event_type string", "Append", "EventTime")


def runs_stream(events: DataFrame, gap_seconds: int = 1800, late: str = "10 minutes") -> DataFrame:
    """user_id, start, last_at and n of each run of events less than the gap apart, once it is closed."""
    runs = Runs(gap_seconds, _whole)
    return _timed(events, late).groupBy("user_id").transformWithStateInPandas(runs, "user_id long, start timestamp, last_at timestamp, n long", "Append", "EventTime")
