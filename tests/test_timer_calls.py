"""Timers follow users, not runs."""

from __future__ import annotations

import pandas as pd

from waymark.streaming import timers


class Handle:
    """Counts timers; its state holds one value."""

    def __init__(self):
        self.timers, self.calls, self.value = set(), 0, None

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, t):
        self.calls += 1
        self.timers.add(t)

    def deleteTimer(self, t):
        self.calls += 1
        self.timers.discard(t)


class At:
    def __init__(self, t):
        self.t = t

    def getExpiryTimeInMs(self):
        return self.t

    def getCurrentWatermarkInMs(self):
        return self.t


def test_one_timer_a_user_closes_all_runs_that_the_watermark_passed():
    handle, runs = Handle(), timers.Runs(60, timers._whole)
    runs.init(handle)
    at = pd.to_datetime([k * 100 for k in range(500)][::-1], unit="s")
    frame = pd.DataFrame({"at": at, "event_id": range(500), "event_type": "a"})
    assert not list(runs.handleInputRows((7,), iter([frame[:300], frame[300:]]), None))
    assert handle.timers == {60_000} and handle.calls == 1
    handle.timers.clear()
    given = pd.concat(runs.handleExpiredTimer((7,), At(40_060_000), At(60_000)))
    assert len(given) == 401 and handle.timers == {40_160_000} and handle.calls == 2
    assert list(runs.handleInputRows((7,), iter([pd.DataFrame({"at": pd.to_datetime([40_050], unit="s"), "event_id": [900], "event_type": ["b"]})]), None)) == []
    handle.timers.clear()
    rest = pd.concat(runs.handleExpiredTimer((7,), At(99_000_000), At(40_160_000)))
    assert rest["n"].tolist() == [2] + [1] * 98 and not handle.timers and handle.value is None
