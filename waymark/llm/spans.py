"""Spans of a text as ``kind:start:end`` lists and their digests."""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort

#: kind, start and end of a span in code points, end exclusive
Span = tuple[str, int, int]


def joined(spans: list[Span], order: list[str]) -> str:
    """``kind:start:end`` by start, then kind in the order given, comma-joined."""
    rank = {k: i for i, k in enumerate(order)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], rank[s[0]], s[2])))


def digest(spans: list[Span], order: list[str]) -> str:
    """Lowercase SHA-256 of the joined spans."""
    return hashlib.sha256(joined(spans, order).encode()).hexdigest()


class Cover:
    """Which places some spans take, by binary search."""

    def __init__(self, spans: list[Span]):
        self.starts: list[int] = []
        self.reach: list[int] = []  # the furthest end of all spans up to this one
        for _, a, b in sorted(spans, key=lambda s: s[1]):
            self.starts.append(a)
            self.reach.append(max(b, self.reach[-1]) if self.reach else b)
        self.added: list[tuple[int, int]] = []

    def touches(self, a: int, b: int) -> bool:
        """Whether ``[a, b)`` overlaps a span or an added one."""
        i = bisect_left(self.starts, b)
        if i and self.reach[i - 1] > a:
            return True
        i = bisect_left(self.added, (b, b))
        return bool(i) and self.added[i - 1][1] > a

    def add(self, a: int, b: int) -> None:
        """Take a place that nothing touches."""
        insort(self.added, (a, b))
