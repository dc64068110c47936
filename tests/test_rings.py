"""Nearest lines at any distance against all pairs."""

from __future__ import annotations

import math
import random

from waymark.operators import rings

SEGMENT = "seg_id int, ax double, ay double, bx double, by double"


def distance(p, s):
    _, ax, ay, bx, by = s
    dx, dy = bx - ax, by - ay
    t = max(0.0, min(1.0, ((p[0] - ax) * dx + (p[1] - ay) * dy) / (dx * dx + dy * dy)))
    return math.hypot(p[0] - (ax + t * dx), p[1] - (ay + t * dy))


def brute(points, segments, k):
    out = []
    for fid, x, y in points:
        best = sorted((distance((x, y), s), s[0]) for s in segments if (s[3] - s[1]) ** 2 + (s[4] - s[2]) ** 2 >= 9)[:k]
        out += [(fid, i + 1, seg, round(d, 6)) for i, (d, seg) in enumerate(best)]
    return sorted(out)


def found(spark, points, segments, k):
    p, s = spark.createDataFrame(points, "fid int, x double, y double"), spark.createDataFrame(segments, SEGMENT)
    return sorted((r[0], r[1], r[2], round(r[3], 6)) for r in rings.k_nearest(p, s, k).collect())


def made(seed):
    r = random.Random(seed)
    segments = []
    for i in range(150):  # a dense core, a few far off, some very long
        x, y = (r.gauss(0, 40), r.gauss(0, 40)) if i < 110 else (r.uniform(-9000, 9000), r.uniform(-9000, 9000))
        length = 2500 if i % 30 == 0 else r.uniform(2, 30)
        turn = r.uniform(0, 7)
        segments.append((i, x, y, x + length * math.cos(turn), y + length * math.sin(turn)))
    points = [(j, r.gauss(0, 60), r.gauss(0, 60)) for j in range(40)] + [(100 + j, r.uniform(-30000, 30000), r.uniform(-9000, 9000)) for j in range(25)]
    return points, segments


def test_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(rings, "CROWD", 7)
    points, segments = made(1)
    assert found(spark, points, segments, 1) == brute(points, segments, 1)
    assert found(spark, points, segments, 5) == brute(points, segments, 5)


def test_ties_few_lines_and_odd_rows(spark):
    segments = [(5, 0.0, 0.0, 10.0, 0.0), (3, 0.0, 0.0, 10.0, 0.0), (4, 0.0, 20.0, 10.0, 20.0), (9, 0.0, 0.0, 1.0, 0.0), (None, 0.0, 0.0, 9.0, 0.0), (8, None, 0.0, 9.0, 0.0)]
    points = [(1, 5.0, 10.0), (2, 1e6, -1e6), (None, 1.0, 1.0), (4, None, 1.0), (5, float("nan"), 1.0), (1, 5.0, 10.0)]
    good = [p for p in points if p[0] in (1, 2)]
    assert found(spark, points, segments, 9) == brute(good, [s for s in segments if None not in s], 9)
    assert [r[2] for r in found(spark, points[:1], segments, 3)] == [3, 4, 5]
    assert found(spark, points, segments[3:4], 1) == []
    assert found(spark, points[2:3], segments, 1) == []
