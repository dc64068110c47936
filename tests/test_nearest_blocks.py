"""Nearest lines out of blocks: as many places and lines as there may be in one cell, ties, and no pair is shuffled."""

from __future__ import annotations

import random

import pytest

from waymark.functions.geo import projected
from waymark.operators import nearest


@pytest.mark.parametrize(("n", "side"), [(60, 60.0), (400, 900.0), (300, 40.0)])
def test_equals_all_pairs(spark, n, side):
    r = random.Random(n)
    at = lambda: r.uniform(-side, side)
    points = [(f"p{i % (n - 5)}", at(), at()) for i in range(n)] + [(None, 1.0, 1.0), ("lost", None, 1.0), ("far", float("inf"), 0.0)]
    lines = [(f"s{r.randrange(n)}", x, y, x + r.uniform(-90, 90), y + r.uniform(-9, 9)) for x, y in ((at(), at()) for _ in range(n))]
    lines += [("t0", *lines[0][1:]), ("long", -side, -side, side * 3, side), ("short", 0.0, 0.0, 1.0, 1.0)]
    p = spark.createDataFrame(points, "fid string, x double, y double")
    s = spark.createDataFrame(lines, "seg_id string, ax double, ay double, bx double, by double")
    wide = p.where("fid is not null and x is not null").join(s.where("(bx - ax) * (bx - ax) + (`by` - ay) * (`by` - ay) >= 9"), how="cross")
    d = projected(*(wide[c] for c in ("x", "y", "ax", "ay", "bx", "by")))[2]
    want = {}
    for row in wide.select("fid", d.alias("d"), "seg_id", "x", "y").where("d < 25").collect():
        want[row.fid] = min(want.get(row.fid, (99.0, "")), (row.d, row.seg_id))
    got = {row.fid: (row.d, row.seg_id) for row in nearest.nearest_segments(p, s).collect()}
    assert got == want
    turned = {tuple(x) for x in nearest.face_bearings(nearest.nearest_segments(p, s)).collect()}
    assert {tuple(x) for x in nearest.nearest_bearings(p, s).collect()} == turned and len(turned) == len(want)


def test_no_pair_is_ranked_or_shuffled(spark):
    p = spark.range(9).selectExpr("cast(id as string) fid", "id * 1e0 x", "0e0 y")
    s = spark.range(9).selectExpr("id seg_id", "id * 1e0 ax", "1e0 ay", "id * 1e0 bx", "9e0 `by`")
    for df in (nearest.nearest_segments(p, s), nearest.nearest_bearings(p, s)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan
        assert "Join" not in plan


def test_enrichment_searches_lines_for_the_sign_layer_and_first_members_only(spark):
    from waymark.plans import registry

    for name in ("enriched_features", "draw_order"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 2
