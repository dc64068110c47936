"""Only first members of assemblies are searched for their line, and coverage only asks whether a line is near."""

from __future__ import annotations

import random

from tests.conftest import SMALL
from waymark.operators import assemblies, nearest
from waymark.plans import registry


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_stacks_are_not_shuffled_by_feature(spark):
    plan = _plan(registry.QUERIES["assembly_stack"](spark, SMALL))
    assert "hashpartitioning(gg" in plan and "hashpartitioning(fid" not in plan


def test_coverage_ranks_nothing(spark):
    plan = _plan(registry.QUERIES["bearing_coverage"](spark, SMALL))
    assert "LeftSemi" in plan and "Window" not in plan


def _scene(spark):
    r = random.Random(3)
    lines = [(i, x := r.uniform(-300, 300), y := r.uniform(-300, 300), x + r.uniform(-1, 1) * 10 ** r.uniform(0, 2.5), y + r.uniform(-1, 1) * 10 ** r.uniform(0, 2.5)) for i in range(60)]
    lines += [(60, 0.0, 0.0, 0.0, 300.0), (61, -300.0, 100.0, 300.0, 100.0), (62, 5.0, 5.0, 6.0, 6.0)]
    points = [(f"p{i}", r.uniform(-320, 320), r.uniform(-320, 320)) for i in range(600)] + [("p0", 0.0, 50.0), (None, 0.0, 50.0), ("lost", None, 0.0), ("edge", 25.0, 100.0)]
    return spark.createDataFrame(points, "fid string, x double, y double"), spark.createDataFrame(lines, "seg_id long, ax double, ay double, bx double, by double"), points, lines


def test_cells_miss_no_line(spark):
    points, lines, p, s = _scene(spark)
    best: dict[str, tuple[float, int]] = {}
    for fid, x, y in p:
        for seg, ax, ay, bx, by in s:
            dx, dy = bx - ax, by - ay
            if fid is None or x is None or dx * dx + dy * dy < 9:
                continue
            t = max(0.0, min(1.0, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy)))
            d = ((x - ax - t * dx) ** 2 + (y - ay - t * dy) ** 2) ** 0.5
            if d < 25:
                best[fid] = min(best.get(fid, (d, seg)), (d, seg))
    got = {r["fid"]: r["seg_id"] for r in nearest.nearest_segments(points, lines).collect()}
    assert got == {k: v[1] for k, v in best.items()}
    assert sorted(r["fid"] for r in nearest.near_segments(points, lines).collect()) == sorted(best)


def test_lines_give_the_bearings_of_first_members(spark):
    points, lines, _, _ = _scene(spark)
    signs = points.selectExpr("fid", "concat('g', floor(x / 14), ',', floor(y / 14)) gg", "if(crc32(fid) % 2 = 0, 'A', 'B') sign_id", "x", "y")
    signs = signs.union(signs.where("fid in ('p5', 'p9')"))  # repeated rows
    codes = spark.createDataFrame([("A", "warning", 1, 60, 120), ("B", "regulatory", 0, 90, 120)], "code string, grp string, tier int, w int, h int")
    members = assemblies.catalogued_members(signs.where("fid <> 'p0'"), codes)
    every = nearest.face_bearings(nearest.nearest_segments(points, lines))
    some, all_ = (sorted(map(str, df.collect())) for df in (assemblies.stack_assemblies(members, lines=lines), assemblies.stack_assemblies(members, every)))
    assert some == all_ and any("stack_bearing=None" not in row for row in some)
