"""Replayed logs against the state of one viewer, and the column model on hand-made rules."""

from __future__ import annotations

import random

from waymark.operators import replay, sheetmodel
from waymark.operators.visibility import FilterState


def played(rows):
    state, facets = FilterState(), set()
    for _, action, item in sorted(rows, key=lambda r: r[0]):
        if action == "clear":
            state = state.clear()
        elif item is None:
            continue
        elif action == "mode":
            state = FilterState(item, state.enabled, state.ids, state.hidden)
        elif action == "toggle":
            facets ^= {item}
        elif action == "select_all":
            state = state.select_all({item})
        elif action in ("select", "deselect", "filter_to", "hide", "unhide"):
            state = getattr(state, action)(item)
    return state.mode, sorted(state.ids), sorted(state.hidden), sorted(facets)


def test_replay_is_the_state_of_each_viewer(spark):
    r = random.Random(5)
    actions = ["select", "select_all", "deselect", "filter_to", "hide", "unhide", "clear", "toggle", "mode", "unknown"]
    logs = {}
    for user in range(60):
        rows = []
        for seq in range(r.randrange(1, 25)):
            action = r.choice(actions)
            item = {"clear": None, "mode": r.choice(["category", "sign-id"])}.get(action, r.choice(["TS1", "TS2", "TS10", "A"]))
            rows.append((seq, action, None if r.random() < 0.05 else item))
        logs[user] = rows
    df = spark.createDataFrame([(u, *row) for u, rows in logs.items() for row in rows] + [(None, 1, "select", "X"), (1, None, "select", "Y")], "user int, seq int, action string, item string").repartition(4)
    got = {s.user: (s.mode, s.picked, s.hidden, s.facets) for s in replay.replayed(df).collect()}
    assert got == {u: played(rows) for u, rows in logs.items()}
    assert replay.replayed(df.where("false")).count() == 0


def rules(spark, xs, ys, width=(0.0, 500.0)):
    v = spark.createDataFrame([(1, x, y0, y1) for x, y0, y1 in xs], "page int, x double, y0 double, y1 double")
    h = spark.createDataFrame([(1, y, *(span or width)) for y, span in ys], "page int, y double, x0 double, x1 double")
    return v, h


def test_groups_rows_and_a_made_group(spark):
    xs = [(10.0, 0.0, 300.0), (340.0, 0.0, 300.0)]  # the frame
    for left in (30.0, 230.0):  # the group at 130 has no dividers
        xs += [(left, 0.0, 290.0), (left + 20, 0.0, 290.0), (left + 70, 0.0, 290.0)]
    xs += [(132.0, 100.0, 290.0), (60.0, 0.0, 30.0)]  # begins below the header; too short
    v, h = rules(spark, xs, [(0.0, None), (1.0, None), (50.0, (30.0, 60.0)), (50.5, (60.0, 500.0)), (53.0, None), (120.0, (30.0, 70.0)), (200.0, None), (305.0, None)])
    framed = sheetmodel.frames(v)
    assert framed.first().top == 0.0
    groups = sheetmodel.column_groups(sheetmodel.boundaries(v, framed)).orderBy("k").collect()
    assert [(g.k, g.no_left, g.no_right, g.sym_right, g.made) for g in groups] == [(0, 30.0, 50.0, 100.0, False), (1, 230.0, 250.0, 300.0, False)]
    cells = sheetmodel.group_rows(sheetmodel.column_groups(sheetmodel.boundaries(v, framed)), h, framed).where("k = 0").orderBy("row").collect()
    # 0 and 1 are one border, 50 is drawn in two parts, 53 makes too thin a band, 120 covers too little, 305 lies below the table
    assert [(c.row, c.top, c.bottom) for c in cells] == [(0, 0.0, 50.0), (1, 53.0, 200.0)]


def test_page_without_number_columns(spark):
    v, _ = rules(spark, [(0.0, 0.0, 100.0), (200.0, 0.0, 100.0)], [])
    groups = sheetmodel.column_groups(sheetmodel.boundaries(v, sheetmodel.frames(v))).orderBy("k").collect()
    # default widths: number columns of 20 at a pitch of 109, symbols of 57
    assert [(g.no_left, g.no_right, g.sym_right, g.made) for g in groups] == [(20.0, 40.0, 97.0, True), (129.0, 149.0, 206.0, True)]
