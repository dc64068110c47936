"""Dual-tree search against all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from waymark.llm import hardneg, queries
from waymark.llm.hardneg import State, Tree, hard_negatives, leaf_pairs, share

SCHEMA = "vec_id long, label string, embedding array<double>, node long, part int, state binary"


def brute(rows, every=50, positives=5, negatives=3, low=50, high=95):
    """The contract in plain Python integers."""
    use = [(i, lab, [int(np.floor(256 * x)) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, lab, v in use:
        if a % every:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(v, w, strict=True)), i, other) for i, other, w in use if len(w) == len(v)), key=lambda t: t[:2])
        for s, p, _ in [t for t in scored if t[2] == lab and t[1] != a][:positives]:
            fits = [t for t in scored if t[2] != lab and low * -s <= 100 * -t[0] <= high * -s]
            out += [(a, p, k + 1, i, -s, -t) for k, (t, i, _) in enumerate(fits[:negatives])]
    return sorted(out)


def made(n, dims, seed, centres=6, spread=0.05):
    r = np.random.default_rng(seed)
    c = r.normal(size=(centres, dims))
    return [(i, f"l{r.integers(4)}", (c[r.integers(centres)] + spread * r.normal(size=dims)).tolist()) for i in range(n)]


def run(spark, rows, **how):
    df = spark.createDataFrame([(*r, 1, 2, None) for r in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in hard_negatives(df, **how).collect())


@pytest.mark.parametrize(("dims", "spread"), [(8, 0.05), (16, 2.0), (3, 0.3)])
def test_equals_all_pairs(spark, monkeypatch, dims, spread):
    for name, value in {"LEAF": 16, "PART_ROWS": 64, "FAN": 2, "FIRST": 2}.items():
        monkeypatch.setattr(hardneg, name, value)
    rows = made(900, dims, dims, spread=spread)
    found = run(spark, rows, every=20)
    assert found == brute(rows, every=20)
    assert found


def test_odd_rows(spark):
    rows = made(120, 4, 1)
    rows += [(None, "l0", [1.0] * 4), (150, None, [1.0] * 4), (200, "l1", None), (250, "l1", []), (300, "l1", [1.0, None, 1.0, 1.0]), (350, "l1", [float("nan")] * 4), (400, "l1", [float("inf"), 1.0, 1.0, 1.0])]
    rows += [(450, "l1", [1.0, 2.0]), (451, "l1", [1.5, 2.0]), (452, "l2", [1.0, 1.5]), (500, "l1", [0.0] * 4), (501, "l1", [0.0] * 4), (502, "l2", [0.0] * 4)]
    rows += [(600 + k, "l3", [0.5, 0.5, 0.5, 0.5]) for k in range(8)] + [(700, "l0", [-1.0] * 4), (750, "lonely", [1.0] * 4)]
    assert run(spark, rows) == brute(rows)


def test_wide_components_stay_exact(spark):
    r = np.random.default_rng(5)
    rows = [(i, f"l{i % 3}", (r.normal(size=6) * 10.0 ** r.integers(0, 6)).tolist()) for i in range(200)]
    assert run(spark, rows) == brute(rows)
    huge = [*rows, (1000, "l0", [1e200] * 6), (1050, "l1", [1e18] * 6)]  # too long for exact products: no part
    assert run(spark, huge) == brute(rows)


def test_repeats_and_nothing(spark):
    rows = [*made(60, 4, 2), *made(60, 4, 2)[:3]]
    assert run(spark, rows, every=10) == brute(rows, every=10)
    assert run(spark, []) == []
    assert run(spark, made(40, 4, 3)[1:], every=1000) == []


def test_intervals_prune_whole_groups():
    r = np.random.default_rng(0)
    leaves = [np.eye(8)[k % 8] * 100 + r.normal(size=(20, 8)) for k in range(64)]
    bounds = [hardneg._bound(x) for x in leaves]
    label = np.arange(64) % 2 * 2
    tree = Tree(np.stack([b[0] for b in bounds]), np.array([b[1] for b in bounds]), np.array([b[2] for b in bounds]), label, label)
    i, j = leaf_pairs(tree, tree, np.full(64, 9000), np.full(64, 10**9), True)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(a, b) for a in range(64) for b in range(64) if (a - b) % 8 == 0}
    scores = np.array([[(a @ b.T).max() for b in leaves] for a in leaves])
    low = np.full(64, 500)
    i, j = leaf_pairs(tree, tree, low, np.full(64, 10**9), False)
    need = {(a, b) for a in range(64) for b in range(64) if scores[a, b] >= 500 and (a - b) % 2}
    assert need <= set(zip(i.tolist(), j.tolist(), strict=True))


def test_state_keeps_the_best_and_ties_by_id():
    s = State(2, 1, 3)
    s.add(np.array([0, 0, 0, 0, 1]), np.zeros(5, int), np.array([5, 7, 7, 5, -3]), np.array([9, 4, 2, 1, 8]))
    s = State.unpack(s.pack())
    assert s.id[0, 0].tolist() == [2, 4, 1]
    assert s.score[1, 0, 0] == -3
    assert s.need()[0, 0] == 5


def test_shares_round_inward():
    x = np.array([100, 101, 19, 0, -7, 2**62])
    assert share(x, 50, True).tolist() == [-(-int(v) * 50 // 100) for v in x]
    assert share(x, 95, False).tolist() == [int(v) * 95 // 100 for v in x]


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.vec_id, str((r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label), list(r.embedding)) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in queries.op11_dual_tree_negatives(spark, d).collect()) == brute(rows)
