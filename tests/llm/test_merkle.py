"""The manifest against a plain tree, and the monoid's laws."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from waymark.llm import merkle, queries
from waymark.llm.merkle import Forest, fold, leaf_digest, merkle_manifest, proof_digest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(*fields):
    return h(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def climb(nodes, place):
    """Root of a list and the siblings of one place, level by level."""
    steps = []
    while len(nodes) > 1:
        first = place // 3 * 3
        steps.append(("".join(nodes[first:place]), "".join(nodes[place + 1 : first + 3])))
        nodes, place = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)], place // 3
    return nodes[0], steps


def plain(rows):
    """doc_id, leaf, subroot, root, steps of (doc_id, source, text) rows, sorted."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0], plain_leaf(*r)))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    subs = [climb([leaf for _, leaf in groups[g]], 0)[0] for g in order]
    out = []
    for k, g in enumerate(order):
        root, top = climb(subs, k)
        out += [(str(i), leaf, subs[k], root, tuple(climb([x for _, x in groups[g]], p)[1] + top)) for p, (i, leaf) in enumerate(groups[g])]
    return sorted(out)


def found(spark, rows, schema="doc_id long, source string, text string, part long, place long, kind string, leaf string", extra=(1, 2, "x", "y")):
    df = spark.createDataFrame([(*r, *extra) for r in rows], schema).repartition(5)
    got = merkle_manifest(df, "doc_id", "source", leaf_digest(*(F.col(c) for c in ("doc_id", "source", "text"))))
    got = got.withColumn("folded", fold(F.col("leaf"), F.col("proof"))).withColumn("p", proof_digest(F.col("proof")))
    out = []
    for r in got.collect():
        steps = tuple((s.before, s.after) for s in r.proof)
        assert r.folded == r.root
        assert r.p == h(*(b + e for b, e in steps))
        out.append((str(r.doc_id), r.leaf, r.subroot, r.root, steps))
    return sorted(out)


def test_equals_plain_tree(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEAVES", 16)
    monkeypatch.setattr(merkle, "LEAST_LEAVES", 4)
    monkeypatch.setattr(merkle, "FAN", 2)
    r = random.Random(1)
    rows = [(i, r.choice(["hot"] * 6 + ["é", "z", "", None, "Z"]), "t" * r.randrange(3)) for i in range(331)]
    rows += [(1000 + i, f"own{i}", None) for i in range(40)]
    assert found(spark, rows) == plain(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 10, 28])
def test_small_trees(spark, n):
    for rows in ([(i, "a", "x\ny") for i in range(n)], [(i, f"s{i}", "") for i in range(n)]):
        assert found(spark, rows) == plain(rows)


def test_repeats_nulls_and_nothing(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEAVES", 8)
    rows = [(7, "a", "same")] * 30 + [(None, None, None)] * 5 + [(7, "a", "other"), (None, "a", "\n")]
    assert found(spark, rows) == plain(rows)
    assert found(spark, []) == []


def test_merging_is_associative():
    r = random.Random(3)
    leaves = {g: [h(str((g, i))) for i in range(n)] for g, n in enumerate((50, 1, 9, 27, 2))}
    nodes = [(g, len(x), 0, i, v) for g, x in leaves.items() for i, v in enumerate(x)]
    want = climb([climb(x, 0)[0] for x in leaves.values()], 0)[0]

    def forest(rows):
        f = Forest(5)
        for row in rows:
            f.add(*row)
        return [(t, total, level, i, v) for (t, level, i), (total, v) in f.open.items()]

    for _ in range(20):
        r.shuffle(nodes)
        parts = [nodes[k::7] for k in range(7)]
        while len(parts) > 1:
            r.shuffle(parts)
            parts = [forest([*parts[0], *forest(parts[1])]), *parts[2:]]
        (root,) = forest(parts[0])
        assert root[0] == merkle.TOP
        assert root[4] == want


def test_query_finds_every_tampered_row(spark):
    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    for r in queries.op12_merkle_manifest(spark, d).collect():
        assert r.verified == (zlib.crc32(str(r.doc_id).encode()) % 2 == 1 or "\n" not in docs[r.doc_id])
