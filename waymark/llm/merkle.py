"""A Merkle manifest of a table: leaf, subtree root and root digests, and every row's inclusion proof.

Each group of rows is a tree whose runs of ``ARITY`` consecutive nodes (the last
run may be shorter) become their hash, level by level; the roots of the groups,
in the order of the groups, are the leaves of one more tree.

Rows are hashed by Spark SQL, dealt by range in tree order and numbered by
counts.  A partition then is a sparse forest: nodes keyed by tree, level and
index.  Merging two forests is a union in which every run that is complete (its
length is known from the number of leaves) collapses into its parent, a finished
tree becoming a leaf of the tree of groups; this is associative, so forests are
merged by a tree reduction in rounds, each written before the next.  What is
still open in a partition are a few nodes per level at its two ends, so rounds
carry little whatever the table's size.  Nodes that the rounds make are kept as
the spine, from which a partition gets the siblings that lie outside it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.plans.staging import Stage

#: Nodes of a whole run.
ARITY = 3
#: Leaves of a partition at most by plan, and at least; forests that one task merges.
LEAVES, LEAST_LEAVES, FAN = 32_768, 2048, 32
#: The number of the tree of groups; other trees are numbered by the rank of their group.
TOP = -1

_NODES = "part long, kind string, tree long, total long, level int, idx long, digest string"


def digest(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def counts(total: int) -> list[int]:
    """Nodes of each level of a tree of ``total`` leaves."""
    out = [total]
    while out[-1] > 1:
        out.append(-(-out[-1] // ARITY))
    return out


class Forest:
    """Unresolved nodes of some part of the trees."""

    def __init__(self, groups: int):
        self.groups = groups
        self.open: dict[tuple[int, int, int], tuple[int, str]] = {}
        self.made: list[tuple[int, int, int, int, str]] = []
        self._counts: dict[int, list[int]] = {}

    def add(self, tree: int, total: int, level: int, idx: int, value: str) -> None:
        """Take a node in; runs that it completes become their parents."""
        while True:
            self.open[tree, level, idx] = (total, value)
            width = self._counts.setdefault(total, counts(total))[level]
            if width == 1:
                if tree == TOP:
                    return
                del self.open[tree, level, idx]
                tree, total, level, idx = TOP, self.groups, 0, tree
            else:
                first = idx // ARITY * ARITY
                run = [(tree, level, i) for i in range(first, min(first + ARITY, width))]
                if not all(k in self.open for k in run):
                    return
                value = digest(self.open.pop(k)[1] for k in run)
                level, idx = level + 1, idx // ARITY
            self.made.append((tree, total, level, idx, value))


def _leaves_of(g: pd.DataFrame, runs: pd.DataFrame) -> tuple[list[str], list[tuple[int, int, int, int]]]:
    """The leaves of a partition in order, and its runs of one group: rank, total, first index, number."""
    leaves = [b.hex() for b in g.sort_values("place")["leaf"]]
    listed = runs.sort_values("rank")
    return leaves, list(zip(*(listed[c].tolist() for c in ("rank", "total", "start", "n")), strict=True))


def _planted(leaves: list[str], runs: list, groups: int) -> tuple[Forest, dict]:
    """The forest of a partition, and all nodes that it knows."""
    forest, at = Forest(groups), 0
    known = {}
    for rank, total, start, n in runs:
        for i in range(n):
            known[rank, 0, start + i] = leaves[at + i]
            forest.add(rank, total, 0, start + i, leaves[at + i])
        at += n
    known |= {(t, level, i): v for t, _, level, i, v in forest.made}
    return forest, known


def _edges(tree: int, total: int, first: int, last: int) -> Iterable[tuple[int, int, int]]:
    """Nodes beside the ancestors of leaves first..last that may lie outside of them."""
    for level, width in enumerate(counts(total)[:-1]):
        for i in range(first // ARITY * ARITY, first + 1):
            yield tree, level, i
        for i in range(last, min(last // ARITY * ARITY + ARITY, width)):
            yield tree, level, i
        first, last = first // ARITY, last // ARITY


def _fragment(groups: int):
    """A partition's open nodes, and the nodes that its proofs need from others."""

    def run(g: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        part = int(g["part"].iat[0])
        leaves, runs = _leaves_of(g, r)
        forest, known = _planted(leaves, runs, groups)
        wanted = [k for rank, total, start, n in (runs[0], runs[-1]) for k in _edges(rank, total, start, start + n - 1)]
        wanted += [*_edges(TOP, groups, runs[0][0], runs[-1][0]), (TOP, 0, runs[0][0]), (TOP, 0, runs[-1][0]), (TOP, len(counts(groups)) - 1, 0)]
        rows = [(part, "open", t, total, level, i, v) for (t, level, i), (total, v) in forest.open.items()]
        rows += [(part, "wanted", t, 0, level, i, None) for t, level, i in dict.fromkeys(wanted) if (t, level, i) not in known]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _NODES.split(", ")])

    return run


def _merge(groups: int):
    """The merged forest of ``FAN`` partitions and the nodes that merging made."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        forest = Forest(groups)
        for t, total, level, i, v in zip(*(g[c].tolist() for c in ("tree", "total", "level", "idx", "digest")), strict=True):
            forest.add(t, total, level, i, v)
        slot = int(g["part"].iat[0])
        rows = [(slot, "open", t, total, level, i, v) for (t, level, i), (total, v) in forest.open.items()]
        rows += [(slot, "made", *node) for node in forest.made]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _NODES.split(", ")])

    return run


def _proofs(groups: int, carried: list[str]):
    """Each leaf with its group's root, the root, and its siblings before and after it, level by level."""

    def steps(known: dict, tree: int, total: int, idx: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for level, width in enumerate(counts(total)[:-1]):
            own, place = np.unique(idx, return_inverse=True)
            before, after = np.empty(len(own), object), np.empty(len(own), object)
            for k, i in enumerate(own.tolist()):
                first = i // ARITY * ARITY
                before[k] = "".join(known[tree, level, j] for j in range(first, i))
                after[k] = "".join(known[tree, level, j] for j in range(i + 1, min(first + ARITY, width)))
            out.append((before[place], after[place]))
            idx = idx // ARITY
        return out

    def run(g: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        answers = r[r["kind"] == "answer"]
        leaves, runs = _leaves_of(g, r[r["kind"] == "run"])
        _, known = _planted(leaves, runs, groups)
        known |= {(t, level, i): v for t, level, i, v in zip(*(answers[c].tolist() for c in ("tree", "level", "idx", "digest")), strict=True)}
        before, after, subroot = [], [], []
        for rank, total, start, n in runs:
            levels = steps(known, rank, total, np.arange(start, start + n)) + steps(known, TOP, groups, np.full(n, rank))
            for side, out in enumerate((before, after)):
                out += list(np.stack([s[side] for s in levels], 1)) if levels else [np.empty(0, object)] * n
            subroot += [known[TOP, 0, rank]] * n
        g = g.sort_values("place")
        return pd.DataFrame({"key": g["key"].to_numpy(), "leaf": leaves, "subroot": subroot, "root": known[TOP, len(counts(groups)) - 1, 0], "before": before, "after": after, **{c: g[c].to_numpy() for c in carried}})

    return run


def leaf_digest(*fields: Column) -> Column:
    """Hex sha256 of the fields, each ``-`` if null, else its UTF-8 byte count, a colon and its value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts)), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(proof, leaf, lambda at, s: F.sha2(F.concat(s["before"], at, s["after"]), 256))


def proof_digest(proof: Column) -> Column:
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def merkle_manifest(rows: DataFrame, key: str, group: str, leaf: Column, carry: dict[str, Column] | None = None) -> DataFrame:
    """``key``, leaf, subroot, root and proof for every row of ``rows``, and the ``carry`` columns (digests).

    ``leaf`` is the hex digest of a row (see :func:`leaf_digest`).  Trees hold the
    rows of one ``group`` value (null is a group, the first one; others go by
    their UTF-8 bytes) by ascending ``key`` (an integer, null first); rows of one
    key go by their leaf, so equal rows are separate leaves and the result doesn't
    depend on their order.  A proof is an array of the siblings before and after
    the row's ancestor, one step per level up to the root; ``fold`` takes it back
    to the root.  One row alone is its own root and has an empty proof.  An empty
    table gives no rows; other columns are ignored.
    """
    carry = carry or {}
    spark = rows.sparkSession
    stage = Stage(spark, "merkle")
    binary = {"leaf": F.unhex(leaf), **{f"carried_{c}": F.unhex(v) for c, v in carry.items()}}
    own = rows.select(F.col(key).cast("long").alias("key"), F.col(group).cast("string").alias("source"), *(v.alias(c) for c, v in binary.items()))
    # numbered before it is dealt, so that even rows equal in everything spread over partitions
    hashed = stage.put(own.withColumn("at", F.monotonically_increasing_id()), "leaves")
    n = hashed.count()
    shards = max(1, math.ceil(n / LEAVES), min(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / LEAST_LEAVES)))
    order = ["source", "key", "leaf", "at"]
    ordered = hashed.repartitionByRange(shards, *order).sortWithinPartitions(*order).drop("at").withColumn("place", F.monotonically_increasing_id())
    leaves = stage.put(ordered.withColumn("part", F.shiftright("place", 33)), "ordered")

    groups = Window.partitionBy("source")
    runs = leaves.groupBy("part", "source").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    runs = runs.withColumn("total", F.sum("n").over(groups)).withColumn("home", F.min("part").over(groups)).withColumn("head", F.min("first").over(groups))
    runs = stage.put(runs.withColumn("start", F.sum("n").over(groups.orderBy("part")) - F.col("n")), "runs")
    heads = runs.where("part = home").select("home", "head")
    # one row per partition in which a group begins, in one window
    homes = heads.groupBy("home").agg(F.count("*").alias("m")).withColumn("before", F.sum("m").over(Window.partitionBy(F.lit(0)).orderBy("home")) - F.col("m"))
    ranked = heads.join(homes, "home").select("head", (F.col("before") + F.row_number().over(Window.partitionBy("home").orderBy("head")) - 1).alias("rank"))
    runs = stage.put(runs.join(ranked, "head").select("part", "rank", "total", "start", "n"), "ranked")
    n_groups, last = runs.agg(F.count_if(F.col("start") == 0), F.coalesce(F.max("part"), F.lit(0))).first()

    slim = leaves.select("part", "place", "leaf").groupBy("part").cogroup(runs.groupBy("part"))
    state = stage.put(slim.applyInPandas(_fragment(n_groups), _NODES), "fragments")
    wanted = state.where("kind = 'wanted'").select("part", "tree", "level", "idx")
    open_ = state.where("kind = 'open'")
    spine, width = open_, last + 1  # as dealt, whatever was asked for
    while width > 1:
        width = -(-width // FAN)
        merged = stage.put(open_.withColumn("part", F.expr(f"part div {FAN}")).groupBy("part").applyInPandas(_merge(n_groups), _NODES), "merged")
        spine, open_ = spine.unionByName(merged.where("kind = 'made'")), merged.where("kind = 'open'")
    answers = wanted.join(spine.select("tree", "level", "idx", "digest"), ["tree", "level", "idx"])
    told = runs.withColumn("kind", F.lit("run")).unionByName(answers.withColumn("kind", F.lit("answer")), allowMissingColumns=True).na.fill(0)
    carried = [f"carried_{c}" for c in carry]
    kind = ", ".join(f"{c} binary" for c in carried)
    schema = "key long, leaf string, subroot string, root string, before array<string>, after array<string>" + (f", {kind}" if kind else "")
    out = leaves.select("part", "place", "key", "leaf", *carried).groupBy("part").cogroup(told.groupBy("part")).applyInPandas(_proofs(n_groups, carried), schema)
    return out.select(F.col("key").alias(key), "leaf", "subroot", "root", F.arrays_zip("before", "after").alias("proof"), *(F.lower(F.hex(f"carried_{c}")).alias(c) for c in carry))
